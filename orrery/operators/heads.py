"""Return heads: group features, ridge by one Gram matrix, information coefficients."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import base_symbol
from ..functions.times import date_int, split_of

#: Tasks that add up the partial matrices before the driver does.
MERGE = 16


def finite_vector(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def finite(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))


def vector_sums(rows: DataFrame, keys: list[str], vector: str, dimensions: int) -> DataFrame:
    """keys, vec_sum (element by element, in doubles), n; rows with a non-finite or odd-sized vector are left out.

    One sum per element in a single aggregation: the map side combines, nothing is exploded.
    """
    good = rows.filter(finite_vector(vector) & (F.size(vector) == dimensions))
    sums = [F.sum(F.get(vector, k).cast("double")).alias(f"_{k}") for k in range(dimensions)]
    out = good.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    return out.select(*keys, F.array(*[F.col(f"_{k}") for k in range(dimensions)]).alias("vec_sum"), "n")


def mean_vector(groups: DataFrame) -> DataFrame:
    return groups.withColumn("vec_mean", F.transform("vec_sum", lambda x: x / F.col("n")))


def dot(vector: str, weights: list[float]) -> Column:
    """Sum of products, in the order of the elements."""
    return F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def group_score(mode: str, weights: list[float], bias: float) -> Column:
    """Score of a stock-day: of its mean vector, of its sum plus n biases, or of its sum plus one bias."""
    if mode == "mean":
        return dot("vec_sum", weights) / F.col("n") + bias
    return dot("vec_sum", weights) + (F.col("n") * bias if mode == "sum_head" else F.lit(bias))


def masked_mean(states: str, mask: str, dimensions: int) -> Column:
    """Mean of the vectors of ``states`` that ``mask`` marks with 1; what is not finite becomes 0, and so does a mean of none."""
    zero = F.array_repeat(F.lit(0.0), dimensions)
    marked = F.zip_with(states, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(marked, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m), F.lit(1e-6))
    return F.transform(total, lambda x: F.when(finite(x / count), x / count).otherwise(0.0))


def universe_by_split(stats: DataFrame, train: tuple[int, int], validation: tuple[int, int], target: str = "fwd_ret") -> DataFrame:
    """split, trade_date, symbol (base.US), target: every finite target of a day that lies in a split."""
    split = split_of(date_int("trade_date"), train, validation)
    rows = stats.filter(finite(target)).withColumn("split", split).filter("split is not null")
    return rows.select("split", "trade_date", F.concat(base_symbol(F.upper("symbol")), F.lit(".US")).alias("symbol"), F.col(target).alias("target"))


def train_and_score(rows: DataFrame, vector: str, label: str, dimensions: int, l2: float) -> tuple[DataFrame, tuple[list[float], float]]:
    """Rows of both splits with ``pred`` of a ridge head that was fitted on those of split train, and its weights and bias.

    rows: split (train or val; others are left out), ``vector``, ``label``; a row whose
    vector is not finite or of another size is left out, one without a finite label is scored only.
    """
    good = rows.filter(F.col("split").isin("train", "val") & finite_vector(vector) & (F.size(vector) == dimensions))
    weights, bias = ridge(gram(good.filter((F.col("split") == "train") & finite(label)), vector, label, dimensions), l2)
    return good.withColumn("pred", dot(vector, list(weights)) + F.lit(bias)), (weights.tolist(), bias)


def ic_by_split(scored: DataFrame, min_universe: int = 20) -> DataFrame:
    """``ic_summary`` of each split, named in column split."""
    each = [ic_summary(scored.filter(F.col("split") == s), min_universe).withColumn("split", F.lit(s)) for s in ("train", "val")]
    return each[0].unionByName(each[1])


def gram(rows: DataFrame, vector: str, target: str, dimensions: int) -> dict[str, np.ndarray | float]:
    """n, X'X, X'y, sum x, sum y, sum y^2 over all rows: partial sums on the executors, one small merge.

    Each task makes one (d + 2) x (d + 2) matrix; ``MERGE`` tasks add these up, and
    the driver adds up their results, whatever the number of rows.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions + 2, dimensions + 2))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, dimensions)
            z = np.column_stack([x, np.ones(len(x)), batch.column(1).to_numpy(zero_copy_only=False)])
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], ["z"])

    good = rows.filter(finite_vector(vector) & (F.size(vector) == dimensions) & finite(target)).select(vector, F.col(target).cast("double").alias("y"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions + 2) ** 2)
        for batch in batches:
            for row in batch.column(0):
                total += np.array(row.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["z"])

    parts = good.mapInArrow(run, "z array<double>").repartition(MERGE).mapInArrow(add, "z array<double>").collect()
    z = np.sum([p["z"] for p in parts], axis=0) if parts else np.zeros((dimensions + 2) ** 2)
    z = z.reshape(dimensions + 2, dimensions + 2)
    d = dimensions
    return {"n": z[d, d], "xx": z[:d, :d], "xy": z[:d, d + 1], "x": z[:d, d], "y": z[d, d + 1], "yy": z[d + 1, d + 1]}


def ridge(stats: dict, l2: float) -> tuple[np.ndarray, float]:
    """Weights and bias of least squares with l2 |w|^2 (sums, not means; the bias is free)."""
    d = len(stats["xy"])
    a = np.zeros((d + 1, d + 1))
    a[:d, :d] = stats["xx"] + l2 * np.eye(d)
    a[:d, d] = a[d, :d] = stats["x"]
    a[d, d] = stats["n"]
    b = np.append(stats["xy"], stats["y"])
    try:
        w = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        w = np.linalg.pinv(a) @ b
    return w[:d], float(w[d])


def sum_head_adam(x: np.ndarray, n: np.ndarray, y: np.ndarray, epochs: int = 10, lr: float = 1e-4, batch: int = 4096, decay: float = 0.0, seed: int = 42) -> tuple[np.ndarray, float]:
    """Mean squared error of x w + n b by decoupled-decay Adam from zero, on a sample that fits the driver."""
    rng = np.random.default_rng(seed)
    z = np.column_stack([x, n]).astype(float)
    w, m, v, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1]), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            g = 2 * z[rows].T @ (z[rows] @ w - y[rows]) / len(rows)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w * (1 - lr * decay) - lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def average_rank(x: str, *by: str) -> Column:
    """Rank within ``by``, ties sharing the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def guarded_corr(x: str, y: str) -> Column:
    """Correlation; null where a variance is zero."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def daily_ic(predictions: DataFrame) -> DataFrame:
    """trade_date, n, pearson, spearman over a day's pairs of finite pred and target."""
    good = predictions.filter(finite("pred") & finite("target"))
    ranked = good.withColumns({"_rp": average_rank("pred", "trade_date"), "_rt": average_rank("target", "trade_date")})
    return ranked.groupBy("trade_date").agg(F.count("*").alias("n"), guarded_corr("pred", "target").alias("pearson"), guarded_corr("_rp", "_rt").alias("spearman"))


def ic_summary(predictions: DataFrame, min_universe: int = 20) -> DataFrame:
    """One row: for pearson and spearman the days, mean, sample deviation and mean / deviation, over days with enough names."""
    days = daily_ic(predictions).filter(F.col("n") >= min_universe)
    out = []
    for c in ("pearson", "spearman"):
        out += [F.count(c).alias(f"{c}_days"), F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.try_divide(F.avg(c), F.stddev_samp(c)).alias(f"{c}_ir")]
    return days.agg(*out)


def no_news_zero(predictions: DataFrame, universe: DataFrame) -> DataFrame:
    """The whole universe (trade_date, symbol, target) with pred, 0 where there is none."""
    names = universe.dropDuplicates(["trade_date", "symbol"])
    return names.join(predictions.select("trade_date", "symbol", "pred"), ["trade_date", "symbol"], "left").withColumn("pred", F.coalesce("pred", F.lit(0.0)))


def grid(stats: dict, validation: DataFrame, vector: str, l2s: list[float], min_universe: int = 20) -> DataFrame:
    """One row per penalty: its validation coefficients, best first.  One Gram serves all penalties."""
    out = None
    for l2 in l2s:
        w, b = ridge(stats, l2)
        scored = validation.withColumn("pred", dot(vector, list(w)) + b)
        row = ic_summary(scored, min_universe).withColumn("l2", F.lit(float(l2)))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc_nulls_last("spearman_mean"), F.desc_nulls_last("spearman_ir"), "l2")


def principal_axes(stats: dict, k: int) -> np.ndarray:
    """The k leading axes of the rows' covariance: a linear encoder in place of a trained one where no GPU is at hand."""
    mean = stats["x"] / stats["n"]
    values, axes = np.linalg.eigh(stats["xx"] / stats["n"] - np.outer(mean, mean))
    return axes[:, np.argsort(values)[::-1][:k]]
