"""Sinks.  Spark's commit protocol publishes files whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl_shards(rows: DataFrame, path: str, most: int = 2048) -> None:
    rows.write.option("maxRecordsPerFile", most).json(path)


def parquet_chunks(rows: DataFrame, path: str, most: int = 2048) -> None:
    rows.write.option("maxRecordsPerFile", most).parquet(path)


def by_exchange(rows: DataFrame, path: str) -> None:
    """Bars or market values, a folder an exchange, sorted by symbol so that reads of one skip the rest."""
    rows.repartition("exchange", "symbol").sortWithinPartitions("symbol", "trade_date").write.partitionBy("exchange").parquet(path)


def reason_log(rows: DataFrame, path: str) -> None:
    """The rows that have a reason, as CSV."""
    rows.filter("reason is not null").write.option("header", "true").csv(path)


def ticker_list(universe: DataFrame, text_path: str, csv_path: str) -> None:
    universe.select("full_ticker").orderBy("full_ticker").write.text(text_path)
    universe.write.option("header", "true").csv(csv_path)


def wide_weights(targets: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """One column a symbol: only for export, where the names are few."""
    by = targets.groupBy("trade_date")
    return (by.pivot("symbol", symbols) if symbols else by.pivot("symbol")).agg(F.sum("weight")).fillna(0.0)


def artifacts(frames: dict[str, DataFrame], folder: str) -> None:
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}")


GRID_COLUMNS = ["l2", "spearman_days", "spearman_mean", "spearman_std", "spearman_ir", "pearson_days", "pearson_mean", "pearson_std", "pearson_ir"]


def grid_summary(rows: DataFrame, path: str) -> None:
    rows.select(*GRID_COLUMNS).coalesce(1).write.option("header", "true").csv(path)  # one row a penalty


def loss_bundle(contribs: DataFrame, path: str) -> None:
    contribs.write.partitionBy("trade_date").option("header", "true").csv(path)


def metrics_json(row: DataFrame) -> str:
    """A one-row frame as JSON."""
    return json.dumps(row.first().asDict(), default=str, sort_keys=True)


def progress(query) -> dict:
    """What a streaming query last did."""
    last = query.lastProgress
    return {"batch": last["batchId"], "rows": last["numInputRows"]} if last else {}


def equity_plot(daily: DataFrame, path: str) -> None:
    """A chart of equity by day (a row a day); needs matplotlib."""
    import matplotlib.pyplot as plt

    rows = daily.select("trade_date", "equity", "baseline_equity").orderBy("trade_date").toPandas()
    axes = rows.plot(x="trade_date", y=["equity", "baseline_equity"])
    axes.figure.savefig(path)
    plt.close(axes.figure)
