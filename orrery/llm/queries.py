"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, boosted, bpe, edit_counts, html_blocks, hyperlang, image_copies, mixture, quality_rules, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images; each 8 x 8 grid of ``embeddings`` is taken as one, of 48 x 48 pixels."""
    return image_copies.copies(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", image_copies.grey_of_grid)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(_table(spark, sf_dir, "pages"))


def op4_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op5_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return boosted.classify(docs, boosted.train(docs, labels))


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.redacted_counts(_table(spark, sf_dir, "documents"))


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.classify(docs, toxicity.train(docs, labels))


def op8_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperlang.identify(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_image_copies": op1_image_copies,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_blocks": op3_html_blocks,
    "op4_bpe_chunks": op4_bpe_chunks,
    "op5_boosted_quality": op5_boosted_quality,
    "op6_edit_counts": op6_edit_counts,
    "op7_toxic_segments": op7_toxic_segments,
    "op8_source_mixture": op8_source_mixture,
    "op9_bagminhash": op9_bagminhash,
    "op10_language": op10_language,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _mixture_sql() -> str:
    return rf"""
      with d as (select doc_id, source, len({WORDS}) as size, md5('{mixture.SEED}|' || coalesce(cast(doc_id as varchar), 'null')) as h from documents),
      s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as r from d group by source),
      w as (select *, [{', '.join(f'{w}::double' for w in mixture.WEIGHTS)}][r % {len(mixture.WEIGHTS)} + 1] as weight, {mixture.MAX_EPOCHS}::double * source_size as cap from s),
      o as (select *, cap / weight as level, sum(cap) over k - cap as before, sum(weight) over (order by cap / weight, r rows between current row and unbounded following) as after
        from w window k as (order by cap / weight, r)),
      l as (select first(({mixture.SHARE} * (select sum(source_size) from s) - before) / after order by level, r) as level from o
        where ({mixture.SHARE} * (select sum(source_size) from s) - before) / after <= level),
      t as (select source, source_size, least(cap, weight * l.level) as target from w, l),
      u as (select *, floor(target / nullif(source_size, 0)) as whole from t),
      x as (select d.*, source_size, target, whole::bigint as whole, round(target - whole * source_size)::bigint as rest,
        sum(size) over (partition by d.source order by h, doc_id, size rows unbounded preceding) - size as done
        from d join u on d.source is not distinct from u.source)
      select doc_id, size, source_size, target, (coalesce(whole, 0) * size + greatest(0, least(size, coalesce(rest, 0) - done)))::bigint as taken from x"""


def _quality_sql() -> str:
    rules = quality_rules.RULES
    n, w, a = len(rules), quality_rules.WINDOW, quality_rules.SMOOTHING
    votes = ", ".join(f"case when {good} then 1 when {bad} then -1 else 0 end" for _, good, bad in rules)
    odds = lambda m, v: f"ln({m}.prior / (1 - {m}.prior)) + " + " + ".join(
        f"case {v}[{j}] when 1 then ln((1 - {m}.good[{j}]) / (1 - {m}.bad[{j}])) when -1 then ln({m}.good[{j}] / {m}.bad[{j}]) else 0 end" for j in range(1, n + 1)
    )
    trust = lambda j: f"({a} + {quality_rules.TRUST} * sum(case when v[{j}] <> 0 then c else 0 end))"
    rate = lambda j, g, e: f"({e} * {trust(j)} + sum(case when v[{j}] = -1 then c * {g} else 0 end)) / ({trust(j)} + sum(case when v[{j}] <> 0 then c * {g} else 0 end))"
    expected = quality_rules.EXPECTED
    return rf"""
      with recursive d as (select row_number() over () as k, doc_id, coalesce(text, '') as text, {WORDS} as words from documents),
      win as (select k, p, words[p:p + {w - 1}] as five from (select k, words, unnest(range(1, len(words) - {w - 2})) as p from d where len(words) >= {w})),
      spots as (select k, p from win qualify count(*) over (partition by k, five) > 1),
      cov as (select k, count(distinct p + j) as n_repeat_words from spots, (select unnest(range({w})) as j) group by k),
      st as (
        select k, doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars, len(list_distinct(words)) as n_distinct,
          length(text) - length(regexp_replace(text, '[{quality_rules.SYMBOLS}]', '', 'g')) as n_symbols, length(text) - length(replace(text, '|', '')) as n_pipes,
          length(text) - length(replace(text, '!', '')) as n_bangs, length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) as n_upper, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
          coalesce(n_repeat_words, 0) as n_repeat_words from d left join cov using (k)),
      s2 as (select *, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines from st),
      s3 as (select *, [{votes}] as v from s2),
      pat as (select v, count(*)::double as c from s3 group by v),
      em as (
        select 0 as i, {quality_rules.FIRST_PRIOR}::double as prior, [{', '.join([f'{expected[0]}::double'] * n)}] as good, [{', '.join([f'{expected[1]}::double'] * n)}] as bad
        union all
        select i + 1, ({a} + sum(c * g)) / (2 * {a} + sum(c)), [{', '.join(rate(j, 'g', expected[0]) for j in range(1, n + 1))}],
          [{', '.join(rate(j, '(1 - g)', expected[1]) for j in range(1, n + 1))}]
        from (select i, v, c, 1 / (1 + exp(-({odds('em', 'pat.v')}))) as g from em, pat where i < {quality_rules.ITERATIONS}) group by i),
      scored as (select s3.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, round(1 / (1 + exp(-({odds('em', 's3.v')}))), 6) as quality from s3, em where i = {quality_rules.ITERATIONS})
      select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, not base_failed and quality >= 0.5 as kept from scored"""


#: The other operators have no SQL: sketches, hashing into vectors, trees, tokenizers, HTML.
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": _quality_sql(), "op8_source_mixture": _mixture_sql()}
