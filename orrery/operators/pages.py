"""Publication and update times in the HTML of article pages, and the audit against stored times."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import any_timestamp, hours_between

#: Names that mark a time of publication or change, JSON keys, and the words before a time in the text.
PUBLISHED_NAMES = (
    "article:published_time",
    "og:article:published_time",
    "datepublished",
    "publishdate",
    "pubdate",
    "dc.date",
    "dc.date.issued",
    "parsely-pub-date",
)
MODIFIED_NAMES = (
    "article:modified_time",
    "og:article:modified_time",
    "datemodified",
    "lastmod",
    "last-modified",
    "dc.modified",
    "parsely-updated",
)
NAME_ATTRIBUTES = ("property", "name", "itemprop", "http-equiv")
UPDATED_TEXT = re.compile(
    r"(?i)\b(?:updated|last updated|modified)\b[^0-9]{0,20}"
    r"(\d{4}-\d{2}-\d{2}(?:[T\s]\d{2}:\d{2}(?::\d{2})?(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)"
)


class _Tags(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta: list[tuple[str, str]] = []
        self.documents: list[str] = []
        self._in = False

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        if tag == "meta" and at.get("content", "").strip():
            name = next((at[k] for k in NAME_ATTRIBUTES if at.get(k)), "")
            if name:
                self.meta.append((name.strip().lower(), at["content"].strip()))
        self._in = tag == "script" and at.get("type", "").lower() == "application/ld+json"

    def handle_endtag(self, tag):
        self._in = False

    def handle_data(self, data):
        if self._in:
            self.documents.append(data)


def search_json(tree, key: str, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, value) of the strings and numbers under ``key``, whatever its case, in the order of the document."""
    if isinstance(tree, dict):
        for k, v in tree.items():
            if k.lower() == key and isinstance(v, (str, int, float)):
                yield f"{path}.{k}", v if isinstance(v, str) else str(int(v))
            yield from search_json(v, key, f"{path}.{k}")
    elif isinstance(tree, list):
        for i, v in enumerate(tree):
            yield from search_json(v, key, f"{path}[{i}]")


def stated_times(html: str) -> dict[str, list[tuple[str, str]]]:
    """(source, string) of every candidate, in order of preference: meta tags, JSON documents, then (for changes) the text."""
    tags = _Tags()
    try:
        tags.feed(html)
    except Exception:  # noqa: BLE001 - the parser gives up on some broken markup; what it read counts
        pass
    trees = []
    for i, raw in enumerate(tags.documents):
        try:
            trees.append((f"$[{i}]", json.loads(unescape(raw).strip())))
        except (ValueError, RecursionError):
            continue
    out = {}
    for kind, names, key in (("published", PUBLISHED_NAMES, "datepublished"), ("modified", MODIFIED_NAMES, "datemodified")):
        found = [(f"meta:{n}", v) for n, v in tags.meta if n in names]
        for path, tree in trees:
            try:
                found += [(f"jsonld:{at}", v) for at, v in search_json(tree, key, path)]
            except (RecursionError, OverflowError, ValueError):
                continue
        if kind == "modified" and (m := UPDATED_TEXT.search(html)):
            found.append(("html:updated_text_fallback", m[1]))
        out[kind] = found
    return out


def page_times(pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """page_id, published, published_source, modified, modified_source: the first of each page's stated times that is a time.

    ``max_bytes``, for pages as a bounded fetch would give them: only that many first characters are parsed.
    """
    kinds = ("published", "modified")
    candidates = pa.list_(pa.struct([("source", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stated_times((h.as_py() or "")[:max_bytes]) for h in batch.column(1)]
            lists = [pa.array([[{"source": s, "value": v} for s, v in f[k]] for f in found], candidates) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["page_id", *kinds])

    page = pages.schema["page_id"].dataType.simpleString()
    raw = pages.select("page_id", "html").mapInArrow(run, f"page_id {page}, " + ", ".join(f"{k} array<struct<source:string,value:string>>" for k in kinds))
    first = lambda k: F.get(F.filter(F.transform(k, lambda x: F.struct(x["source"].alias("source"), any_timestamp(x["value"]).alias("at"))), lambda x: x["at"].isNotNull()), 0)
    times = raw.select("page_id", *[first(k).alias(k) for k in kinds])
    return times.select("page_id", *[c for k in kinds for c in (F.col(f"{k}.at").alias(k), F.col(f"{k}.source").alias(f"{k}_source"))])


def audit(articles: DataFrame, times: DataFrame, key: str = "page_id") -> DataFrame:
    """Articles (key, db_time) with status: suspicious if stored before publication, ok, or unknown; and the hours between."""
    joined = articles.join(times, key, "left")
    status = F.when(F.col("published").isNull(), "unknown").when(F.col("db_time") < F.col("published"), "suspicious").otherwise("ok")
    return joined.withColumn("status", status).withColumn("delta_hours", hours_between("db_time", "published"))
