import random

import pytest

LANGS = {"en": "the of and tion ing er wh sh".split(), "de": "ung keit sch der ein ich lich".split()}


def prose(lang: str, n: int, seed: int) -> str:
    r = random.Random(f"{lang}{seed}")
    word = lambda: "".join(r.choice(LANGS[lang]) for _ in range(r.randint(1, 3)))
    return " ".join(word() + ("." if k % 9 == 8 else "") for k in range(n))


EDGE_TEXTS = [None, "", " \n\t", "one", "a b c", "...", "x " * 6000, "ßé 漢字 \U0001f600 İstanbul", "w" * 50_000, "same text here now ok\n" * 3]


@pytest.fixture(scope="session")
def corpus(spark):
    """Edge texts, prose, copies and repeated rows, nulls in every column, and columns whose names clash with the operators'."""
    rows = [(k, t, None, None) for k, t in enumerate(EDGE_TEXTS)]
    rows += [(100 + k, prose("en" if k % 3 else "de", 60 + k, k), "en" if k % 3 else "de", f"s{k % 4}") for k in range(60)]
    rows += [(200, rows[20][1], "en", "s1"), (201, rows[20][1], "en", "s1"), (20, prose("en", 50, 99), None, "s2"), (20, prose("en", 50, 99), None, "s2"), (None, prose("en", 40, 77), "en", None), (None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string"
    f = spark.createDataFrame(rows, schema)
    clash = "n bigint, size int, score double, node binary, bands array<long>, kept boolean, row string, label int, votes int, taken string, key string, start int"
    for c in clash.split(", "):
        name, kind = c.split(" ", 1)
        from pyspark.sql import functions as F

        f = f.withColumn(name, F.lit(None).cast(kind))
    return f.repartition(3).cache()


@pytest.fixture(scope="session")
def texts(corpus):
    return [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.limit(0)
