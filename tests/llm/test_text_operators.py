"""Quality rules, mixture, byte-pair encoding, edit counts, language: against brute force, on edge cases."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import bpe, edit_counts, hyperlang, mixture, quality_rules
from orrery.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(name, spark, sf):
    con = duckdb.connect()
    path = f"{sf}/documents.parquet"
    con.execute(f"create view documents as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    frame = QUERIES[name](spark, sf)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(map(tuple, frame.select(*names).collect()), key=str) == sorted(cursor.fetchall(), key=str)


def base_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_statistics(corpus, texts, empty):
    got = [tuple(r)[:7] for r in quality_rules.judge(corpus).collect()]
    assert sorted(got, key=str) == sorted([(d, *base_statistics(t)) for d, t in texts], key=str)
    assert quality_rules.judge(empty).count() == 0
    kept = quality_rules.kept_documents(corpus)
    assert kept.columns == corpus.columns and kept.filter("text is null").isEmpty()
    assert kept.count() >= 60


def test_label_model_finds_how_often_rules_fire(spark):
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.7
    votes = [[-1 if not g and rng.random() < p else (1 if rng.random() < 0.9 else 0) for p in (0.9, 0.8, 0.3)] for g in good]
    model = quality_rules.fit_label_model(spark.createDataFrame([(v,) for v in votes], "votes array<int>"), 3).first()[0]
    assert abs(model.prior - 0.7) < 0.05
    assert all(abs(r.bad - p) < 0.08 and r.good < 0.005 for r, p in zip(model.rules, (0.9, 0.8, 0.32)))


def test_one_bad_vote_may_or_may_not_be_enough(spark):
    """The posterior weighs votes: it neither needs all rules to pass nor lets any single fault pass."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    votes = quality_rules.text_statistics(docs).select("doc_id", F.array(*quality_rules.vote_columns()).alias("votes"))
    bad = votes.select("doc_id", F.size(F.filter("votes", lambda v: v == -1)).alias("bad"))
    seen = defaultdict(lambda: [0, 0])
    for r in bad.join(quality_rules.judge(docs).select("doc_id", "quality"), "doc_id").groupBy("bad", (F.col("quality") >= 0.5).alias("good")).count().collect():
        seen[r.bad][r.good] += r["count"]
    assert seen[0][0] == 0 and min(seen[1]) > 10 and seen[3][1] == 0, dict(seen)


def brute_targets(sizes, weights):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[i % 3]) for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixture(corpus, texts, empty, spark):
    rows = mixture.mix(corpus).collect()
    assert len(rows) == len(texts)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    expected = brute_targets(sizes, (3, 1, 2))
    for r in rows:
        assert np.isclose(r.target, expected[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 1
    again = mixture.mix(corpus.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixture.mix(empty).count() == 0
    mixed = mixture.mixed_documents(corpus)
    assert mixed.columns == corpus.columns
    words = mixed.groupBy("source").agg(F.sum(mixture.word_count(F.col("text"))).alias("n")).collect()
    largest = max(len(WORD.findall(t or "")) for _, t in texts)
    assert all(abs(r.n - expected[r.source]) <= largest / 2 + 1 for r in words)


def test_mixture_without_words(spark):
    f = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixture.mix(f).collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 1 << 10), (64, 16)])
def test_encoding_equals_the_library(corpus, texts, empty, chunk, overlap):
    coder = bpe.Coder.of(bpe.RANKS)
    expected = []
    for d, t in texts:
        ids = coder.merges.encode_ordinary(t or "")
        expected.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.digests(corpus.filter(F.length("text") < 20_000) if chunk < 100 else corpus, chunk=chunk, overlap=overlap).collect()
    if chunk < 100:
        expected = [e for e, (_, t) in zip(expected, texts) if t is not None and len(t) < 20_000]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert bpe.digests(empty).count() == 0


def test_decoding_is_the_text(corpus, texts):
    got = bpe.decode(bpe.encode(corpus)).collect()
    assert sorted((str(r.doc_id), bytes(r.raw)) for r in got) == sorted((str(d), (t or "").encode()) for d, t in texts)


ALPHABET = ["a", "bc", " ", "  ", "'", "'re", "'ll", "1", "23", "\n", " \n", "é", "ß", "漢字", "!", "..", "\t", "     ", "xxxxxxxxxxxxxxx", "😀"]


def test_stitching_random_texts():
    coder, r = bpe.Coder.of(bpe.RANKS), random.Random(5)
    for k in range(300):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(1, 120))) + "z" * r.randint(0, 90 if k % 5 == 0 else 0) + " " * r.randint(0, 40 if k % 7 == 0 else 0)
        for chunk, overlap in ((20, 8), (33, 5), (64, 16)):
            parts = []
            for s in range(0, max(len(text) - overlap - 1, 0) + 1, chunk - overlap):
                ends, upto, ids = [], [], []
                for m in coder.pattern.finditer(text[s : s + chunk]):
                    ids += coder.piece(m.group())
                    ends.append(s + m.end())
                    upto.append(len(ids))
                parts.append((s, text[s : s + chunk], ends, upto, ids))
            assert bpe.stitch(parts, coder) == coder.merges.encode_ordinary(text)


def test_edits_count_as_a_whole_encoding():
    coder, r = bpe.Coder.of(bpe.RANKS), random.Random(3)
    some = lambda n: "".join(r.choice(ALPHABET) for _ in range(r.randint(0, n)))
    for _ in range(300):
        text = some(300)
        tree = edit_counts.CountTree(coder, text, leaf=r.choice([1, 2, 5, 16]))
        for _ in range(5):
            a = r.randint(0, len(text))
            b, new = min(len(text), a + r.choice([0, 0, 1, 3, 20])), some(r.choice([0, 2, 6, 80]))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text == text and tree.n_tokens == len(coder.encode(text)) and sum(tree.leaves()[0]) == len(text)


def test_stored_trees_take_edits(spark, corpus, empty):
    coder = bpe.Coder.of(bpe.RANKS)
    trees = edit_counts.count_trees(corpus)
    edits = F.when(F.length("text") > 10, F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("end"), F.lit("new 1").alias("text")), F.struct(F.lit(7).alias("start"), F.lit(7).alias("end"), F.lit("?").alias("text"))))
    for r in edit_counts.apply_edits(trees.withColumn("edits", edits)).collect():
        assert r.n_tokens == len(coder.encode(r.text)) == sum(r.leaf_tokens)
    counts = edit_counts.redacted_counts(spark.createDataFrame([(1, "card 4785380592391139 of a.b@c.de at 10.0.0.1 end"), (2, None)], "doc_id long, text string")).collect()
    assert counts[0].n_edits == 3 and counts[0].n_tokens_after == len(coder.encode("card <redacted> of <redacted> at <redacted> end"))
    assert tuple(counts[1])[1:] == (0, 0, 0, 0)
    assert edit_counts.redacted_counts(empty).count() == 0


def test_languages(corpus, empty, texts):
    rows = hyperlang.identify(corpus, dimensions=512).collect()
    assert len(rows) == len(texts)
    by_text = {d: t for d, t in texts}
    for r in rows:
        assert 0 <= r.score <= 1
        t = by_text[r.doc_id]
        if not any(c.isalpha() for c in (t or "")) and r.doc_id is not None:
            assert r.lang_pred == "und" and r.score == 0
    known = {r.doc_id: r.lang for r in corpus.filter("lang is not null and doc_id >= 100").collect()}
    assert all(r.lang_pred == known[r.doc_id] for r in rows if r.doc_id in known)
    assert hyperlang.identify(empty).count() == 0
    spoken = hyperlang.spoken_documents(corpus, 0.05, dimensions=512)
    assert spoken.columns == corpus.columns and spoken.filter("text is null").isEmpty()


def test_held_out_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = hyperlang.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


@pytest.mark.parametrize("left_out", ["fr", "de"])
def test_a_language_that_was_never_learned_goes(spark, left_out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null and length(text) >= 200").withColumn("true", F.col("lang"))
    docs = docs.withColumn("lang", F.when(F.col("lang") != left_out, F.col("lang")))
    before = Counter(r.true for r in docs.collect())
    after = Counter(r.true for r in hyperlang.spoken_documents(docs).collect())
    assert after[left_out] <= 0.1 * before[left_out], (before, after)
    assert all(after[k] >= 0.99 * n for k, n in before.items() if k != left_out), (before, after)


def test_bundles_and_cosines_by_brute_force(spark, corpus):
    """Windows bundled one by one, and every cosine, in plain loops; ties go to the smaller name."""
    d = 256

    def slow(text):
        letters = "".join(c if c.isalpha() else "\0" for c in text.lower())
        letters = "\0" + re.sub("\0+", "\0", letters).strip("\0") + "\0"
        total = np.zeros(d)
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            if b != "\0":
                x, y, z = hyperlang.letter_vectors(np.array([ord(a), ord(b), ord(c)], np.uint32), d).astype(float)
                total += np.roll(x, 2) * np.roll(y, 1) * z
        return total

    texts = [r.text for r in corpus.select("text").collect() if r.text and len(r.text) < 5000]
    got, has = hyperlang.bundles(texts, d)
    for text, vector, ok in zip(texts, got, has):
        assert ok == any(c.isalpha() for c in text)
        assert not ok or np.allclose(vector, slow(text)), text[:40]
    same = spark.createDataFrame([(k, "equal words here", lang, None) for k, lang in enumerate(["b", "a"] * 20)], "doc_id long, text string, lang string, source string")
    assert {r.lang_pred for r in hyperlang.identify(same).collect()} == {"a"}
