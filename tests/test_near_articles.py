"""Near-duplicate articles against all pairs, and how they are found."""

import datetime as dt
from collections import Counter

import numpy as np
import pytest

from orrery.operators import dedupe as D
from orrery.operators.bag_products import Block

D0 = dt.date(2024, 3, 6)
SCHEMA = "symbol string, day date, doc long, text string"


@pytest.fixture(scope="module")
def rows():
    """Two symbols over six weeks, some texts alike; a crowded day, repeated docs, heavy counts, empty texts and nulls."""
    rng = np.random.default_rng(4)
    words, out = [f"w{k}" for k in range(40)], []
    for doc in range(220):
        base = np.random.default_rng(doc % 11).choice(words, 14)
        text = " ".join([*base, *rng.choice(words, 1 + doc % 4)])
        day = D0 + dt.timedelta(int(rng.integers(0, 42)) if doc % 3 else 7)
        out.append(("AB"[doc % 5 == 0], day, doc, text))
    out += [("A", D0, 300, "w0 " * 6000 + "w1 w2"), ("A", D0, 301, "W0 " * 5000 + "w3"), ("A", D0, 302, ""), ("A", D0, 303, None)]
    out += [("A", D0, 304, "w5 w6 w7"), ("A", D0, 304, "w8 w9"), ("A", D0, 305, "w5-w6-w7\nw8 w9"), (None, D0, 306, "w5 w6"), (None, D0, 307, "w5 w6")]
    return out


def all_pairs(rows, threshold, window):
    """(symbol, earlier, later) -> cosine."""
    bags = {}
    for s, d, doc, text in rows:
        if s is not None:
            bags.setdefault((s, d, doc), Counter()).update((text or "").lower().replace("-", " ").split())
    found = {}
    for (s, d, a), x in bags.items():
        for (t, e, b), y in bags.items():
            if s == t and (d, a) < (e, b) and np.busday_count(d, e) <= window:
                dot = sum(c * y[w] for w, c in x.items())
                if dot and (cosine := dot / (np.sqrt(sum(c * c for c in x.values())) * np.sqrt(sum(c * c for c in y.values())))) >= threshold:
                    found[s, a, b] = cosine
    return found


@pytest.mark.parametrize("block", [D.BLOCK, 9])
def test_pairs_against_all_pairs(spark, rows, block):
    f = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.symbol, r.earlier, r.later): r.cosine for r in D.similar_pairs(f, 0.8, block=block).collect()}
    assert got == all_pairs(rows, 0.8, 5) and len(got) > 300 and ("A", 300, 301) in got and ("A", 304, 305) in got


@pytest.mark.parametrize("turn", [D.TURN, 5])
def test_kept_against_all_pairs(spark, rows, turn, monkeypatch):
    monkeypatch.setattr(D, "TURN", turn)
    pairs, dropped = all_pairs(rows, 0.8, 5), set()
    for s, _, doc in sorted({(s, d, doc) for s, d, doc, _ in rows if s is not None}):
        if any((s, a, doc) in pairs and (s, a) not in dropped for a in range(400)):
            dropped.add((s, doc))
    got = [(r.symbol, r.doc, r.kept) for r in D.greedy_keep(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(((s, doc, (s, doc) not in dropped) for s, _, doc, _ in rows), key=str)


def test_products_are_exact_where_single_precision_is_not():
    token = np.arange(2)
    big = Block(np.zeros(1, int), np.zeros(1, int), np.zeros(2, int), token, np.array([5001, 4999])).index()
    assert big.products(big, 0, 1)[0, 0] == 5001**2 + 4999**2


@pytest.mark.parametrize("find", [D.similar_pairs, D.greedy_keep])
def test_no_row_per_pair_and_token(spark, rows, find):
    """Tokens are never rows, so no join or sort has one for each token that two articles share."""
    plan = find(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "bag" in plan and "explode(regexp_extract_all" not in plan
