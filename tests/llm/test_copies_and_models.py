"""Near-duplicates, images, HTML, classifiers and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import bagminhash, boosted, bpe, features, html_blocks, image_copies, toxicity

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    words = WORD.findall(text or "")
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else None


def brute_classes(rows, threshold=0.8):
    """(doc_id, text) -> class by all pairs."""
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j]:
                both = sum((bags[i] & bags[j]).values())
                if both >= threshold * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, d if bags[i] is None else least.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_edge_texts(corpus, texts, empty):
    got = bagminhash.near_duplicates(corpus).select("doc_id", "class_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_classes(texts), key=str)
    assert bagminhash.near_duplicates(empty).count() == 0


def test_edited_copies_chains_and_multisets(spark):
    rng = np.random.default_rng(0)
    rows, k = [], 0
    for base in range(6):
        words = prose("en", 120, 1000 + base).split()
        for rate in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1):
            copy = [f"new{k}x{i}" if rng.random() < rate else w for i, w in enumerate(words)]
            rows.append((k, " ".join(copy)))
            k += 1
        rows += [(k, " ".join(words + ["again and again we say it"] * r)) for k, r in zip(range(k, k + 3), (4, 5, 9))]
        k += 3
    f = spark.createDataFrame(rows, "doc_id long, text string")
    got = bagminhash.near_duplicates(f).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted(brute_classes(rows))
    stay = bagminhash.distinct_documents(f)
    assert sorted(r.doc_id for r in stay.collect()) == sorted({c for _, c in brute_classes(rows)})


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    owner = np.repeat([0, 1], 60)
    weight = np.concatenate([a, b])
    use = weight > 0
    sig = bagminhash.signatures(owner[use], np.concatenate([h, h])[use], weight[use], 2, 4000)
    expected = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - expected) < 0.03


def test_one_document_a_class_and_repeated_rows(corpus):
    stay = bagminhash.distinct_documents(corpus)
    assert stay.columns == corpus.columns
    ids = [r.doc_id for r in stay.select("doc_id").collect() if r.doc_id is not None]
    assert ids.count(20) == 1 and 200 not in ids and 201 not in ids


def brute_distinct(rows):
    """Rows (doc_id, text) that stay: of each class the smallest doc_id, nulls last; equal rows are one."""
    at = list(range(len(rows)))
    classes = dict(zip(at, [c for _, c in brute_classes([(i, t) for i, (_, t) in enumerate(rows)])]))
    best = {}
    for i, (d, t) in enumerate(rows):
        key = classes[i] if bag(t) else ("none", d, t)
        best[key] = min(best.get(key, (2, 0)), (d is None, d or 0))
    return Counter((None if unnamed else d) for unnamed, d in best.values())


def test_distinct_rows_with_repeated_and_null_ids(spark):
    a, b, c = (prose("en", 80, 500 + k) for k in range(3))
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(5, a), (20, b), (20, a), (20, near), (None, near), (None, c), (None, c), (None, c + " x"), (7, None), (7, None), (None, ""), (8, ""), (30, b), (3, b), (3, b)]
    f = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    stay = bagminhash.distinct_documents(f).collect()
    assert Counter(r.doc_id for r in stay) == brute_distinct(rows) == Counter({5: 1, 3: 1, None: 2, 7: 1, 8: 1})
    assert {r.text for r in stay if r.doc_id in (5, 3)} == {a, b} and sum(r.text is not None and r.text.startswith(c) for r in stay) == 1


def test_a_third_of_all_rows_alike(spark):
    """One group of copies, exact and near, without ids too, and one passage that all texts share."""
    passage = prose("en", 30, 900)
    base = prose("en", 100, 901)
    rows = [(k, f"{base} tail{k % 7}") for k in range(80)] + [(None, base)] * 20
    rows += [(1000 + k, f"{passage} {prose('en', 60, 1000 + k)}") for k in range(150)]
    f = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = bagminhash.near_duplicates(f).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == sorted(brute_classes(rows), key=str)
    assert Counter(r.doc_id for r in bagminhash.distinct_documents(f).collect()) == brute_distinct(rows)


def test_images(spark):
    rng = np.random.default_rng(2)

    def struct(x):
        x = np.clip(np.rint(x), 0, 255).astype(np.uint8)
        return (x.shape[0], x.shape[1], 1, bytearray(x.tobytes()))

    rows, true = [], []
    for k in range(8):
        big = image_copies._resize(rng.random((20, 20)) * 255, 140, 140)
        versions = [big, big, big[15:125, 10:130], big * 0.8 + 20 + rng.normal(0, 2, big.shape), np.rot90(big), image_copies._resize(big, 110, 110)]
        for v in versions:
            rows.append((len(rows), struct(v)))
            true.append(6 * k)
    rows += [(900, None), (901, (0, 0, 1, bytearray())), (902, (30, 30, 1, bytearray(900))), (903, (30, 30, 1, bytearray(900)))]
    f = spark.createDataFrame(rows, "id long, image struct<height:int,width:int,nChannels:int,data:binary>").withColumn("node", F.lit(1)).withColumn("keys", F.lit(1))
    got = {r.id: r.class_id for r in image_copies.copies(f, "id", "image").collect()}
    assert np.mean([got[i] == c for i, c in enumerate(true)]) >= 0.9
    assert all(got[i] // 6 == c // 6 for i, c in enumerate(true))  # no link between different pictures
    assert [got[k] for k in (900, 901, 902, 903)] == [900, 901, 902, 902]
    assert image_copies.copies(f.limit(0), "id", "image").count() == 0


PAGES = {
    "<html><body><nav><a href=1>Home</a> menu</nav><article><h1>A &amp; B</h1><p>first  <b>par</b>\n a</p><p>x</article><footer>f</footer>": "A & B first par a x",
    "<article><p>one<br>two<script>var t='</p>';</script></p><aside>side</aside><div class='comments'><p>nice</div><p>three</article>": "one two three",
    "<article><p>cut off in the mid": "cut off in the mid",
    "<article><p>a<!-- no --><form><input><p>search</form><style>p{}</style>b</article>": "a b",
    "<article><header><h1>T</h1></header><div hidden>h</div><div role=banner>r</div><p>&lt;t&gt; &#233;</article><div id=cookie-notice>we use</div>": "T <t> é",
    "": "", None: "",
}


LINE = "a paragraph of some ten words that nobody has marked"
MISLEADING = {
    "<article><p class='related-work'>what others did before</p></article>": "what others did before",
    f"<div><p>{LINE}</p><li><a href=1>{LINE}</a></li></div>": LINE,
    "<ul>" + "<li><a href=1>one item of a list</a>" * 6 + "</ul>": "",
    f"<div class='with-sidebar'><p>{LINE}</p><p>{LINE}</p><p>{LINE}</p></div>": f"{LINE} {LINE} {LINE}",
    f"<article><p>{LINE}</p><ul><li><a href=1>more</a><li><a href=2>of this</a><li><a href=3>to read</a></ul></article>": LINE,
    f"<article><p>{LINE}</p><aside><p>{LINE}</p></aside><p>so</p></article>": f"{LINE} so",
}


def test_words_and_link_density_decide(spark):
    tree = html_blocks.content_tree()
    assert {page: html_blocks.main_text(page, tree) for page in MISLEADING} == MISLEADING
    assert html_blocks.FEATURES[tree[0][0]] == "density"
    assert html_blocks.main_text(f"<article>{f'<p>{LINE}' * 30_000}</article>", tree) == " ".join([LINE] * 30_000)


class Plain(HTMLParser):
    """Text inside article elements, without that of elements that are no article, by another parser."""

    SKIP = "script style nav aside footer form noscript template iframe".split()

    def __init__(self):
        super().__init__()
        self.article, self.skip, self.out = 0, [], [[]]

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        self.article += tag == "article"
        if self.skip or tag in self.SKIP or at.get("class", "") in ("ad", "comments", "cookie-notice", "sidebar"):
            self.skip += [] if tag in html_blocks.VOID_TAGS else [tag]
        elif tag in html_blocks.BLOCK_TAGS:
            self.out.append([])

    def handle_endtag(self, tag):
        if tag in self.skip:
            del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
        self.article -= tag == "article"
        if tag in html_blocks.BLOCK_TAGS:
            self.out.append([])

    def handle_data(self, data):
        if self.article and not self.skip:
            self.out[-1].append(data)


def test_pages_against_another_parser(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_blocks.extract(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html or "")
        plain.close()
        assert got[r.page_id].split() == " ".join("".join(b) for b in plain.out).split(), r.page_id


def test_pages(spark):
    f = spark.createDataFrame([(k, "u", h) for k, h in enumerate(PAGES)], "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = {r.page_id: (r.text, r.n_chars) for r in html_blocks.extract(f).collect()}
    assert [got[k] for k in range(len(PAGES))] == [(t, len(t)) for t in PAGES.values()]
    assert html_blocks.extract(f.limit(0)).count() == 0
    x, y = html_blocks.labelled_table()
    assert (html_blocks.is_content(html_blocks.content_tree(), x) == y).all()


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = boosted.fit(x, y, trees=20)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95
    total = forest.base
    for t in range(20):
        node = 0
        while forest.step[t, node]:
            node = forest.left[t, node] + int(x[0, forest.feature[t, node]] > forest.threshold[t, node])
        total += forest.value[t, node]
    assert np.isclose(forest.score(x[:1])[0], 1 / (1 + np.exp(-total)))
    assert boosted.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_classifiers_on_edge_texts(spark, corpus, texts, empty):
    labels = spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(100, 160)] + [(None, 1, 1), (101, None, None), (100, 1, 0)], "doc_id long, quality int, toxic int")
    assert features.statistics(corpus.select("text").toArrow().column("text").combine_chunks()).shape == (len(texts), len(features.NAMES))
    for module, label in ((boosted, "quality"), (toxicity, "toxic")):
        model = module.train(corpus, labels, label)
        rows = module.classify(corpus, model).collect()
        assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
        assert module.classify(empty, module.train(empty, labels.limit(0), label)).count() == 0


def all_maximal(scores):
    """Maximal scoring segments by their definition: split at the best one."""
    best = (0.0, None)
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > best[0] + 1e-12 or (abs(s - best[0]) <= 1e-12 and best[1] and j - i < best[1][1] - best[1][0]):
                best = (s, (i, j))
    if best[1] is None:
        return []
    i, j = best[1]
    return all_maximal(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in all_maximal(scores[j:])]


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 14))
        scores = [float(rng.uniform(0.1, 3)) if rng.random() < 0.4 else -0.77 for _ in range(n)]
        places = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(places, [scores[i] for i in places], 0.77)
        assert [(a, b) for a, b, _ in got] == all_maximal(scores)


def test_the_scan_takes_linear_time():
    """Isolated tokens, none of which joins another: steps, not seconds, are counted."""

    class Counted(float):
        asked = 0

        def __ge__(self, other):
            Counted.asked += 1
            return float(self) >= float(other)

        __sub__ = __rsub__ = lambda self, other: Counted(float(self) - float(other))
        __add__ = __radd__ = lambda self, other: Counted(float(self) + float(other))

    steps = []
    for n in (2_000, 20_000):
        for drift, gap in ((1.0, 9), (0.0, 3)):
            Counted.asked = 0
            found = toxicity.maximal_segments([gap * i for i in range(n)], [Counted(1 + i % 7 / 9) for i in range(n)], drift)
            assert drift == 0 or len(found) == n
            steps.append(Counted.asked / n)
    assert max(steps) < 8


def test_weights_and_decay_by_brute_force(spark):
    rows, labels, occurrences = [], [], set()
    for k in range(120):
        toxic = k % 3 == 0
        words = prose("en", 40, 300 + k).replace(".", "").split() + (["vile", "vilest", "scum"] * 3 if toxic else ["vilely"] * (k == 1))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
        if zlib.crc32(str(k).encode()) % 5:
            occurrences |= {(w, a, b, toxic) for a, w, b in zip(["", *words], words, [*words[1:], ""])}
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    count = Counter((w, t) for w, _, _, t in occurrences)
    n = {t: sum(c for (_, of), c in count.items() if of == t) for t in (True, False)}
    forms = {t: Counter() for t in n}
    for (w, t), c in count.items():
        for form in toxicity.stems(w):
            forms[t][form] += c
    weights = {}
    for form in forms[True] | forms[False]:
        y1, y0 = forms[True][form], forms[False][form]
        prior, mass = toxicity.PRIOR * (y1 + y0), toxicity.PRIOR * sum(n.values())
        odds = lambda y, n: math.log((y + prior) / (n + mass - y - prior))  # noqa: B023, E731
        w = odds(y1, n[True]) - odds(y0, n[False]) - toxicity.CAUTION * math.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
        if w > 0:
            weights[form] = round(w, 6)
    assert model.weights == pytest.approx(weights) and "vile" in weights
    tokens = {w for w, _ in count}
    best = {w: max([0.0, *(weights.get(f, 0.0) for f in toxicity.stems(w))]) for w in tokens}
    rate = {w: max(count[w, False], 0.5) / n[False] for w in tokens if best[w]}
    mean = lambda decay: (1 - sum(rate.values())) * math.exp(-decay * toxicity.DRIFT) + sum(p * math.exp(decay * best[w]) for w, p in rate.items())
    assert model.decay > 0 and abs(mean(model.decay) - 1) < 1e-4


@pytest.mark.parametrize("label,module,least", [("quality", boosted, 0.9), ("toxic", toxicity, 0.8)])
def test_held_out_labels(spark, label, module, least):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = module.classify(docs, module.train(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r[label] for r in rows]) > least


def test_pipeline(spark, corpus):
    docs = corpus
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        docs = out.cache()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(rows) == docs.count() and all(len(r.ids) == r.n_tokens for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mix", "encode"]


def test_run_against_plain_python(spark, tmp_path):
    """``run`` on a small table: which rows stay in each stage, and their ids, by plain code."""
    r = np.random.default_rng(8)
    rows = []
    for k in range(40):
        lang = "en" if k % 3 else "de"
        rows.append((k, prose(lang, 80 + k, 700 + k), lang, f"s{k % 3}"))
    rows += [(100 + k, rows[3 * k + 1][1], "en", "s0") for k in range(6)]  # exact copies
    rows += [(200 + k, " ".join([*rows[k][1].split()[:-2], "edited", "end"]), "en", "s1") for k in (5, 8)]  # near copies
    rows += [(300, "a b c", "en", "s0"), (301, "", "en", "s0"), (302, None, None, None), (303, "the same five words again " * 30, "en", "s2")]  # base rules
    rows += [(400, " ".join(f"{w}!!" for w in prose("en", 60, 800).upper().split()), "en", "s2")]  # junk by two rules
    rows += [(500, " ".join("".join(r.choice(list("жщюяфг"), 5)) for _ in range(80)), None, "s1")]  # no learned language
    rows = [(*x, len(x[1] or "")) for x in rows]
    f = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    f.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    gone = {300, 301, 302, 303, 400, 500}
    stay = [x for x in rows if x[0] not in gone]
    stay = [x for x, (_, c) in zip(stay, brute_classes([x[:2] for x in stay])) if x[0] == c]
    assert {x[0] for x in stay} == set(range(40))
    size = {x[0]: len(WORD.findall(x[1])) for x in stay}
    source = {x[0]: x[3] for x in stay}
    total = {s: sum(n for d, n in size.items() if source[d] == s) for s in set(source.values())}
    weight = dict(zip(sorted(total), (3.0, 1.0, 2.0)))
    level = {s: 1.5 * sum(total.values()) * w / sum(weight.values()) for s, w in weight.items()}
    target = dict(level)
    while over := [s for s in target if target[s] > 2 * total[s] + 1e-9]:
        capped = {s for s in target if target[s] >= 2 * total[s] - 1e-9}
        free = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        rest = sum(weight[s] for s in target if s not in capped)
        target = {s: 2.0 * total[s] if s in capped else free * weight[s] / rest for s in target}
        assert over
    expected = Counter()
    for s in total:
        whole = int(target[s] // total[s])
        left = round(target[s] - whole * total[s])
        order = sorted((d for d in size if source[d] == s), key=lambda d: hashlib.md5(f"mix-1|{d}".encode()).hexdigest())
        for d in order:
            part = max(0, min(size[d], left))
            left -= size[d]
            expected[d] += whole + (part > 0 and 2 * part >= size[d])
    expected = +expected
    assert Counter(x.doc_id for x in got) == expected
    coder = bpe.Coder.of(bpe.RANKS)
    text = {x[0]: x[1] for x in stay}
    for x in got:
        ids = [i for m in coder.pattern.finditer(text[x.doc_id]) for i in coder.piece(m.group())]
        assert list(x.ids) == ids and coder.decode(ids).decode() == text[x.doc_id]


def test_pipeline_on_an_empty_table(spark, corpus, tmp_path):
    corpus.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
