"""The search for pairs of images to verify."""

import numpy as np

from orrery.llm import image_copies
from orrery.llm.queries import op1_image_copies
from orrery.llm.scratch import Scratch


def descriptors(rng, n):
    points = np.column_stack([rng.uniform(0, 200, (n, 2)), np.ones(n), np.zeros(n)]).astype(np.float32)
    return points, rng.integers(0, 256, (n, image_copies.BITS // 8), np.uint8)


def classes(spark, images, keys):
    """Class of each of ``images`` (points, codes); ``keys`` are pairs of a bucket and the corner in it."""
    nodes = spark.createDataFrame([(i, bytearray(image_copies._pack(*x))) for i, x in enumerate(images)], "node long, features binary")
    rows = [(k, i, c << 16, 0) for i, own in enumerate(keys) for k, c in own]
    found = image_copies.classes_of(Scratch(spark, "test"), nodes, spark.createDataFrame(rows, "key long, node long, corner long, last long"))
    return [dict(map(tuple, found.collect())).get(i, i) for i in range(len(images))]


def test_a_hot_bucket_is_decided_to_its_end(spark):
    """Two copies in buckets whose other images, before and after them, are all different pictures."""
    rng = np.random.default_rng(5)
    copy = descriptors(rng, 12)
    others = [descriptors(rng, 12) for _ in range(6)]
    images = [*others[:3], copy, copy, *others[3:]]
    assert classes(spark, images, [[(1, 0), (2, 1), (3, 2)]] * 8) == [0, 1, 2, 3, 3, 5, 6, 7]


def test_two_meetings_must_agree(spark):
    """Of different corners, with one turn and scale; a chain of copies is one class."""
    rng = np.random.default_rng(7)
    copy = descriptors(rng, 12)
    assert classes(spark, [copy] * 2, [[(1, 0)]] * 2) == [0, 1]
    assert classes(spark, [copy] * 2, [[(1, 0), (2, 0)]] * 2) == [0, 1]
    assert classes(spark, [copy] * 2, [[(1, 0), (2, 1)]] * 2) == [0, 0]
    assert classes(spark, [copy] * 3, [[(1, 0), (2, 1)], [(1, 0), (2, 1), (3, 0), (4, 1)], [(3, 0), (4, 1)]]) == [0, 0, 0]
    assert classes(spark, [], []) == []


def flipped(codes, n, rng):
    """``codes`` with ``n`` bits of each flipped."""
    bits = np.unpackbits(codes, axis=1)
    for row in bits:
        row[rng.choice(image_copies.BITS, n, replace=False)] ^= 1
    return np.packbits(bits, axis=1)


def test_blocks_do_not_matter(monkeypatch):
    rng = np.random.default_rng(3)
    a = descriptors(rng, 50)
    b = a[0] + np.float32(2), flipped(a[1], 30, rng)
    b[0][:, 2:] = a[0][:, 2:]
    whole = image_copies._matches(a[1], b[1])
    points = a[0][whole[0]].astype(float), b[0][whole[1]].astype(float)
    count = image_copies._consensus(*points)
    monkeypatch.setattr(image_copies, "BLOCK", 300)
    assert all((x == y).all() for x, y in zip(whole, image_copies._matches(a[1], b[1])))
    assert image_copies._consensus(*points) == count == 50


def test_few_corners():
    """All of 5 to 7 corners must agree; fewer prove nothing."""
    rng = np.random.default_rng(8)
    for n in range(2, 9):
        few, many, other = descriptors(rng, n), descriptors(rng, 30), descriptors(rng, 30)
        many[0][:n], many[1][:n] = few
        assert image_copies.is_copy(*few, few[0], flipped(few[1], 20, rng)) == (n >= 5)
        assert not image_copies.is_copy(*few, *other)
        if n >= 5:
            assert image_copies.is_copy(*few, *many) and image_copies.is_copy(*many, *few)


def edited_grids():
    """Pictures as square grids, a third of them with one corner pattern in common, and edited copies of each."""
    rng = np.random.default_rng(9)
    stamp, out = rng.random((5, 5)), []
    for k in range(60):
        x = rng.random((12, 12))
        if k % 3 == 0:
            x[2:7, 2:7] = stamp
        out += [x, image_copies._resize(x, 9, 9), image_copies._resize(x, 14, 14)]
        if k % 15 == 0:
            out += [x + rng.normal(0, 0.06, x.shape), np.round(x * 4) / 4, np.rot90(x), x[:10, 2:]]
    return out


def test_query_against_all_pairs(spark, tmp_path):
    """At least 0.9 of the links of all pairs, and no class that all pairs do not give."""
    grids = [g.ravel().tolist() for g in edited_grids()]
    spark.createDataFrame(list(enumerate(grids)), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.class_id for r in op1_image_copies(spark, str(tmp_path)).collect()}
    found = [image_copies.corners(image_copies.grey_of_grid(g)) for g in grids]
    links = [(i, j) for j in range(len(grids)) for i in range(j) if image_copies.is_copy(*found[i], *found[j])]
    true = list(range(len(grids)))
    for i, j in links:
        true = [true[i] if c == true[j] else c for c in true]
    together = [got[i] == got[j] for i, j in links]
    print(len(links), "links,", sum(together), "found;", len(set(true)), "classes,", len(set(got.values())), "found")
    assert len(links) > 40 and np.mean(together) >= 0.9
    assert all(true[i] == true[c] for i, c in got.items())


def noisy_classes(spark, tmp_path, extra):
    """op1 on random grids of the table's size: groups of noisy copies, two to many."""
    rng = np.random.default_rng(11)
    grids, group = [], []
    for k in range(60):
        x = rng.normal(size=64)
        for c in range(1 + (k % 4) * 2 + (extra if k == 0 else 0)):
            grids.append((x + (rng.normal(0, 0.14, 64) if c else 0)).tolist())
            group.append(k)
    spark.createDataFrame(list(enumerate(grids)), "vec_id long, embedding array<double>").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.class_id for r in op1_image_copies(spark, str(tmp_path)).collect()}
    return [got[i] for i in range(len(grids))], group


def test_groups_of_noisy_copies(spark, tmp_path):
    got, group = noisy_classes(spark, tmp_path, 60)
    first = {}
    for i, k in enumerate(group):
        first.setdefault(k, i)
    assert np.mean([c == first[k] for c, k in zip(got, group)]) >= 0.95
    assert all(group[c] == k for c, k in zip(got, group))
