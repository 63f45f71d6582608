"""The search in blocks of images: no row per meeting, and the links of all pairs, however they are dealt."""

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import image_copies
from orrery.llm.scratch import Scratch

from .test_image_search import descriptors, flipped


class Watched(Scratch):
    """Keeps the plans of what is written."""

    plans: list[str] = []

    def keep(self, frame, name):
        self.plans.append(frame._jdf.queryExecution().analyzed().toString())
        return super().keep(frame, name)


def images():
    """Different pictures, two groups of edited copies, and for each its buckets: some of all, some of its group."""
    rng = np.random.default_rng(4)
    out, group = [], []
    for g, size in ((0, 5), (1, 4), *((k, 1) for k in range(2, 14))):
        points, codes = descriptors(rng, 12)
        for c in range(size):
            out.append((points, flipped(codes, 8 if c else 0, rng)))
            group.append(g)
    keys = [[(1, 0), (2, 1), *[(10 * g + 100 + c, c) for c in range(3)]] for g in group]
    return out, group, keys


def test_no_row_per_meeting(spark):
    found, group, keys = images()
    nodes = spark.createDataFrame([(i, bytearray(image_copies._pack(*x))) for i, x in enumerate(found)], "node long, features binary")
    rows = spark.createDataFrame([(k, i, c << 16, 0) for i, own in enumerate(keys) for k, c in own], "key long, node long, corner long, last long")
    got = dict(map(tuple, image_copies.classes_of(Watched(spark, "test"), nodes, rows).collect()))
    assert [got.get(i, i) for i in range(len(found))] == [group.index(g) for g in group]
    assert Watched.plans and not any("Join" in line and "key#" in line for plan in Watched.plans for line in plan.splitlines())


@pytest.mark.parametrize("meetings", [1, 40, 1 << 21])
@pytest.mark.parametrize("two", [False, True])
def test_few_meetings_at_a_time(monkeypatch, meetings, two):
    monkeypatch.setattr(image_copies, "MEETINGS", meetings)
    found, group, keys = images()
    n = len(found)
    side = np.arange(n) % 2 if two else np.zeros(n, np.int64)
    packed = [np.array([(k, c << 16, 0) for k, c in own], np.int64).tobytes() for own in keys]
    table = pa.table([pa.array(np.arange(n)), pa.array(side), pa.array([image_copies._pack(*x) for x in found], pa.binary()), pa.array(packed, pa.binary())], names=["node", "side", "features", "buckets"])
    classes = list(range(n))
    for a, b in zip(*image_copies._search(table).to_pydict().values()):
        assert a < b and (not two or side[a] != side[b])
        classes = [classes[a] if c == classes[b] else c for c in classes]
    assert len(set(classes)) == len(set(group)) and all((classes[i] == classes[j]) == (group[i] == group[j]) for i in range(n) for j in range(n))
