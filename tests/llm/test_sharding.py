"""Sharding: its packing against a plain version, levels of cells, ids of all kinds, and the same result for any partitioning."""

import random

import numpy as np
import pytest

from glyphmill.llm import sharding


def plain_place(sizes, bins):
    """One item after the other, one bin after the other, in plain numbers."""
    total = [sum(s[k] for s in sizes) or 1e-12 for k in range(3)]
    left = [[1.0] * 3 for _ in range(bins)]
    out = []
    for s in sizes:
        part = [max(s[k], 0) / (total[k] / bins) for k in range(3)]
        best, at = None, 0
        for b in range(bins):
            dot = sum(left[b][k] * part[k] for k in range(3))
            if best is None or dot > best + 1e-9:
                best, at = dot, b
        out.append(at)
        left[at] = [left[at][k] - part[k] for k in range(3)]
    return out


def test_place_equals_a_plain_version():
    rng = np.random.default_rng(8)
    for n, bins in ((1, 4), (7, 4), (60, 5), (300, 16)):
        sizes = rng.integers(1, 1000, (n, 3)).astype(float)
        assert sharding.place(sizes, bins).tolist() == plain_place(sizes.tolist(), bins)


def rows_of(n, seed=2):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(["red", "green", "blue", "x" * 40], k=rng.randint(0, 60)))) for k in range(n)]


@pytest.mark.parametrize("kind", ["int", "long", "smallint", "string"])
def test_null_ids_of_any_kind(spark, kind):
    put = str if kind == "string" else int
    rows = [(put(k), t) for k, t in rows_of(60)] + [(None, "a text"), (None, None), (None, "a text")]
    if kind == "string":
        rows.append(("", "an empty id"))
    got = sharding.shard(spark.createDataFrame(rows, f"doc_id {kind}, text string"), 4).collect()
    key = lambda i: (i is not None, str(i))
    assert sorted((r.doc_id for r in got), key=key) == sorted((i for i, _ in rows), key=key)
    with pytest.raises(TypeError):
        sharding.shard(spark.createDataFrame([(1.5, "x")], "doc_id double, text string"))


def test_the_same_for_any_partitioning(spark):
    rows = rows_of(300) + [(5, "hot")] * 400 + [(900 + k, "hot") for k in range(200)]
    tables = [spark.createDataFrame(r, "doc_id long, text string").repartition(n) for r, n in ((rows, 1), (rows[::-1], 7))]
    a, b = ([tuple(r) for r in sharding.shard(t, 4, cell_rows=100).collect()] for t in tables)
    assert sorted(a) == sorted(b)


def test_levels_of_cells(spark):
    rows = rows_of(2000) + [(5, "one row again and again")] * 700
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4, cell_rows=100, group_rows=300, fan=3).toPandas()
    assert len(out) == len(rows)
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 4 and sizes.max() / sizes.min() < 1.1
    assert out.groupby(["shard", "slot"]).size().max() == 1
