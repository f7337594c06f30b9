"""What only large inputs reach: crowded shards, buckets deeper than the directory; and columns named as operators name theirs."""

import random

import pytest

from glyphmill.llm import common, exact_dedup, simhash, toxicity
from tests.llm.test_operators import brute_components


@pytest.mark.parametrize("further", [0, 1])
def test_crowded_shards_lose_no_link(spark, further):
    rng = random.Random(12)
    base = rng.getrandbits(62)
    rows = [(k, base ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)), [rng.getrandbits(62)] * further) for k in range(160)]  # no vantage point parts these
    rows += [(1000 + k, rng.getrandbits(62), [rng.getrandbits(62)] * further) for k in range(60)]
    got = {r.id: r.comp for r in simhash.components_of(spark.createDataFrame(rows, "id long, fp long, more array<long>"), 2, shard=40, further=further, crowd=30).collect()}
    own = {i: [fp, *more] for i, fp, more in rows}
    keys = sorted(own)
    linked = [(a, b) for n, a in enumerate(keys) for b in keys[n + 1 :] if any((x ^ y).bit_count() <= 2 for x, y in zip(own[a], own[b], strict=True))]
    assert linked and got == brute_components(keys, linked)


def test_buckets_go_on_doubling_within_a_slot(spark):
    rows = [(k, f"text {k % 700}") for k in range(1000)]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), capacity=10, max_depth=2).collect()
    assert len(out) == 1000 and sum(r.kept for r in out) == 700
    assert all(r.keep_id == max(i for i, t in rows if t == f"text {r.doc_id % 700}") for r in out)
    buckets = [r.bucket for r in out if r.group_size > 1 and r.kept]
    assert len(set(buckets)) > 16 and max(map(buckets.count, buckets)) <= 25
    assert exact_dedup.split_buckets({5: 1000}, 10, 8)[5 << 0][3] == 7


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "row", "_row", "own", "ROW2", "comp", "n", "rows", "score", "text_read", "fp", "node", "bucket", "h", "uid", "__row", "__id", "__score", "__text"]
    rows = [(k, "a text of some words" if k < 5 else f"another {k} text {k * 7} of {k * 3} words", *range(18)) for k in range(12)]
    df = spark.createDataFrame(rows, names)
    for out, n in ((exact_dedup.keep_rows(df), 8), (simhash.keep_rows(df, further=1), None), (toxicity.score(df, None, names, name=common.free_name(df, "score")), 12)):
        assert out.columns[: len(names)] == names
        got = out.collect()
        assert n is None or len(got) == n
        assert all(tuple(r)[2:20] == tuple(range(18)) for r in got)


def test_release_deletes_this_applications_tables_only(spark):
    table = common.materialize(spark.range(3).toDF("x"), "kept-no-longer")
    assert table.count() == 3
    assert spark.sparkContext.applicationId in common.shared_path(spark, "x")
