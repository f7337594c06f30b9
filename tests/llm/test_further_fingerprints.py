"""Further fingerprints of all rows, and how many the pipeline takes."""

import random

import corpus_pipeline

from glyphmill.llm import simhash
from tests.llm.test_operators import brute_components


def test_rows_of_one_first_fingerprint_link_by_their_own_further_ones(spark):
    rng = random.Random(4)
    far = lambda: rng.getrandbits(63)
    rows, number = [], 0
    for size in (2, 3, 40):
        first = far()
        own = [(number + k, first, [far(), far()]) for k in range(size)]
        # each row but the first meets one row in a further fingerprint only: equal, or a bit apart
        met = [(number + size + k, far(), [far(), more[1] ^ (k % 2)]) for k, (_, _, more) in enumerate(own[1:])]
        rows += own + met
        number += 2 * size
    rows.append((number, far(), [far(), far()]))
    df = spark.createDataFrame(rows, "id long, fp long, more array<long>")
    got = {r.id: r.comp for r in simhash.components_of(df, 2, further=2).collect()}
    every = {i: [fp, *more] for i, fp, more in rows}
    keys = sorted(every)
    linked = [(a, b) for n, a in enumerate(keys) for b in keys[n + 1 :] if any((x ^ y).bit_count() <= 2 for x, y in zip(every[a], every[b], strict=True))]
    assert got == brute_components(keys, linked)
    assert len(set(got.values())) == 4


def test_pipeline_links_by_16_fingerprints():
    assert corpus_pipeline.FINGERPRINTS + 1 >= 16
