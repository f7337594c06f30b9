"""The pipeline stage by stage against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest

from glyphmill.llm import simhash
from glyphmill.llm.common import tokenizer_path
from glyphmill.llm.word_tokens import load as load_tokens
from tests.llm.test_operators import brute_components, text


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    rows, labels = [], []
    for k in range(400):
        words = [f"{w}{rng.randrange(30)}" for w in text(rng, 120).split()]
        if k % 8 == 0:
            words[rng.randrange(120)] = "zonkhead"
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 8 == 0)))
    rows += [(1000 + k, rows[k][1]) for k in range(40)]
    for k in range(50, 80):
        words = rows[k][1].split()
        words[60] = "changed"
        rows.append((2000 + k, " ".join(words)))
    rows += [(3000, None), (3001, ""), rows[1], (None, "no id")]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_stages(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    stages = dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == columns
    got = [(r.doc_id, r.text) for r in clean.collect()]
    bad = {(i, t) for i, t in rows if t and "zonkhead" in t}
    assert sum(r in bad for r in got) <= 0.02 * len(bad) and len(got) >= 0.98 * (len(rows) - len(bad))

    unique = stages["exact_dedup"](spark, clean, folder)
    assert unique.columns == columns
    want = {}
    for i, t in got:
        want[t or ""] = max(want.get(t or "", -1), -1 if i is None else i)
    kept = [(r.doc_id, r.text) for r in unique.collect()]
    assert sorted((t or "", -1 if i is None else i) for i, t in kept) == sorted(want.items())

    apart = stages["simhash_dedup"](spark, unique, folder)
    assert apart.columns == columns
    f = corpus_pipeline.FINGERPRINTS
    own = {(-1 if i is None else i): [simhash.majority(h), *(simhash.majority(simhash.remix(h, k)) for k in range(1, f + 1))] for i, t in kept for h in [simhash.shingle_hashes(t or "")]}
    keys = sorted(own)
    linked = [(a, b) for n, a in enumerate(keys) for b in keys[n + 1 :] if any((x ^ y).bit_count() <= 2 for x, y in zip(own[a], own[b], strict=True))]
    comps = brute_components(keys, linked)
    stays = [(r.doc_id, r.text) for r in apart.collect()]
    assert len(linked) >= 20
    assert sorted(-1 if i is None else i for i, _ in stays) == sorted(i for i in keys if comps[i] == i)

    packed = stages["packing"](spark, apart, folder).collect()
    lib = load_tokens(tokenizer_path("word_bpe_49k.json")).lib
    parts = {}
    for r in packed:
        parts.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in parts.items()} == {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in stays}


def test_run_equals_stages(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    a = docs.groupBy("doc_id").agg({"length": "sum"}).collect()
    b = corpus_pipeline.run(spark, folder).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
