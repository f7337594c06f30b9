"""Every registered query in the columns and values that its contract names, over small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from glyphmill.llm import packing, toxicity
from glyphmill.llm.common import tokenizer_path
from glyphmill.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import ODD, brute_components, brute_fingerprint, brute_links, text


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(31)
    rows = [(k, text(rng, rng.randint(1, 300)) + (" zonkhead" if k % 6 == 0 else "")) for k in range(150)]
    rows += [(200 + k, t) for k, t in enumerate(ODD)] + [(300 + k, rows[k][1]) for k in range(20)]
    rows += [(400 + k, rows[k + 30][1].replace("fox", "cat", 1)) for k in range(20)]
    folder = tmp_path_factory.mktemp("tables")
    put = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    put([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    put([(k, 1, int(k % 6 == 0)) for k in range(150)], "doc_id long, quality int, toxic int", "labels")
    put([(k, f"u{k}", f"<nav>menu</nav><article><p>{rows[k][1]}</p></article><footer>foot</footer>") for k in range(40)] + [(90, "u", None)], "page_id long, url string, html string", "pages")
    vectors = np.random.default_rng(2).normal(size=(80, 8))
    vectors[40:60] = vectors[:20] + np.random.default_rng(3).normal(size=(20, 8)) * 0.1
    vecs = [(k, v.astype(np.float32).tolist(), 0) for k, v in enumerate(vectors)] + [(80, None, 0), (81, [0.0] * 8, 0), (82, vectors[3].astype(np.float32).tolist(), 1)]
    put(vecs, "vec_id long, embedding array<float>, label int", "embeddings")
    put([(1, 0, "ann", "hi"), (1, 1, "bob", "yes"), (2, None, None, None)], "conv_id long, turn long, role string, text string", "conversations")
    return str(folder), rows, vecs


def run(spark, tables, n):
    name = next(q for q in QUERIES if q.startswith(f"op{n}_"))
    df = QUERIES[name](spark, tables[0])
    return dict(df.dtypes), df.collect()


def little(ids):
    return np.array(ids, "<u4").tobytes()


def test_all_ten_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_op1(spark, tables):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    types, out = run(spark, tables, 1)
    assert types["n_tokens"] == "bigint"
    texts = dict(tables[1])
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        ids = lib.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(little(ids)).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def plain_score(model, words):
    """The classifier's answer one word, filter and place at a time."""
    pad = [toxicity.PAD] * (max(toxicity.WIDTHS) - 1)
    vector = lambda w: np.zeros(toxicity.DIM) if w == toxicity.PAD else model.vectors[list(toxicity.features(w))].sum(0)
    v = [vector(w) for w in [*words, *pad]]
    pooled = []
    for f in model.filters:
        for k in range(f.shape[2]):
            pooled.append(max((sum(float(v[t + i] @ f[i, :, k]) for i in range(f.shape[0])) for t in range(len(words))), default=0.0))
    pooled = np.maximum(np.array(pooled) + model.bias, 0)
    z = float(pooled @ model.weights + model.offset) - model.thresholds[toxicity.language(words)]
    return 1 / (1 + np.exp(-z))


def test_op2(spark, tables):
    types, out = run(spark, tables, 2)
    assert (types["held_out"], types["score"], types["predicted"]) == ("boolean", "double", "int")
    texts = dict(tables[1])
    assert len(out) == len(tables[1])
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    docs, labels = (spark.read.parquet(f"{tables[0]}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    for r in random.Random(1).sample(out, 25):
        words = toxicity.WORDS.findall((texts[r.doc_id] or "").lower())
        if words and len(words) < 2000:
            assert r.score == pytest.approx(plain_score(model, words), abs=1e-4)
    marked = [r for r in out if r.doc_id < 150]
    assert np.mean([r.predicted == int(r.doc_id % 6 == 0) for r in marked if r.held_out]) > 0.85


def test_op3(spark, tables):
    types, out = run(spark, tables, 3)
    assert types == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    texts = dict(tables[1])
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_op4(spark, tables):
    types, out = run(spark, tables, 4)
    assert types["n_chars"] == "bigint" and len(out) == 41
    for r in out:
        assert r.n_chars == len(r.text)
        if r.page_id < 40:
            assert r.url == f"u{r.page_id}" and r.text == tables[1][r.page_id][1]
    assert next(r.text for r in out if r.page_id == 90) == ""


def test_op6(spark, tables):
    _, out = run(spark, tables, 6)
    groups = {}
    for i, t in tables[1]:
        groups.setdefault(t or "", []).append(i)
    texts = dict(tables[1])
    for r in out:
        own = groups[texts[r.doc_id] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def plain_windows(documents, size, n_open, scrap):
    """Best fit over open windows, fullest out, told as lists of (key, start, length); also the windows open at the end."""
    windows, out = [], []
    for key, total in documents:
        at = 0
        while total - at >= size:
            out.append([(key, at, size)])
            at += size
        while at < total:
            rest = total - at
            used = [sum(p[2] for p in w) for w in windows]
            fits = [k for k in range(len(windows)) if used[k] + rest <= size]
            if fits:
                k = max(fits, key=lambda k: used[k])
                windows[k].append((key, at, rest))
                if used[k] + rest == size:
                    out.append(windows.pop(k))
                at = total
            elif len(windows) < n_open:
                windows.append([(key, at, rest)])
                at = total
            else:
                k = max(range(len(windows)), key=lambda k: used[k])
                w = windows.pop(k)
                if size - used[k] > scrap:
                    w.append((key, at, size - used[k]))
                    at += size - used[k]
                out.append(w)
    return out, windows


def test_windows_equal_a_plain_version():
    rng = np.random.default_rng(9)
    for size, n_open, scrap in ((64, 4, 3), (50, 1, 0), (64, 6, 8)):
        lengths = [int(n) for n in rng.integers(1, 150, 500)]
        w = packing.Windows(0, size, n_open, scrap)
        for k, n in enumerate(lengths):
            w.add(k, little(range(n)))
        got = {}
        for key, start, n, _, _, sequence, offset in w.out:
            got.setdefault(sequence, []).append((offset, (key, start, n)))
        out, left = plain_windows(list(enumerate(lengths)), size, n_open, scrap)
        assert [[p for _, p in sorted(got[s])] for s in sorted(got)] == out
        assert sorted([(k, s, len(i) // 4) for k, s, i, _ in p] for _, p in w.open) == sorted(left)


def test_op7(spark, tables):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    _, out = run(spark, tables, 7)
    by, sequences = {}, {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in tables[1]:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(little(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        ends = 0
        for offset, n in sorted(own):
            assert offset == ends
            ends += n
        assert ends <= 2048


def test_op8(spark, tables):
    types, out = run(spark, tables, 8)
    assert types["fingerprint"] == "string"
    own = {i: brute_fingerprint(t) for i, t in tables[1]}
    keys = sorted(own)
    linked = [(a, b) for n, a in enumerate(keys) for b in keys[n + 1 :] if (own[a] ^ own[b]).bit_count() <= 2]
    want = brute_components(keys, linked)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {i: (f"{own[i]:016x}", want[i]) for i in keys}


def test_op9(spark, tables):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    types, out = run(spark, tables, 9)
    assert (types["start"], types["n_tokens"], types["ids_crc32"]) == ("bigint",) * 3
    got, at = {r.doc_id: r for r in out}, 0
    for i, t in sorted(tables[1]):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(little(ids)))
        at += len(ids)


def test_op10(spark, tables):
    types, out = run(spark, tables, 10)
    assert types == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    rows = [(i, v) for i, v, _ in tables[2]]
    linked = brute_links(rows)
    want = brute_components([i for i, _ in rows], linked)
    assert len(linked) >= 15
    for r in out:
        assert (r.n_links, r.component_id, r.kept) == (sum(r.vec_id in p for p in linked), want[r.vec_id], r.vec_id == want[r.vec_id])
