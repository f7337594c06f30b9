"""The operators against brute force, exact round trips and the libraries, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import chat_format, embedding_dedup, exact_dedup, html_extract, packing, sentencepiece_codec, sharding, simhash, token_files, toxicity
from glyphmill.llm.common import tokenizer_path
from glyphmill.llm.components import components, join_roots, local_roots
from glyphmill.llm.word_tokens import load as load_tokens

WORDS = "the quick brown fox jumps over a lazy dog and runs away from every other animal in sight today".split()
ODD = [None, "", " ", "a", "A  b\tc\n\nd", "naïve façade — 日本語 😀", "<|endoftext|> x", "don't 'S 12345 ²½", "  x y", "w" * 5000, "ab " * 3000]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    """Documents with columns whose names clash with those that operators use."""
    full = [(i, t, "en", "s", 1, 2, 3, "c", True) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, h int, uid long, comp string, kept boolean")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [text(rng, rng.randint(1, 400)) for _ in range(120)]
    rows = list(enumerate(texts + ODD + texts[:30] + [texts[0]] * 40))
    return rows + [rows[3], (None, "null id"), (None, None)]


EMPTY: list = []


# --- SentencePiece ----------------------------------------------------------------------------------------------


def test_sentencepiece_equals_library(spark, corpus):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    out = sentencepiece_codec.encode(documents(spark, corpus), path, decoded=True).collect()
    assert len(out) == len(corpus)
    want = sorted((str(i), lib.encode(t or "", add_bos=True, add_eos=True), lib.decode(lib.encode(t or "", add_bos=True, add_eos=True))) for i, t in corpus)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in out) == want
    assert sentencepiece_codec.encode(documents(spark, EMPTY), path).count() == 0
    back = sentencepiece_codec.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), path)
    assert back.first() == (1, "")


def test_sentencepiece_on_random_pieces():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.load(path)
    rng = random.Random(7)
    vocabulary = list(own.ids)
    for _ in range(3000):
        t = "".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9))).replace("▁", " ")
        assert np.frombuffer(own.encode_bytes(t), "<u4").tolist() == lib.encode(t)
        ids = [rng.randrange(600 if rng.random() < 0.7 else 32000) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == lib.decode(ids)


# --- toxicity ---------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(700):
        bad = i % 4 == 0
        words = text(rng, 60).split()
        if bad:
            words[rng.randrange(60)] = rng.choice(["zonkhead", "grumblefool"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "zonkhead " * 30000), (1003, "the " * 250000 + "zonkhead"), (None, "the fox")]
    docs = documents(spark, rows)
    known = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), labels[8]], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known)
    out = {r.doc_id: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert len(out) == len(rows)
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(out[i] >= 0.5) == bool(labels[i][2]) for i in held]
    assert np.mean(right) > 0.97
    assert out[1000] == out[1001] < 0.5 and out[1002] >= 0.5 and out[1003] >= 0.5
    assert all(0 <= s <= 1 for s in out.values())
    none = toxicity.train(docs, known.where("toxic = 0"))
    assert none is None and {r["score"] for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(documents(spark, EMPTY), model, ["doc_id"]).count() == 0


def test_toxicity_spans_equal_whole():
    rng = random.Random(2)
    texts = [text(rng, 50) + (" zonk" if k % 2 else "") for k in range(80)]
    model = toxicity.fit(texts, [k % 2 for k in range(80)])
    v = toxicity.Vocabulary()
    ids = v.numbers(text(rng, 300).split())
    vectors = model.vectors[v.rows()].sum(1)
    whole = model.pooled([ids], vectors)
    before, toxicity.SPAN = toxicity.SPAN, 7
    try:
        assert np.allclose(model.pooled([ids], vectors), whole, atol=1e-6)
    finally:
        toxicity.SPAN = before


# --- sharding ---------------------------------------------------------------------------------------------------


def test_sharding(spark, corpus):
    rng = random.Random(9)
    rows = corpus + [(10_000 + k, text(rng, rng.randint(5, 60))) for k in range(3000)] + [(20_000 + k, "hot text of a third of all rows") for k in range(1500)]
    out = sharding.shard(documents(spark, rows), 16).toPandas()
    assert sorted(map(str, out["doc_id"].astype("Int64"))) == sorted(str(i) if i is not None else "<NA>" for i, _ in rows)
    by_id = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    for r in out[out["doc_id"].notna()].itertuples():
        assert (r.size, r.text_crc32) == by_id[int(r.doc_id)]
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() / sizes.min() < 1.1
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    small = out[out["text_crc32"] != zlib.crc32(b"hot text of a third of all rows")]
    apart = small.groupby("text_crc32")["shard"].nunique()
    assert (apart == 1).mean() > 0.99  # groups over one in 256 of the bytes are split, others never
    assert sharding.shard(documents(spark, EMPTY), 16).count() == 0


def test_place_is_balanced():
    rng = np.random.default_rng(0)
    sizes = rng.random((5000, 3)) ** 3
    b = sharding.place(sizes, 16)
    for k in range(3):
        load = np.bincount(b, sizes[:, k], 16)
        assert load.max() / load.min() < 1.1


# --- HTML -------------------------------------------------------------------------------------------------------


def test_blocks():
    html = """<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li>a<li>b</ul></nav>
    <!-- <p>no</p> --><p>One &amp; <b>two</b>three<br>four<p>five &lt;x&gt; <div class='ad x'>six</div></article></b> a < b"""
    assert [b.text for b in html_extract.blocks(html)] == ["a", "b", "One & twothree", "four", "five <x>", "six", "a < b"]
    assert html_extract.blocks(html)[5].path.item == "div ad x"
    for odd in ("", "<", "<p", "</", "<!--", "<script>", "<a href='x>y", "&#x26;&#0;&bogus;", "<p>" * 3000, 'x<p a="1', "<style>p{"):
        html_extract.blocks(odd)


def test_html_extraction(spark):
    rng = np.random.default_rng(8)
    texts = [text(random.Random(k), 40) for k in range(30)]
    pages, want = [], []
    for k in range(120):
        body = [texts[rng.integers(30)] for _ in range(rng.integers(1, 6))]
        html = f"<html><body><nav><ul><li>home</li><li>the fox</li></ul></nav><div class='ad'>{texts[rng.integers(30)]}</div><article><h1>fox {k}</h1>" + "".join(f"<p>{b}</p>" for b in body) + f"</article><footer>&copy; {texts[rng.integers(30)]}</footer></body></html>"
        pages.append((k, "u", html, "x"))
        want.append(" ".join([f"fox {k}", *body]))
    pages += [(500, None, None, None), (501, "u", "", ""), (None, "u", "<nav>a</nav>", ""), pages[0]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    out = html_extract.extract(df, html_extract.fit(df), ["page_id", "url"]).collect()
    got = {r.page_id: r["text"] for r in out}
    assert len(out) == len(pages)
    assert np.mean([got[k] == want[k] for k in range(120)]) > 0.95
    assert got[500] == got[501] == ""
    assert html_extract.extract(df.limit(0), html_extract.train([]), ["page_id"]).count() == 0


def test_lstm_gradients():
    rng = np.random.default_rng(1)
    m = html_extract.Labeller()
    x = rng.normal(size=(7, html_extract.PATH_DIM + html_extract.WORD_DIM + html_extract.NUMBERS))
    lengths, y = np.array([4, 3]), rng.integers(0, 2, 7).astype(float)

    def loss():
        z, _, _ = m.run(x, lengths)
        return float((np.logaddexp(0, z) - y * z).sum())

    grads, gx = m.gradients(x, lengths, y, np.ones(7))
    for name in ("wf", "wb", "zf", "zb", "v"):
        flat = m.p[name].reshape(-1)
        for k in rng.integers(0, flat.size, 4):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert grads[name].reshape(-1)[k] == pytest.approx((up - down) / 2e-5, abs=1e-4)


# --- chat -------------------------------------------------------------------------------------------------------


def render(turns, speaker):
    out, spans = "", []
    for role, said in turns:
        head = "<|assistant|>\n" if role == speaker else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
        body = said + "<|end|>\n"
        if role == speaker:
            spans.append((len(out) + len(head), len(out) + len(head) + len(body)))
        out += head + body
    return out, spans


def test_chat_perspectives(spark):
    rng = random.Random(3)
    turns = [(c, t, rng.choice(["ann", "bob", "carl", "system"]), text(rng, 5)) for c in range(20) for t in range(rng.randint(1, 9))]
    turns += [(None, 0, "ann", "x"), (None, 1, None, None), (50, None, "ann", "first"), (50, None, "bob", "b"), (51, 0, "system", "only"), turns[0], turns[0]]
    df = spark.createDataFrame([(*t, 1, "z") for t in turns], "conv_id long, turn long, role string, text string, block int, speaker string")
    got = {(r.conv_id, r.speaker): (r.text, [tuple(s) for s in r.mask], r.n_rows) for r in chat_format.perspectives(df).collect()}
    by = {}
    for c, t, role, said in turns:
        by.setdefault(c, []).append((-1 if t is None else t, role or "unknown", said or ""))
    want = {}
    for c, own in by.items():
        n, own = len(own), sorted(set(own))
        roles = {r for _, r, _ in own}
        for s in (roles - {"system"}) or roles:
            want[c, s] = (*render([(r, x) for _, r, x in own], s), n)
    assert got == want
    assert chat_format.perspectives(df.limit(0)).count() == 0


def test_chat_crowded_turns(spark):
    rows = [(1, 0, "ann" if k % 2 else "bob", f"m{k:05d}") for k in range(1500)] + [(1, 70, "ann", "late"), (2, 0, "bob", "one")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.perspectives(df).where("speaker = 'ann'").orderBy("block", "turn_key", "part").collect()
    assert sum(r.n_messages for r in out) == 1501 and max(r.n_messages for r in out) < 450
    assert sorted("".join(r.text for r in out).split("m")[1:]) and out[-1].text.startswith("<|assistant|>\nlate")


# --- exact dedup ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, corpus, weak):
    hash_expr = (lambda c: (F.length(c) % 4).cast("long")) if weak else None
    out = exact_dedup.exact_dedup(documents(spark, corpus), capacity=8, hash_expr=hash_expr).collect()
    groups = {}
    for i, t in corpus:
        groups.setdefault(t or "", []).append(i)
    assert len(out) == len(corpus)
    for r in out:
        t = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = groups[t]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_dedup(documents(spark, EMPTY)).count() == 0


def test_directory_doubles():
    counts = {k: 1 for k in range(100)}
    slots = exact_dedup.split_buckets(counts, 10, 8)
    assert [s for s, _, _, _ in slots] == list(range(len(slots)))
    assert len(slots) == 1 << max(d for _, _, d, _ in slots)
    depth = (len(slots) - 1).bit_length()
    held = {}
    for k in counts:
        held[slots[k >> (8 - depth)][1]] = held.get(slots[k >> (8 - depth)][1], 0) + 1
    assert max(held.values()) <= 10
    assert exact_dedup.split_buckets({}, 10) == [(0, 0, 0, 0)]
    assert max(d for _, _, d, _ in exact_dedup.split_buckets({5: 1000}, 10, 8)) == 8


def test_exact_dedup_keeps_rows(spark, corpus):
    out = exact_dedup.keep_rows(documents(spark, corpus))
    assert out.columns == documents(spark, []).columns
    assert out.count() == len({t or "" for _, t in corpus})


# --- packing ----------------------------------------------------------------------------------------------------


def check_pieces(rows, documents_by_key, size):
    by_sequence, by_document = {}, {}
    for key, start, length, ids, total, sequence, offset in rows:
        assert length == len(ids) // 4 > 0
        by_sequence.setdefault(sequence, []).append((offset, length))
        by_document.setdefault(key, []).append((start, ids, total))
    for own in by_sequence.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        assert own[-1][0] + own[-1][1] <= size
    for key, parts in by_document.items():
        parts.sort()
        whole = b"".join(p[1] for p in parts)
        assert whole == documents_by_key[key]
        assert parts[0][0] == 0 and all(p[2] == len(whole) // 4 for p in parts)
    assert set(by_document) == set(documents_by_key)
    return by_sequence


def test_packing(spark):
    rng = random.Random(4)
    path = tokenizer_path("word_bpe_49k.json")
    rows = [(k, text(rng, rng.choice([3, 50, 300, 900, 3000]))) for k in range(300)] + [(500 + k, t) for k, t in enumerate(ODD)]
    out = packing.pack(documents(spark, rows).repartition(5), path).collect()
    tokens = load_tokens(path)
    want = {i: np.array([*tokens.lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in rows}
    sequences = check_pieces([tuple(r) for r in out], want, 2048)
    total = sum(len(x) // 4 for x in want.values())
    assert len(sequences) * 2048 < 1.03 * total + 2 * 2048
    repeated = packing.pack(documents(spark, [(1, "a"), (1, "a"), (None, None)]), path).collect()
    assert sum(r.length for r in repeated) == 5
    assert packing.pack(documents(spark, EMPTY), path).count() == 0


def test_windows_keep_their_bound():
    rng = np.random.default_rng(6)
    w = packing.Windows(0, 64, 4, 3)
    docs = {k: rng.integers(0, 1000, rng.integers(1, 200)).astype("<u4").tobytes() for k in range(400)}
    for k, ids in docs.items():
        w.add(k, ids)
        assert len(w.open) <= 4
    rest = [(n, p) for n, p in w.open]
    packing.merge(rest, w)
    sequences = check_pieces(w.out, docs, 64)
    fills = [own[-1][0] + own[-1][1] for own in sequences.values()]
    assert sum(f < 61 for f in fills) <= 1


# --- SimHash ----------------------------------------------------------------------------------------------------


def brute_fingerprint(t, shingle=3):
    import re

    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, linked):
    label = {k: k for k in keys}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in linked:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_simhash(spark, corpus):
    rng = random.Random(8)
    rows = [(i, t) for i, t in corpus if i is not None]
    for k in range(60):
        words = rows[k][1].split(" ") if rows[k][1] else ["x"]
        words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((1000 + k, " ".join(words)))
    out = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = brute_components(ids, linked)
    assert {i: r.fp % (1 << 64) for i, r in out.items()} == fps
    assert {i: r.comp for i, r in out.items()} == want
    kept = simhash.keep_rows(documents(spark, [*rows, (None, "alone in the world"), rows[3]]))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in ids if want[i] == i)
    assert simhash.near_duplicates(documents(spark, EMPTY)).count() == 0
    assert simhash.keep_rows(documents(spark, EMPTY)).count() == 0


def test_vantage_point_shards_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = base[:800] ^ (np.uint64(1) << rng.integers(0, 63, 800).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 800).astype(np.uint64))
    dense = base[5] ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near, dense]))
    df = spark.createDataFrame([(k, int(p), []) for k, p in enumerate(points.view(np.int64))], "id long, fp long, more array<long>")
    got = {r.id: r.comp for r in simhash.components_of(df, 2, shard=200).collect()}
    linked = [(a, a + 1 + b) for a in range(len(points)) for b in np.flatnonzero(np.bitwise_count(points[a + 1 :] ^ points[a]) <= 2).tolist()]
    assert got == brute_components(range(len(points)), linked)


def test_further_fingerprints(spark):
    rng = random.Random(12)
    rows = []
    for k in range(120):
        words = text(rng, 250).split()
        rows.append((k, " ".join(f"{w}{rng.randrange(40)}" for w in words)))
    for k in range(60):
        words = rows[k][1].split()
        words[rng.randrange(250)] = "changed"
        rows.append((1000 + k, " ".join(words)))
    docs = documents(spark, rows)
    one, more = (simhash.keep_rows(docs, further=f).count() for f in (0, 7))
    assert 120 <= more <= 130 and more <= one
    keys = [i for i, _ in rows]
    own = {i: [simhash.majority(h), *(simhash.majority(simhash.remix(h, k)) for k in range(1, 8))] for i, h in ((i, simhash.shingle_hashes(t)) for i, t in rows)}
    linked = [(a, b) for n, a in enumerate(keys) for b in keys[n + 1 :] if any((x ^ y).bit_count() <= 2 for x, y in zip(own[a], own[b], strict=True))]
    assert more == len(set(brute_components(keys, linked).values()))


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 0, 200: 200, 201: 200}
    members = [(5, 5), (6, 5), (6, 6), (9, 6), (9, 8), (8, 8), (20, 20), (21, 20)]
    got = {r.node: r.comp for r in join_roots(spark.createDataFrame(members, "node long, root long")).collect()}
    assert got == {5: 5, 6: 5, 9: 5, 8: 5, 20: 20, 21: 20}
    assert local_roots(5, np.array([4, 2]), np.array([2, 1])).tolist() == [0, 1, 1, 3, 1]


# --- token files ------------------------------------------------------------------------------------------------


def test_token_files(spark, corpus):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = [r for r in corpus if r[0] is not None]
    out = token_files.round_trip(documents(spark, rows), path).collect()
    lib = load_tokens(path).lib
    assert len(out) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(i, np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    out.sort(key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted(i for i, _ in rows)
    at = 0
    for r in out:
        assert r.start == at and r.ids == by[r.doc_id]
        at += len(r.ids) // 4
    assert token_files.round_trip(documents(spark, EMPTY), path).count() == 0
    assert token_files.round_trip(documents(spark, [(None, "a"), (None, None)]), path).count() == 2


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 5000, 70000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 1 << 29, n), rng.integers(0, 3, n), np.zeros(n, int), np.minimum(rng.zipf(1.3, n), 50000), np.tile(np.arange(7), n)[:n]):
        data = token_files.to_bytes(np.arange(1), np.array([n]), ids.astype(np.int32))
        assert np.array_equal(token_files.from_bytes(data)[2], ids)


def test_coder_checks_and_blocks():
    ids = np.random.default_rng(1).integers(0, 500, 5000).astype(np.int32)
    data = bytearray(token_files.to_bytes(np.arange(1), np.array([5000]), ids))
    data[-9] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.from_bytes(bytes(data))
    values, freq, kind, payloads = token_files.encode_blocks(ids)
    third = token_files.decode_blocks(values, freq, kind, payloads[2:3], np.array([1024]))[0]
    assert np.array_equal(third, ids[2048:3072])
    same = np.tile(np.random.default_rng(2).integers(0, 40000, 300), 20).astype(np.int32)
    assert len(token_files.to_bytes(np.arange(1), np.array([len(same)]), same)) < 0.7 * 2 * len(same)


# --- embeddings -------------------------------------------------------------------------------------------------


def brute_links(vectors, least=0.9):
    ok = {i: np.array(v, float) for i, v in vectors if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(ok)
    linked = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= least:
                linked.append((a, b))
    return linked


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(250, 16))
    near = base[:120] + rng.normal(size=(120, 16)) * 0.15
    hot = base[7] + rng.normal(size=(200, 16)) * 0.05
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(np.concatenate([base, near, hot, base[:20], base[:5] * 2]))]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] * 16), (n + 4, [None] * 16), (n + 5, [float("inf")] * 16), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0])]
    df = spark.createDataFrame([(*r, 0, 5) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    before, embedding_dedup.TILE = embedding_dedup.TILE, 64
    try:
        out = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    finally:
        embedding_dedup.TILE = before
    linked = brute_links(rows)
    degree = {i: 0 for i, _ in rows}
    for a, b in linked:
        degree[a] += 1
        degree[b] += 1
    found = sum(r.n_links for r in out.values())
    assert found / sum(degree.values()) >= 0.98
    assert all(out[i].n_links <= d for i, d in degree.items())
    want = brute_components([i for i, _ in rows], linked)
    assert np.mean([out[i].comp == want[i] for i in want]) >= 0.98
    assert all(out[n + k].n_links == 0 and out[n + k].comp == n + k for k in range(6))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
