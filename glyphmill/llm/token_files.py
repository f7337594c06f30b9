"""Binary files of token ids: an adaptive context-mixing range coder in blocks that are reset and checksummed.

Three adaptive predictions share the range of the coder. The order-2 and the order-1 context each predict the id that
followed the same context last in the block; a slot names its context, so contexts that meet in a slot are told apart.
Their confidence grows as predictions hold, and each confidence has an adaptive probability. What they leave goes to
order 0: the file's ids are dealt to CLASSES of ids that occur in the same blocks (as those of a language do); the
shares of the classes adapt with each id of the block, and within a class ids have the frequencies of the file. Every
block starts from the same state, so any block is decoded on its own after the file's head; its CRC-32 (of the ids as
little-endian 32-bit integers) is checked. All blocks of a file are coded in step, one numpy lane each.

File (all integers little-endian)::

    b"GMTK" version:u32 documents:u64 ids:u64 block:u32 vocabulary:u32
    its distinct ids, each less the one before:u32 * vocabulary, their frequencies (of 2**15 in a class):u32 * vocabulary,
    their classes:u8 * vocabulary, zlib-compressed, behind its length:u32
    document ids:i64 * documents, lengths:u64 * documents, zlib-compressed, behind its length:u32
    payload lengths in 16-bit words:u32 * blocks, CRC-32 of the blocks:u32 * blocks
    payloads: u16 words

Ids must be below 2**29, and a file has at most 2**17 different ones.

Defined results: a null or empty text has its end id alone. A text of any length is one document, which may make a file
as long as itself; files are cut between documents. Rows are all kept: rows of equal ids follow each other in the order
of the input; a null id comes first and is read back as null. An empty table makes no file and reads back as no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import BROADCAST_ROWS, materialize, parallelism, shared_path, size_of, text_or_empty
from glyphmill.llm.remember import claim, give_back

MAGIC, VERSION = b"GMTK", 2
#: Ids to a block and to a file, about.
BLOCK, FILE_IDS = 1024, 4_000_000
#: Bytes of the input, as it is stored, to a partition.
PART_BYTES = 64 << 20
#: Classes of ids, and bits of: the shares of the predictions, the shares of the classes, the frequencies in a class.
CLASSES, SHARES, SPREAD, WITHIN = 8, 11, 13, 15
#: What a class keeps at least (of 2**SPREAD), and the bits by which shares of classes move towards an id's class.
#: LEAST >= 2**RATE, else rounding could take a class's last share.
LEAST, RATE = 32, 5
_ORDER0 = SPREAD + WITHIN
#: Lines of a block's context table, of 8 slots for order 1 and 8 for order 2 each: 256 slots of either order.
LINES = 32
#: Ids below it are looked up in arrays, others searched for.
SMALL = 1 << 22
_U = np.uint64
#: Below it, the range of the coder gives out 16 bits.
_LEAST_RANGE = _U(1 << 48)
#: First probabilities (of 2**SHARES) of a prediction by its confidence, 0 to 3; none without a prediction.
_FIRST = (0, 500, 1100, 1600)
#: What a prediction that holds adds to its probability, of which a 16th goes each time: at most 16 times as much.
_GAIN = 121
#: The borders between the classes' shares: their least places, and what is added to those above an id's class.
_PLACE = (np.arange(CLASSES + 1) * LEAST).astype(np.int16)[:, None]
_ABOVE = np.int16((1 << SPREAD) - CLASSES * LEAST)
_NUMBER = np.arange(CLASSES + 1, dtype=np.int16)[:, None]


class _Lanes:
    """The model of all blocks of a file; each step sees one id of each block. Row 0 is order 1, row 1 is order 2.

    ``ids`` here are the numbers of the file's distinct ids. A lane's table has LINES lines of 64 bytes; the last id
    chooses the line, where half of the slots are of order 1 and half of order 2, so a step touches one line of a lane.
    """

    def __init__(self, n: int):
        self.lanes = lanes = np.arange(n, dtype=np.int64)
        self.base = np.stack([lanes * (LINES * 16), lanes * (LINES * 16) + 8])
        room = np.zeros(n * LINES * 16 + 16, dtype=np.int32)
        skip = (-room.ctypes.data // 4) % 16
        self.table = room[skip : skip + n * LINES * 16]  # id << 10 | confidence << 8 | check; confidence 0: nothing yet
        self.trust = np.tile(np.array(_FIRST, dtype=np.int32), 2 * n)
        self.lane4 = np.arange(2 * n, dtype=np.int64).reshape(2, n) * 4
        even = _NUMBER.astype(np.int64) << SPREAD
        self.border = np.repeat((even // CLASSES).astype(np.int16), n, axis=1)

    def predict(self, last: np.ndarray, before: np.ndarray) -> None:
        """Shares of the predictions in the first lanes, of their last two ids."""
        m = len(last)
        mixed = np.empty((2, m), dtype=np.int32)
        np.multiply(last, np.int32(-1640531535), out=mixed[0])
        np.multiply(before, np.int32(-2048144777), out=mixed[1])
        mixed[1] += mixed[0]
        mixed ^= mixed >> 15
        place = mixed & 7
        place += (mixed[0] >> 3 & (LINES - 1)) << 4
        self.at = at = self.base[:, :m] + place
        self.check = check = (mixed >> 12) & 255
        entry = self.table.take(at)
        self.trusted = c = ((entry >> 8) & 3) * ((entry & 255) == check)
        self.ids = ids = np.where(c, entry >> 10, np.int32(-1))
        self.key = self.lane4[:, :m] + c
        self.p = p = self.trust.take(self.key)
        self.share2 = p[1]
        left = (1 << SHARES) - p[1]
        self.share1 = ((left * p[0]) >> SHARES) * (ids[0] != ids[1])
        self.share0 = left - self.share1  # more than 0: no probability gets to 1

    def update(self, now: np.ndarray, kind: np.ndarray, hit: np.ndarray) -> None:
        """``hit``: whether each prediction is ``now``, an id of class ``kind``."""
        p, m = self.p, len(now)
        self.trust[self.key] = p - (p >> 4) + hit * np.int32(_GAIN)  # from 16 on it sinks no more
        entry = (np.minimum(self.trusted, 2) * hit + 1) << 8
        entry += self.check
        entry += now << 10
        self.table[self.at] = entry
        border = self.border[1:CLASSES, :m]
        goal = (kind < _NUMBER[1:CLASSES]) * _ABOVE
        goal += _PLACE[1:CLASSES]
        goal -= border
        goal >>= RATE
        border += goal


def _symbols(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    if values[-1] < SMALL:
        by_id = np.zeros(int(values[-1]) + 1, dtype=np.int32)
        by_id[values] = np.arange(len(values), dtype=np.int32)
        return by_id.take(ids)
    return np.searchsorted(values, ids).astype(np.int32)


def _classes(symbols: np.ndarray, counts: np.ndarray, block: int) -> np.ndarray:
    """A class for each distinct id: blocks are parted by their commonest ids, an id goes where it is most frequent."""
    n = -(-len(symbols) // block)
    common = np.argsort(-counts, kind="stable")[:256]
    rank = np.full(len(counts), len(common), dtype=np.int32)
    rank[common] = np.arange(len(common))
    key = rank.take(symbols)
    key += np.repeat(np.arange(n, dtype=np.int32) * np.int32(len(common) + 1), block)[: len(symbols)]
    table = np.bincount(key, minlength=n * (len(common) + 1)).reshape(n, -1)[:, :-1]
    table = np.sqrt(table.astype(np.float32))
    table /= np.maximum(np.sqrt((table * table).sum(1, keepdims=True)), 1e-9)
    centres = table[[0]]
    for _ in range(CLASSES - 1):  # each next centre is the block farthest from those before
        centres = np.concatenate([centres, table[[np.argmin((table @ centres.T).max(1))]]])
    for _ in range(6):
        group = np.argmax(table @ centres.T, axis=1)
        sums = (group == np.arange(CLASSES)[:, None]).astype(np.float32) @ table
        centres = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-9)
    key = np.repeat(group.astype(np.int32) * np.int32(len(counts)), block)[: len(symbols)]
    key += symbols
    each = np.bincount(key, minlength=CLASSES * len(counts)).reshape(CLASSES, -1)
    total = each.sum(1, keepdims=True)
    kind = np.argmax((each + 0.5 * counts / len(symbols)) / (total + 0.5), axis=0)
    if np.bincount(kind, minlength=CLASSES).max() > 1 << (WITHIN - 1):
        kind = np.arange(len(counts)) % CLASSES
    return kind.astype(np.uint8)


def _frequencies(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, their frequencies of 2**WITHIN in their class, each at least 1, their classes, the ids' numbers."""
    if len(ids) and ids.max() < SMALL:
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        counts = counts[values]
    else:
        values, counts = np.unique(ids, return_counts=True)
    if len(values) and values[-1] >= 1 << 29:
        raise ValueError("ids must be below 2**29")
    if len(values) > CLASSES << (WITHIN - 1):
        raise ValueError("too many different ids in a file")
    symbols = _symbols(ids, values)
    kind = _classes(symbols, counts, block)
    freq = np.zeros(len(values), dtype=np.int64)
    for k in range(CLASSES):
        own = np.flatnonzero(kind == k)
        if len(own):
            f = 1 + (counts[own] * ((1 << WITHIN) - len(own))) // counts[own].sum()
            f[np.argmax(f)] += (1 << WITHIN) - f.sum()
            freq[own] = f
    return values, freq, kind, symbols


def _starts(freq: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where each id's frequency begins in its class."""
    order = np.argsort(kind, kind="stable")
    ends = np.cumsum(freq[order])
    start = np.empty(len(freq), dtype=np.int64)
    start[order] = (ends - freq[order]) % (1 << WITHIN)  # each class before has 2**WITHIN
    return start


def _carry(words: np.ndarray, at: np.ndarray, n: int) -> None:
    """Add one to the words before these places, n apart, and on to those before where a word is full."""
    while len(at):
        at = at - n
        words[at] += np.uint16(1)
        at = at[words[at] == 0]


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct ids, their frequencies and classes, and the words of each block."""
    values, freq, kind, symbols = _frequencies(ids, block)
    start0 = _starts(freq, kind)
    n = -(-len(ids) // block)
    last_size = len(ids) - (n - 1) * block
    grid = np.zeros(n * block, dtype=np.int32)
    grid[: len(ids)] = symbols
    steps = np.ascontiguousarray(grid.reshape(n, block).T)
    kinds, place0 = kind.astype(np.int16), start0 << 16 | freq
    lanes = _Lanes(n)
    flat_border = lanes.border.reshape(-1)
    low, rng = np.zeros(n, dtype=np.uint64), np.full(n, (1 << 64) - 1, dtype=np.uint64)
    words = np.zeros((3 * block + 8, n), dtype=np.uint16)  # lanes are in step, so their next words are near each other
    fill = np.arange(n, dtype=np.int64)  # where the next word of each lane goes
    flat, none = words.reshape(-1), np.zeros(n, dtype=np.int32)
    for t in range(block):
        m = n if t < last_size else n - 1  # only the last block may be short
        if not m:
            break
        now = steps[t, :m]
        lanes.predict(steps[t - 1, :m] if t else none[:m], steps[t - 2, :m] if t > 1 else none[:m])
        hit = lanes.ids == now
        index = now.astype(np.int64)
        own, both = kinds.take(index), place0.take(index)
        at = lanes.lanes[:m] + own * np.int64(n)
        begin = flat_border.take(at)
        share0 = lanes.share0.astype(np.int64)
        share = share0 * (flat_border.take(at + n) - begin)
        start = share * (both >> 16)
        start += ((share0 * begin) << WITHIN) + (((1 << SHARES) - share0) << _ORDER0)
        width = share * (both & 0xFFFF)
        at = np.flatnonzero(hit[1] | (hit[0] & (lanes.share1 > 0)))
        two = hit[1, at]
        share2 = lanes.share2[at].astype(np.int64) << _ORDER0
        start[at] = share2 * ~two
        width[at] = np.where(two, share2, lanes.share1[at].astype(np.int64) << _ORDER0)
        unit = rng[:m] >> _U(SHARES + _ORDER0)
        lo = low[:m] + unit * start.view(np.uint64)
        rg = unit * width.view(np.uint64)
        _carry(flat, fill[np.flatnonzero(lo < low[:m])], n)
        out = rg < _LEAST_RANGE
        flat[fill[:m]] = (lo >> _U(48)).astype(np.uint16)  # overwritten by the next where it isn't given out
        fill[:m] += out * n
        shift = out * _U(16)
        lo <<= shift
        rg <<= shift
        at = np.flatnonzero(rg < _LEAST_RANGE)
        while len(at):  # those that gave out a word may give out another
            x = lo[at]
            flat[fill[at]] = (x >> _U(48)).astype(np.uint16)
            fill[at] += n
            lo[at] = x << _U(16)
            rg[at] <<= _U(16)
            at = at[rg[at] < _LEAST_RANGE]
        low[:m], rng[:m] = lo, rg
        lanes.update(now, own, hit)
    for k in range(4):  # the rest of low
        flat[fill] = ((low >> _U(48 - 16 * k)) & _U(0xFFFF)).astype(np.uint16)
        fill += n
    ends = fill // n
    rows = np.ascontiguousarray(words[: ends.max()].T)
    return values, freq, kind, [row[:end] for row, end in zip(rows, ends.tolist(), strict=True)]


def decode_blocks(values: np.ndarray, freq: np.ndarray, kind: np.ndarray, payloads: list[np.ndarray], sizes: np.ndarray) -> list[np.ndarray]:
    """The ids of each block; the blocks may be any of a file's."""
    if not len(payloads):
        return []
    order = np.argsort(-np.asarray(sizes), kind="stable")
    sizes = np.asarray(sizes)[order]
    n, longest = len(order), int(sizes[0])
    freq = freq.astype(np.int64)
    place0, kinds = _starts(freq, kind) << 16 | freq, kind.astype(np.int16)
    inverse = np.zeros(CLASSES << WITHIN, dtype=np.int32)
    by_class = np.argsort(kind, kind="stable")
    places = np.repeat(kind[by_class].astype(np.int64) << WITHIN, freq[by_class])
    inverse[places + np.arange(len(places)) % (1 << WITHIN)] = np.repeat(by_class, freq[by_class])
    lengths = np.array([len(payloads[i]) for i in order])
    rows = np.zeros((n, lengths.max() + 8), dtype=np.uint16)
    for k, i in enumerate(order):
        rows[k, : lengths[k]] = payloads[i]
    words = np.ascontiguousarray(rows.T)
    del rows
    flat = words.reshape(-1)
    fill = np.arange(4 * n, 5 * n, dtype=np.int64)  # where the next word of each lane comes from
    head = words[:4].astype(np.uint64)
    code = (head[0] << _U(48)) | (head[1] << _U(32)) | (head[2] << _U(16)) | head[3]
    rng = np.full(n, (1 << 64) - 1, dtype=np.uint64)
    ids = np.zeros((longest + 2, n), dtype=np.int32)
    lanes = _Lanes(n)
    flat_border = lanes.border.reshape(-1)
    live = np.searchsorted(-sizes, -np.arange(longest), side="left").tolist()  # lanes with more than t ids
    for t in range(longest):
        m = live[t]
        lanes.predict(ids[t + 1, :m], ids[t, :m])
        unit = rng[:m] >> _U(SHARES + _ORDER0)
        value = (code[:m] // unit).view(np.int64)
        share0 = lanes.share0.astype(np.int64)
        taken = ((1 << SHARES) - share0) << _ORDER0
        rest = (np.maximum(value - taken, 0) / share0).astype(np.int64)  # in the shares of the classes; exact below 2**53
        part = np.minimum(rest >> WITHIN, (1 << SPREAD) - 1).astype(np.int16)
        own = (part >= lanes.border[1:CLASSES, :m]).view(np.int8).sum(0, dtype=np.int16)
        at = lanes.lanes[:m] + own * np.int64(n)
        begin = flat_border.take(at)
        share = (flat_border.take(at + n) - begin).astype(np.int64)
        begin = begin.astype(np.int64) << WITHIN
        place = np.minimum(((rest - begin) / share).astype(np.int64), (1 << WITHIN) - 1)
        place += own * np.int64(1 << WITHIN)
        now = inverse.take(place)
        share *= share0
        both = place0.take(now)
        start = share * (both >> 16)
        start += share0 * begin + taken
        width = share * (both & 0xFFFF)
        at = np.flatnonzero(value < taken)
        share2 = lanes.share2[at].astype(np.int64) << _ORDER0
        two = value[at] < share2
        guess = np.where(two, lanes.ids[1, at], lanes.ids[0, at])
        now[at] = guess
        own[at] = kinds.take(guess)
        start[at] = share2 * ~two
        width[at] = np.where(two, share2, taken[at] - share2)
        cd = code[:m] - unit * start.view(np.uint64)
        rg = unit * width.view(np.uint64)
        out = rg < _LEAST_RANGE
        shift = out * _U(16)
        cd <<= shift
        cd |= flat.take(fill[:m]) * out
        fill[:m] += out * n
        rg <<= shift
        at = np.flatnonzero(rg < _LEAST_RANGE)
        while len(at):
            cd[at] = (cd[at] << _U(16)) | flat[fill[at]]
            fill[at] += n
            rg[at] <<= _U(16)
            at = at[rg[at] < _LEAST_RANGE]
        code[:m], rng[:m] = cd, rg
        ids[t + 2, :m] = now
        lanes.update(now, own, lanes.ids == now)
    got = [np.zeros(0, np.int32)] * n
    columns = np.ascontiguousarray(values.astype(np.int32).take(ids[2:]).T)
    for k, i in enumerate(order):
        got[i] = columns[k, : sizes[k]]
    return got


def to_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A file of documents in their order."""
    if len(ids):
        values, freq, kind, payloads = encode_blocks(ids, block)
    else:
        values, freq, kind, payloads = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint8), []
    crc = [zlib.crc32(ids[i : i + block].astype("<u4").tobytes()) for i in range(0, len(ids), block)]
    head = zlib.compress(np.diff(values, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes() + kind.tobytes())
    index = zlib.compress(np.asarray(doc_ids).astype("<i8").tobytes() + np.asarray(lengths).astype("<u8").tobytes())
    return b"".join([
        MAGIC, struct.pack("<IQQII", VERSION, len(doc_ids), len(ids), block, len(values)),
        struct.pack("<I", len(head)), head, struct.pack("<I", len(index)), index,
        np.array([len(p) for p in payloads], dtype="<u4").tobytes(), np.array(crc, dtype="<u4").tobytes(),
        *(p.astype("<u2").tobytes() for p in payloads),
    ])


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a file; raises ValueError where a block's checksum is wrong."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    version, n_docs, n_ids, block, n_values = struct.unpack_from("<IQQII", data, 4)
    if version != VERSION:
        raise ValueError(f"version {version}")
    at = 4 + struct.calcsize("<IQQII")
    (size,) = struct.unpack_from("<I", data, at)
    head = zlib.decompress(data[at + 4 : at + 4 + size])
    values, freq = np.frombuffer(head[: 8 * n_values], "<u4").astype(np.int64).reshape(2, -1)
    kind = np.frombuffer(head[8 * n_values :], np.uint8)
    at += 4 + size
    (size,) = struct.unpack_from("<I", data, at)
    index = zlib.decompress(data[at + 4 : at + 4 + size])
    at += 4 + size
    doc_ids, lengths = np.frombuffer(index[: 8 * n_docs], "<i8"), np.frombuffer(index[8 * n_docs :], "<u8").astype(np.int64)
    n = -(-n_ids // block)
    words = np.frombuffer(data, "<u4", n, at).astype(np.int64)
    crc = np.frombuffer(data, "<u4", n, at + 4 * n)
    at += 8 * n
    ends = at + 2 * np.cumsum(words)
    payloads = [np.frombuffer(data, "<u2", w, e - 2 * w) for w, e in zip(words.tolist(), ends.tolist(), strict=True)]
    sizes = np.full(n, block)
    if n:
        sizes[-1] = n_ids - (n - 1) * block
    blocks = decode_blocks(np.cumsum(values), freq, kind, payloads, sizes)
    for k, ids in enumerate(blocks):
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc[k]:
            raise ValueError(f"block {k} is damaged")
    return doc_ids, lengths, np.concatenate(blocks) if blocks else np.zeros(0, np.int32)


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file under another name first, so that a lost attempt leaves no half file under this one."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(draft := f"{path}/_{name}-{uuid.uuid4().hex}") as f:
        f.write(data)
    store.move(draft, f"{path}/{name}")


def write_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` and write them in ascending order of ids to files in ``folder``.

    Returns a table of the files: file, first (ids in all files before), documents, ids, bytes. A null id comes first, as
    the smallest of longs; documents with equal ids are in the order of the input.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), text_or_empty(text_col).alias("text"))
    parts = max(parallelism(spark), -(-size_of(docs) // PART_BYTES))
    # the row's place in the input splits up the rows of one id, however many, and needs no text where the ranges are sampled
    sorted_docs = texts.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, "id", "place").sortWithinPartitions("id", "place").select("id", "text")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from glyphmill.llm.word_tokens import load

        tokens, part = load(tokenizer_path), TaskContext.get().partitionId()
        claim(tokens.known)
        keys: list[int] = []
        parts: list[bytes] = []
        count = k = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, parts, count, k
            lengths = np.array([len(p) // 4 for p in parts])
            data = to_bytes(np.array(keys, dtype=np.int64), lengths, np.frombuffer(b"".join(parts), "<u4"))
            _put(folder, name := f"part-{part:06d}-{k:06d}.gmtk", data)
            row = [[part], [k], [name], [len(keys)], [count], [len(data)]]
            keys, parts, count, k = [], [], 0, k + 1
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.int64()), pa.array(row[2]), *(pa.array(r, pa.int64()) for r in row[3:])], names=["part", "k", "file", "documents", "ids", "bytes"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                for key, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    keys.append(key)
                    parts.append(tokens.encode_bytes(text) + end)
                    count += len(parts[-1]) // 4
                    if count >= FILE_IDS:
                        yield flush()
        if keys:
            yield flush()
        give_back()

    files = materialize(sorted_docs.mapInArrow(run, "part long, k long, file string, documents long, ids long, bytes long"), "token-files")
    # running sums over the partitions' totals, one row each, and over the files within a partition
    upto = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = files.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", upto(Window.orderBy("part")).alias("before"))
    first = F.col("before") + upto(Window.partitionBy("part").orderBy("k"))
    return files.join(totals, "part").select("file", first.alias("first"), "documents", "ids", "bytes")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """file, id, at (ids in the file before the document's), ids (binary) of all documents of the files in ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py().rsplit("/", 1)[-1]
                keys, lengths, ids = from_bytes(batch.column(1)[i].as_py())
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                for lo in range(0, len(keys), 1000):
                    hi = min(lo + 1000, len(keys))
                    cut = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends[lo:hi].tolist(), lengths[lo:hi].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * (hi - lo)), pa.array(keys[lo:hi]), pa.array((ends - lengths)[lo:hi]), pa.array(cut, pa.binary())], names=["file", "id", "at", "ids"])
        give_back()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gmtk").load(folder).select("path", "content")
    return files.mapInArrow(run, "file string, id long, at long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, ids (binary) of all documents, read back from the files written."""
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens")
    files = write_files(docs, tokenizer_path, folder, end_id, id_col, text_col)
    files = materialize(files, "token-index")
    n = files.count()
    if not n:
        return spark.createDataFrame([], f"`{id_col}` long, start long, ids binary")
    index = files.select("file", "first")
    got = read_files(spark, folder).join(F.broadcast(index) if n <= BROADCAST_ROWS // 10 else index, "file")
    return got.select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias(id_col), (F.col("first") + F.col("at")).alias("start"), "ids")
