"""Bounded-space online packing of token sequences.

Documents are tokenized and packed where they are read; nothing is shuffled but leftovers. Each partition keeps OPEN
windows. A document of over one window gives whole windows first. The rest goes where it leaves the least room. When it
fits nowhere, the fullest window is emitted: with at most SCRAP positions left it is padded, else the head of the
document fills it, for documents may be cut freely. The windows open at the end are the leftovers: partitions are
merged GROUP at a time, fullest windows first, each topped up with pieces of the least full, so that all but one
window of a group come out full.

Defined results: a null text is empty; an empty document has its end id alone. Documents that share an id are
packed one by one and keep apart by their place. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import materialize, text_or_empty
from glyphmill.llm.remember import claim, give_back

WINDOW, OPEN, SCRAP, GROUP = 2048, 16, 8, 16
FIELDS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Windows:
    """The open windows of one partition. A piece is (id, start, ids' bytes, tokens of its document)."""

    def __init__(self, first_id: int, size: int = WINDOW, n_open: int = OPEN, scrap: int = SCRAP):
        self.size, self.n_open, self.scrap, self.next_id = size, n_open, scrap, first_id
        self.open: list[list] = []  # [tokens in it, pieces]
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for key, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((key, start, n, ids, total, self.next_id, at))
            at += n
        self.next_id += 1

    def add(self, key, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            self.emit([(key, at, ids[4 * at : 4 * (at + self.size)], total)])
            at += self.size
        while at < total:
            rest = total - at
            best = None
            for w in self.open:
                if w[0] + rest <= self.size and (best is None or w[0] > best[0]):
                    best = w
            if best is not None:
                best[1].append((key, at, ids[4 * at :], total))
                best[0] += rest
                if best[0] == self.size:
                    self.open.remove(best)
                    self.emit(best[1])
                return
            if len(self.open) < self.n_open:
                self.open.append([rest, [(key, at, ids[4 * at :], total)]])
                return
            full = max(self.open, key=lambda w: w[0])
            self.open.remove(full)
            room = self.size - full[0]
            if room > self.scrap:
                full[1].append((key, at, ids[4 * at : 4 * (at + room)], total))
                at += room
            self.emit(full[1])


def merge(windows: list[tuple[int, list[tuple]]], out: Windows) -> None:
    """Emit all windows (tokens, pieces), the fullest first, each topped up from the least full."""
    windows = sorted(windows, key=lambda w: w[0])
    spare: list[tuple] = []  # pieces of the windows taken apart
    while windows or spare:
        have, pieces = 0, []
        if windows:
            have, pieces = windows.pop()
            pieces = list(pieces)
        while have < out.size and (spare or windows):
            if not spare:
                spare = list(reversed(windows.pop(0)[1]))
            key, start, ids, total = spare.pop()
            n, room = len(ids) // 4, out.size - have
            if n > room:
                spare.append((key, start + room, ids[4 * room :], total))
                ids, n = ids[: 4 * room], room
            pieces.append((key, start, ids, total))
            have += n
        out.emit(pieces)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """One row for each piece: id, start, length, ids (binary, little-endian 32 bits), doc_tokens, sequence_id, offset."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    end = np.array([end_id], dtype="<u4").tobytes()

    def table(rows: list[tuple], like: pa.DataType, partition: int | None, left: bool) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        arrays = [pa.array(columns[0], like), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[4:])]
        extra = [] if partition is None else [pa.array([partition] * len(rows), pa.int64()), pa.array([left] * len(rows), pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays + extra, names=names + ["part", "left"][: len(extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from glyphmill.llm.word_tokens import load

        tokens, part = load(tokenizer_path), TaskContext.get().partitionId()
        claim(tokens.known)
        windows, like = Windows(part << 32, size), None
        for batch in batches:
            like = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                for key, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    windows.add(key, tokens.encode_bytes(text) + end)
                yield table(windows.out, like, part, False)
                windows.out = []
        if windows.open:
            for _, pieces in windows.open:
                windows.emit(pieces)
            yield table(windows.out, like, part, True)
        give_back()

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        open_windows: dict[int, list] = {}
        for r in zip(*(rows.column(c).to_pylist() for c in [id_col, "start", "ids", "doc_tokens", "sequence_id"]), strict=True):
            open_windows.setdefault(r[4], []).append(r[:4])
        out = Windows((1 << 62) + (key[0].as_py() << 32), size)
        merge([(sum(len(p[2]) // 4 for p in w), w) for w in open_windows.values()], out)
        return pa.Table.from_batches([table(out.out, rows.schema.field(id_col).type, None, False)])

    schema = f"`{id_col}` {kind}, {FIELDS}"
    pieces = docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, schema + ", part long, left boolean")
    pieces = materialize(pieces, "packing-pieces")
    rest = pieces.where("left").withColumn("group", F.floor(F.col("part") / GROUP).cast("long")).groupBy("group").applyInArrow(merged, schema)
    return pieces.where("not left").select(*names).unionByName(rest.select(*names))
