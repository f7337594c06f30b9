"""SentencePiece encoding and decoding with a merge-type (BPE) model, by a prefix table.

A merge-type encoding of a text holds the encoding of each of its prefixes: each prefix has one last token, and a
sequence of tokens is the encoding when every two neighbours would be left alone by the merges. So one pass over the
characters keeps, for each prefix, its last token: an Aho-Corasick automaton gives the tokens that end there, and the
one that is compatible with the last token before it is the one. The ids are then recovered from the end backwards.

Where pieces of equal score compete (runs of several spaces), order and position decide, not the pair alone; such runs
are merged one by one. Where no piece of the model holds a space mark after another character, or a letter beside a mark
that is none, texts are cut there, and words are encoded one by one and remembered. That is checked when the model is
loaded; a model without it is encoded text by text.

Defined results: a null text counts as empty, which has no ids but the marks of begin and end. Characters outside the
vocabulary become byte pieces, or the unknown id in a model without these. Decoding follows the library: the mark of
the first piece is dropped, invalid bytes become U+FFFD one by one, control pieces are empty.
"""

from __future__ import annotations

import codecs
import heapq
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import text_or_empty
from glyphmill.llm.remember import Remembered, claim

SPACE = "▁"

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class MergeModel:
    """Encodes and decodes as the library does with the same model file."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(n) if lib.is_byte(i)}
        special = {i for i in range(n) if lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.scores = [lib.get_score(i) for i in range(n)]
        # The library's own rule for spaces and normal forms; only models that keep the text as it is can be read.
        probe = "ﬁ Á\t B  "
        self.prefix = lib.normalize("a") == SPACE + "a"
        if lib.normalize(probe) != (SPACE if self.prefix else "") + probe.replace(" ", SPACE):
            raise ValueError("the model changes texts before it encodes them")
        order = sorted(self.ids.values(), key=lambda i: -self.scores[i])
        self.rank = [0] * n
        level, last = 0, None
        for i in order:
            if self.scores[i] != last:
                level, last = level + 1, self.scores[i]
            self.rank[i] = level
        crowd = {}
        for p, i in self.ids.items():
            if len(p) > 1:
                crowd.setdefault(self.rank[i], []).append(p)
        #: Pieces whose score another piece has too. A text that holds one is merged step by step.
        tied = {p for ps in crowd.values() if len(ps) > 1 for p in ps}
        self.tied = re.compile("|".join(re.escape(p) for p in sorted(tied, key=len))) if tied else None
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        mixed = any(a.isalpha() != b.isalpha() for p in self.ids for a, b in itertools.pairwise(p.lstrip(SPACE)))
        # Word characters of the vocabulary that are no letters; how those outside it are seen doesn't matter.
        odd = "".join(sorted({c for p in self.ids for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()}))
        self.chunks = re.compile(rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if mixed else rf"{SPACE}*[^\W\d_{odd}]+|{SPACE}*(?:[^\w{SPACE}]|[\d_{odd}])+|{SPACE}+")

        # How the merges make each piece: its two parts, or None for one character or a piece that they don't make.
        self.parts: list[tuple[int, int] | None] = [None] * n
        self.made = [False] * n
        pair: dict[tuple[int, int], int] = {}
        for p, i in self.ids.items():
            if len(p) == 1:
                self.made[i] = True
            elif p not in tied:
                found: list[tuple[int, int]] = []
                if self._merge(p, found) == [i]:
                    self.parts[i], self.made[i] = found[-1], True
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pair[a, b] = self.rank[i]
        for i, ab in enumerate(self.parts):
            if ab and max(self.rank[x] if self.parts[x] else 0 for x in ab) >= self.rank[i]:
                raise ValueError("a merge of this model comes before those of its parts")
        self.pair = pair
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.made[i]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.known = Remembered(lambda word: np.array(self.encode_word(word), dtype="<u4").tobytes())
        self.out = [b"" if lib.is_control(i) else bytes([int(self.pieces[i][1:-1], 16)]) if lib.is_byte(i) else b" \xe2\x81\x87 " if i == self.unk else self.pieces[i].replace(SPACE, " ").encode() for i in range(n)]

    def _merge(self, text: str, trace: list | None = None) -> list:
        """The merges, one by one: best score first, then leftmost. Characters outside the vocabulary stay strings."""
        symbols: list = [self.ids.get(c, c) for c in text]
        words = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.ids.get(words[a] + words[b])) is not None:
                heapq.heappush(queue, (-self.scores[i], a, b, i, words[a], words[b]))

        for k in range(n - 1):
            offer(k, k + 1)
        while queue:
            _, a, b, i, left, right = heapq.heappop(queue)
            if words[a] != left or words[b] != right or after[a] != b:
                continue
            if trace is not None:
                trace.append((symbols[a], symbols[b]))
            symbols[a], words[a] = i, left + right
            words[b] = ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s, w in zip(symbols, words, strict=True) if w]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the border between the two tokens alone.

        The merges are taken back from the last; at each state, a merge over the border of a better rank than the
        one that comes next on either side would have been made.
        """
        key = (left, right)
        if (known := self.fits.get(key)) is not None:
            return known
        rank, parts, pair = self.rank, self.parts, self.pair
        a, b = left, right
        next_a = next_b = 1 << 60  # ranks of the merges that take a and b in
        while True:
            over = pair.get((a, b))
            # A merge of equal rank further left comes first: that of a's side lies left of the border, b's right of it.
            if over is not None and over < next_a and over <= next_b:
                fit = False
                break
            made_a = rank[a] if parts[a] else 0
            made_b = rank[b] if parts[b] else 0
            if not made_a and not made_b:
                fit = True
                break
            if made_a > made_b:
                next_a, a = made_a, parts[a][1]
            else:
                next_b, b = made_b, parts[b][0]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = fit
        return fit

    def _prefix_table(self, text: str) -> list[int]:
        n = len(text)
        last = [-1] * (n + 1)  # the last token of each prefix; -2 - code point for a character without a piece
        size = [1] * (n + 1)
        compatible, ids = self.compatible, self.ids
        at, fresh = -1, []
        matches = self.automaton.iter(text)
        match = next(matches, None)
        for end in range(n):
            fresh.clear()
            while match is not None and match[0] == end:
                fresh.append(match[1])
                match = next(matches, None)
            at = end + 1
            if text[end] not in ids:
                last[at] = -2 - ord(text[end])
                continue
            for length, i in fresh:
                start = at - length
                before = last[start]
                if before < 0 or compatible(before, i):
                    last[at], size[at] = i, length
                    break
            else:
                raise AssertionError("a prefix without a last token")
        out, at = [], n
        while at:
            i = last[at]
            if i >= 0:
                out.append(i)
            else:
                out += reversed(self._outside(chr(-2 - i)))
            at -= size[at]
        return out[::-1]

    def _outside(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unk]

    def encode_word(self, word: str) -> list[int]:
        if self.tied is None or not self.tied.search(word):
            return self._prefix_table(word)
        out: list[int] = []
        for s in self._merge(word):
            out += self._outside(s) if isinstance(s, str) else [s]
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if not self.by_word:
            return np.array(self.encode_word(text), dtype="<u4").tobytes()
        return self.known.join(self.chunks.findall(text))

    def decode(self, ids: list[int]) -> str:
        out, first = self.out, True
        if self.prefix:
            for k, i in enumerate(ids):
                if out[i]:
                    text = b"".join(map(out.__getitem__, ids[k + 1 :]))
                    head = out[i]
                    if self.pieces[i].startswith(SPACE):
                        head = head[1:]
                    return (head + text).decode("utf-8", "each_byte")
            return ""
        return b"".join(map(out.__getitem__, ids)).decode("utf-8", "each_byte")


@lru_cache(maxsize=4)
def load(path: str) -> MergeModel:
    return MergeModel(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", bos: bool = True, eos: bool = True, decoded: bool = False) -> DataFrame:
    """id, ids (binary: little-endian unsigned 32-bit integers), and with ``decoded`` the text decoded from them.

    No shuffle: documents are encoded where they are read.
    """
    fields = docs.select(id_col).schema[0]
    schema = f"`{id_col}` {fields.dataType.simpleString()}, ids binary" + (", decoded string" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        claim(model.known)
        head = np.array([model.bos], dtype="<u4").tobytes() if bos else b""
        tail = np.array([model.eos], dtype="<u4").tobytes() if eos else b""
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                rows = batch.slice(part, 1000)
                ids = [head + model.encode_bytes(t) + tail for t in rows.column(1).to_pylist()]
                columns = [rows.column(0), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([model.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded"][: len(columns)])

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: the texts of ``encoded``'s ids (binary); a null is the text of no ids."""
    kind = encoded.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            texts = [model.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
