"""Toxicity by a convolutional text classifier, trained and run in numpy.

A word's vector is the sum of hashed vectors of the word and of its beginnings. Filters of several widths run over a
text's word vectors; the largest answer of each filter over the whole text is pooled; a logistic layer scores them. The
threshold is calibrated for each language on labelled texts that training didn't see. A text's language is guessed from
its own function words; no column but the text is an input.

The classifier is fitted on at most ``sample`` labelled rows (those of the smallest hashes of their ids, half of them of
either label where there are as many); every row is scored, over its whole text. Results do not depend on partitioning.

Defined results: a null text counts as empty; a text without words gets the score of no filter answering. Rows that
repeat are scored alike. Without labelled rows of both labels, all scores are 0. Labels of one id that differ count as
toxic. A row without an id is scored, never learned from, and not held out. A text of any length is scored whole, in
spans that overlap by a filter's width. An empty table gives an empty table; other columns are not read, whatever they
are called.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import free_name, text_or_empty
from glyphmill.llm.remember import claim, give_back

WORDS = re.compile(r"[^\W\d_]+")
#: Hashed vectors, their length, the beginnings of a word that have one, filters of each width, and the widths.
ROWS, DIM, BEGINNINGS, FILTERS, WIDTHS = 1 << 16, 16, (3, 4, 5, 6), 12, (1, 2, 3)
#: Labelled rows to fit on, at most.
SAMPLE = 6000
#: Texts to fit on that must have a word or beginning, for it to have a vector; of few texts, fewer must.
LEAST, LEAST_OF_FEW, FEW = 6, 4, 1000
#: Kept texts of either label that a threshold of their own takes; else the logit 0 is the threshold.
ENOUGH, ENOUGH_OF_LANGUAGE = 30, 15
#: Words in a span that is scored at once.
SPAN = 50_000
#: Function words by which a text's language is guessed.
LANGUAGES = {
    "en": "the of and to in is that for it was on are with as be by this from".split(),
    "de": "der die und das den von zu mit ist des im dem nicht ein eine auf für".split(),
    "fr": "le la les de des et que un une du est pour dans qui par sur avec pas".split(),
    "es": "el la los las de que y en un una del por con para se no al lo".split(),
}
PAD = "\0"


def features(word: str) -> tuple[int, ...]:
    """Rows of the hashed vectors; row 0 has the zero vector."""
    rows = [1 + zlib.crc32(word.encode()) % (ROWS - 1)]
    rows += [1 + zlib.crc32(b"^" + word[:k].encode()) % (ROWS - 1) if len(word) > k else 0 for k in BEGINNINGS]
    return tuple(rows)


class Vocabulary:
    """Words met so far by number; number 0 is the padding."""

    def __init__(self, size: int = 150_000):
        self.size = size
        self.clear()

    def __len__(self) -> int:
        return len(self.number)

    def clear(self) -> None:
        self.number = {PAD: 0}
        self.flat = array("i", (0,) * (1 + len(BEGINNINGS)))

    def rows(self, first: int = 0) -> np.ndarray:
        """Rows of the hashed vectors of the words from number ``first`` on."""
        width = 1 + len(BEGINNINGS)
        return np.array(self.flat[first * width :], dtype=np.int32).reshape(-1, width)

    def numbers(self, words: list[str]) -> np.ndarray:
        known, flat = self.number, self.flat
        got = list(map(known.get, words))
        if None in got:
            for k, g in enumerate(got):
                if g is None:
                    w = words[k]
                    if (g := known.get(w)) is None:
                        g = known[w] = len(known)
                        flat.extend(features(w))
                    got[k] = g
        return np.array(got, dtype=np.int32)


_BY_WORD = {w: [k for k, ws in enumerate(LANGUAGES.values()) if w in ws] for ws in LANGUAGES.values() for w in ws}


def language(words: list[str]) -> int:
    """Number of the language of LANGUAGES with most function words; their count if there is none."""
    votes = [0] * (len(LANGUAGES) + 1)
    for w in words:
        if w in _BY_WORD:
            for k in _BY_WORD[w]:
                votes[k] += 1
    return max(range(len(LANGUAGES)), key=lambda k: (votes[k], -k)) if any(votes) else len(LANGUAGES)


@dataclass
class Model:
    vectors: np.ndarray  # ROWS x DIM
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: np.ndarray  # of all filters
    weights: np.ndarray
    offset: float
    thresholds: np.ndarray  # logits, by language and for none

    def answers(self, x: np.ndarray) -> np.ndarray:
        """Answers of all filters at each position of the padded word vectors ``x``."""
        n = len(x) - max(WIDTHS) + 1
        flat = x @ np.concatenate([f for w in self.filters for f in w], axis=1)
        out, at = np.empty((n, FILTERS * len(WIDTHS)), dtype=np.float32), 0
        for k, w in enumerate(WIDTHS):
            own = out[:, k * FILTERS : (k + 1) * FILTERS]
            own[:] = flat[:n, at : at + FILTERS]
            for i in range(1, w):
                own += flat[i : n + i, at + i * FILTERS : at + (i + 1) * FILTERS]
            at += w * FILTERS
        return out

    def pooled(self, numbers: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
        """The largest answer of each filter over each text's words."""
        gap = max(WIDTHS) - 1
        out = np.full((len(numbers), FILTERS * len(WIDTHS)), -np.inf, dtype=np.float32)
        spans: list[tuple[int, np.ndarray]] = []

        def run() -> None:
            ids = np.zeros(sum(len(p) + gap for _, p in spans) + gap, dtype=np.int64)
            edges, at = [], 0  # from a text's first word to behind its last: windows do not reach the next text's words
            for _, p in spans:
                edges += [at, at + len(p)]
                ids[at : at + len(p)] = p
                at += len(p) + gap
            most = np.maximum.reduceat(self.answers(vectors[ids])[:at], edges, axis=0)[::2]
            np.maximum.at(out, np.array([d for d, _ in spans]), most)
            spans.clear()

        for doc, own in enumerate(numbers):
            own = own if len(own) else np.zeros(1, dtype=np.int32)  # a text without words is one padding
            for at in range(0, max(1, len(own)), SPAN):
                # a span's last windows reach into the next one's words
                spans.append((doc, own[at : at + SPAN + gap] if at + SPAN < len(own) else own[at:]))
                if sum(len(p) for _, p in spans) > SPAN:
                    run()
        if spans:
            run()
        return np.maximum(out + self.bias, 0)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled.astype(np.float64) @ self.weights + self.offset


def fit(texts: list[str], labels: list[int], epochs: int | None = None, seed: int = 11) -> Model | None:
    """A model of (text, label); every fifth text is kept for the thresholds. Few texts are seen more often."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    vocabulary = Vocabulary()
    docs, languages = [], []
    for t in texts:
        words = WORDS.findall(t.lower())
        languages.append(language(words))
        docs.append(vocabulary.numbers(words or [PAD]))
    rows = vocabulary.rows()
    order = rng.permutation(len(docs))
    held, train = order[::5], np.setdiff1d(order, order[::5])
    m = Model(
        rng.normal(0, 0.01, (ROWS, DIM)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), dtype=np.float32),
        rng.normal(0, 0.1, FILTERS * len(WIDTHS)),
        0.0,
        np.zeros(len(LANGUAGES) + 1),
    )
    # words and beginnings that fewer than LEAST texts have say nothing: their vectors stay zero
    texts_with = np.zeros(ROWS, dtype=np.int64)
    for d in train:
        texts_with[np.unique(rows[np.unique(docs[d])])] += 1
    known = texts_with >= (LEAST if len(train) >= FEW else LEAST_OF_FEW)
    known[0] = False
    m.vectors[~known] = 0
    share = np.clip(y[train].mean(), 0.02, 0.98)
    gap = max(WIDTHS) - 1
    seen = {"v": np.full(ROWS, 1e-3), "f": [np.full(f.shape, 1e-3) for f in m.filters], "b": np.full(m.bias.shape, 1e-3), "w": np.full(m.weights.shape, 1e-3), "o": 1e-3}
    epochs = epochs or int(np.clip(20_000 // len(train), 5, 40))
    for epoch in range(epochs):
        rate = 0.1 / (1 + 8 * epoch / epochs)
        train = rng.permutation(train)
        for lo in range(0, len(train), 64):
            batch = train[lo : lo + 64]
            own, back = np.unique(np.concatenate([np.zeros(1, np.int32), *(docs[d] for d in batch)]), return_inverse=True)
            vectors = m.vectors[rows[own]].sum(1)
            ids, starts, at, ends = np.zeros(len(back) + gap * (len(batch) + 1), dtype=np.int64), [], 0, 1
            for d in batch:
                n = len(docs[d])
                starts.append(at)
                ids[at : at + n] = back[ends : ends + n]
                at, ends = at + n + gap, ends + n
            answers = m.answers(vectors[ids[: at + gap]])
            where = np.array([s + answers[s : s + len(docs[d])].argmax(0) for s, d in zip(starts, batch, strict=True)])
            most = np.take_along_axis(answers, where, 0) + m.bias
            pooled = np.maximum(most, 0).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(pooled @ m.weights + m.offset, -30, 30)))
            g = (p - y[batch]) * np.where(y[batch] == 1, 0.5 / share, 0.5 / (1 - share)) / len(batch)
            gw, go = pooled.T @ g, g.sum()
            ga = (g[:, None] * m.weights * (most > 0)).astype(np.float32)
            gv = np.zeros((len(own), DIM), dtype=np.float32)
            for k, w in enumerate(WIDTHS):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                for i in range(w):
                    word = ids[where[:, part] + i]
                    gf = np.einsum("df,dfe->ef", ga[:, part], vectors[word])
                    np.add.at(gv, word.ravel(), (ga[:, part, None] * m.filters[k][i].T[None]).reshape(-1, DIM))
                    seen["f"][k][i] += gf**2
                    m.filters[k][i] -= rate * gf / np.sqrt(seen["f"][k][i])
            hit = np.flatnonzero(np.abs(gv).sum(1))
            each = rows[own[hit]]
            step = np.repeat(gv[hit], each.shape[1], axis=0)
            at_rows, inverse = np.unique(each.ravel(), return_inverse=True)
            total = np.zeros((len(at_rows), DIM), dtype=np.float32)
            np.add.at(total, inverse, step)
            seen["v"][at_rows] += (total**2).mean(1)
            m.vectors[at_rows] -= (rate * total / np.sqrt(seen["v"][at_rows])[:, None]).astype(np.float32) * known[at_rows, None]
            gb = ga.sum(0)
            seen["b"] += gb**2
            m.bias -= rate * gb / np.sqrt(seen["b"])
            seen["w"] += gw**2
            m.weights -= rate * gw / np.sqrt(seen["w"])
            seen["o"] += go**2
            m.offset -= rate * go / np.sqrt(seen["o"])
    # thresholds: between the two labels' logits with the fewest balanced errors, the middle of the widest such gap
    vectors = m.vectors[rows].sum(1)
    logits = np.concatenate([m.logits(m.pooled([docs[d] for d in held[i : i + 200]], vectors)) for i in range(0, len(held), 200)])
    spoken, held_y = np.array(languages)[held], y[held]
    if min(held_y.sum(), (1 - held_y).sum()) >= ENOUGH:
        m.thresholds[:] = _threshold(logits, held_y)
    for k in range(len(LANGUAGES)):
        own = spoken == k
        if min(held_y[own].sum(), (1 - held_y[own]).sum()) >= ENOUGH_OF_LANGUAGE:
            m.thresholds[k] = _threshold(logits[own], held_y[own])
    return m


def _threshold(logits: np.ndarray, y: np.ndarray) -> float:
    if len(set(y.tolist())) < 2:
        return 0.0
    order = np.argsort(logits)
    z, t = logits[order], y[order]
    missed = np.concatenate([[0], np.cumsum(t)]) / t.sum()
    wrong = np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]]) / (1 - t).sum()
    cost = missed + wrong
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    width = np.diff(edges)
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = best[np.argmax(width[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def held_out(column: str):
    """Whether crc32 of the id as text leaves no rest of 5: such rows are never learned from. False for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """Fit on labelled rows that are not held out; at most ``sample`` rows come to the driver, with their whole texts."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64("id"))
    each = [known.where(F.col("y") == y).orderBy("h", "id").limit(sample // 2) for y in (0, 1)]
    chosen = each[0].unionByName(each[1]).groupBy("id").agg(F.max("y").alias("y"))
    # at most ``sample`` ids: bounded
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "id")
    got = sorted(rows.groupBy("id", "y").agg(F.max("text").alias("text")).collect(), key=lambda r: r["id"])
    return fit([r["text"] for r in got], [r["y"] for r in got])


def score(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``name``, the score (0 to 1; from 0.5 the text is toxic); no shuffle."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{name}` double"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: ROWS x DIM numbers and the filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        m = shared.value
        vocabulary, vectors = Vocabulary(), np.zeros((0, DIM), dtype=np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                rows = batch.slice(at, 400)
                if m is None:
                    scores = np.zeros(rows.num_rows)
                else:
                    numbers, spoken = [], []
                    for t in rows.column(len(keep)).to_pylist():
                        words = WORDS.findall(t.lower())
                        spoken.append(language(words))
                        numbers.append(vocabulary.numbers(words))
                    if len(vocabulary) > len(vectors):
                        vectors = np.concatenate([vectors, m.vectors[vocabulary.rows(len(vectors))].sum(1)])
                    z = m.logits(m.pooled(numbers, vectors)) - m.thresholds[spoken]
                    scores = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    if len(vocabulary) > vocabulary.size:
                        vocabulary.clear()
                        vectors = vectors[:0]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(scores)], names=[*keep, name])
        give_back()

    text = free_name(docs, "text_read")
    return docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text_col).alias(text)).mapInArrow(run, schema)
