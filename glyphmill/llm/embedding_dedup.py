"""Near-deduplication of embeddings by a pivot-permutation index.

Vectors that are equal are one node. Pivots are reference points drawn from the nodes; a node is described by its
NEAREST pivots in order. It stands in the inverted list of each of them. Within a list, pairs that share at least
SHARED pivots are candidates, and their cosines are verified in double precision. A pair is counted in the list of its
lowest shared pivot alone, so links are counted once. Lists of over TILE nodes are cut into segments, and each pair of
segments is a task of its own: no list is capped. Each task gives counts and local roots, never pairs.

The index is fitted on at most 2 * MOST_PIVOTS nodes (those of the smallest hashes); every node is indexed. Its recall is
held against brute force in tests.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, each a
component of its own. Vectors of unequal length never link. Rows that repeat are vectors of their own. A null id sorts
before all others. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import hot_key_join, materialize, parallelism
from glyphmill.llm.components import join_roots, local_roots

NEAREST, SHARED, TILE = 12, 2, 2048
LEAST_PIVOTS, MOST_PIVOTS = 64, 4096


def pivot_count(nodes: int) -> int:
    """A power of two near 4 sqrt(nodes), within the bounds: lists then grow as the square root of the nodes."""
    return int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 ** round(np.log2(4 * max(1, nodes) ** 0.5)))))


def _unit(raw: list[bytes], single: bool, dim: int | None = None) -> np.ndarray:
    """Vectors as unit rows in double precision; with ``dim``, cut or filled up to it."""
    kind = "<f4" if single else "<f8"
    rows = [np.frombuffer(r, kind).astype(np.float64) for r in raw]
    if dim is not None:
        rows = [r if len(r) == dim else np.pad(r[:dim], (0, max(0, dim - len(r)))) for r in rows]
    x = np.array(rows)
    scale = np.abs(x).max(1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def spread(points: np.ndarray, most: int, apart: float = 0.7) -> np.ndarray:
    """Up to ``most`` of ``points`` in their order, none with a cosine over ``apart`` to one before it.

    A dense group of vectors would else give many pivots, whose order within the group is noise.
    """
    kept = np.empty((most, points.shape[1]))
    n = 0
    for p in points:
        if not n or (kept[:n] @ p).max() <= apart:
            kept[n] = p
            n += 1
            if n == most:
                break
    return kept[:n]


def block_links(vectors: list[bytes], single: bool, pivots: np.ndarray, segment: np.ndarray | None, pivot: int, words: int, shared: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of one list (or of two of its segments) that are this list's to count."""
    n = len(vectors)
    bits = np.zeros((words, n), dtype=np.uint64)
    for k in range(pivots.shape[1]):
        at = pivots[:, k]
        ok = at >= 0
        np.bitwise_or.at(bits, (at[ok] // 64, np.flatnonzero(ok)), np.uint64(1) << (at[ok] % 64).astype(np.uint64))
    length = np.array([len(v) for v in vectors])
    out_a, out_b = [], []
    for size in np.unique(length):
        rows = np.flatnonzero(length == size)
        x = _unit([vectors[r] for r in rows], single)
        own = bits[:, rows]
        for lo in range(0, len(rows), 512):
            hi = min(lo + 512, len(rows))
            common = np.zeros((hi - lo, len(rows) - lo), dtype=np.uint16)
            for w in range(words):
                if own[w, lo:hi].any():
                    common += np.bitwise_count(own[w, lo:hi, None] & own[w, None, lo:])
            a, b = np.nonzero(common >= shared)
            keep = a < b
            a, b = a[keep] + lo, b[keep] + lo
            if segment is not None:
                cross = segment[rows[a]] != segment[rows[b]]
                a, b = a[cross], b[cross]
            for i in range(0, len(a), 200_000):
                p, q = a[i : i + 200_000], b[i : i + 200_000]
                near = np.einsum("ij,ij->i", x[p], x[q]) >= least
                p, q = p[near], q[near]
                if len(p):
                    both = own[:, p] & own[:, q]
                    first = (both != 0).argmax(0)
                    word = both[first, np.arange(len(p))]
                    low = np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)
                    mine = first * 64 + low == pivot
                    out_a.append(rows[p[mine]])
                    out_b.append(rows[q[mine]])
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(out_a or none), np.concatenate(out_b or none)


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """id, n_links, comp (smallest id reachable by links, itself included) for each row."""
    spark = vectors.sparkSession
    single = vectors.select(vector_col).schema[0].dataType.simpleString() == "array<float>"
    no_id = -(1 << 63)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw: list[bytes | None] = []
            for v in batch.column(1).to_pylist():
                x = None
                if v and None not in v:
                    x = np.array(v, dtype="<f4" if single else "<f8") + 0.0  # no negative zero
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                raw.append(None if x is None else x.tobytes())
            digest = [None if r is None else hashlib.sha256(r).digest()[:16] for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], names=["id", "digest", "vec"])

    kind = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(no_id)).alias("id"), kind.alias("vec"))
    rows = materialize(rows.mapInArrow(read, "id long, digest binary, vec binary"), "vectors")
    nodes = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    nodes = materialize(nodes, "vector-nodes")
    n_nodes, n_rows = nodes.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_nodes:
        return rows.select(F.when(F.col("id") != no_id, F.col("id")).alias(id_col), F.lit(0).cast("long").alias("n_links"), F.when(F.col("id") != no_id, F.col("id")).alias("comp"))
    drawn = [bytes(r[0]) for r in nodes.select("vec", "digest").orderBy(F.xxhash64("digest"), "digest").limit(2 * pivot_count(n_nodes)).collect()]  # 2 * MOST_PIVOTS at most
    dim = max(len(r) for r in drawn) // (4 if single else 8)
    points = spread(_unit(drawn, single, dim), pivot_count(n_nodes))
    words, m = -(-len(points) // 64), min(nearest, len(points))
    shared = min(shared, m)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                near = _unit(part.column(2).to_pylist(), single, dim) @ points.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :m].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, m), pa.int32()), pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["node", "n", "vec", "pivots"])

    described = materialize(nodes.select("node", "n", "vec").mapInArrow(describe, "node long, n long, vec binary, pivots array<int>"), "vector-pivots")
    entries = described.select("*", F.explode("pivots").alias("pivot"))
    sizes = entries.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"))  # a row for each pivot
    cut = F.broadcast(sizes.select("pivot", F.ceil(F.col("size") / TILE).cast("int").alias("cuts")))
    entries = entries.join(cut, "pivot").withColumn("segment", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    entries = entries.select("pivot", F.least("segment", "other").alias("i"), F.greatest("segment", "other").alias("j"), "segment", "node", "n", "vec", "pivots")

    def verify(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("node", ignore_index=True)
        cross = block["i"].iloc[0] != block["j"].iloc[0]
        pivots = np.array(block["pivots"].tolist()).reshape(len(block), -1)
        a, b = block_links([bytes(v) for v in block["vec"]], single, pivots, block["segment"].to_numpy() if cross else None, int(block["pivot"].iloc[0]), words, shared, least)
        weight = block["n"].to_numpy()
        count = np.bincount(a, weight[b], len(block)) + np.bincount(b, weight[a], len(block))
        root = local_roots(len(block), a, b)
        touched = np.flatnonzero(count > 0)
        ids = block["node"].to_numpy()
        return pd.DataFrame({"node": ids[touched], "links": count[touched].astype("int64"), "root": ids[root[touched]]})

    n_tasks = max(parallelism(spark), len(points) // 8)
    found = entries.repartition(n_tasks, "pivot", "i", "j").groupBy("pivot", "i", "j").applyInPandas(verify, "node long, links long, root long")
    found = materialize(found, "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = join_roots(found.select("node", "root"))
    named = nodes.select("digest", "node", "n").join(links, "node", "left").join(comps, "node", "left")
    named = materialize(named.select("digest", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp")), "vector-named")
    out = hot_key_join(rows.select("id", "digest"), named, ["digest"], "n", n_rows)
    back = lambda c: F.when(c != no_id, c)
    return out.select(back(F.col("id")).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), back(F.coalesce("comp", "id")).alias("comp"))
