"""Near-deduplication by SimHash fingerprints in vantage-point trees.

Equal fingerprints are one node. A tree is grown over a bounded sample: each vantage point parts the fingerprints by
their Hamming distance from it. A fingerprint goes to the side of its own distance; by the triangle bound, a link of at
most ``radius`` bits crosses the border only from the last ``radius`` distances inside, and these fingerprints are put
on the outer side too. So every linked pair meets in a leaf of the tree. The leaves are the shards; each grows its own
tree in the same way down to small blocks, where all pairs are compared. Fingerprints that no vantage point parts (a
dense group) stay in one block, compared in tiles; a shard says of each linked node which root it has there, so no
group's pairs are ever emitted. A shard of over CROWD fingerprints, as a dense group may make, is cut into segments, and
each pair of segments is a task of its own.

Several fingerprints of a document, of other hashes of its shingles, may be linked at once: copies whose first
fingerprints differ in a bit too many meet in another.

Defined results: words are the runs of characters other than the six ASCII white spaces, after A-Z are lower-cased.
A text of fewer words than the shingle has is one shingle; a text without words, or null, has fingerprint zero, which is
linked like any other. Rows that share an id are all given. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import free_name, hot_key_join, materialize, parallelism, text_or_empty
from glyphmill.llm.components import join_roots, local_roots
from glyphmill.llm.remember import claim, give_back

#: Fingerprints to grow the shards' tree over, at least (if there are as many) and at most, and those to a shard.
SAMPLE, MOST_SAMPLE, SHARD = 20_000, 400_000, 50_000
#: Fingerprints of a shard from which it is cut into segments of half as many.
CROWD = 200_000
#: Fingerprints to a block in which all pairs are compared.
BLOCK = 192
#: Side of the tiles in which a large block is compared.
TILE = 2048

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE = (np.arange(8) * 256).astype(np.int32)


def shingle_hashes(text: str, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of all shingles, repeats included; none for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends[: len(words) - shingle]]
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[s : e - 1], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=True)]
    return np.array(hashes, dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    cells = hashes.view(np.uint8).reshape(-1, 8) + _BYTE
    counts = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    set_bits = np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def remix(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same shingles: those of the ``k``-th further fingerprint."""
    z = hashes + np.uint64((0x9E3779B97F4A7C15 * k) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, further: int = 0) -> DataFrame:
    """id, fp (long with the fingerprint's bits), more (those of ``further`` other hash functions); no shuffle."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                fps, more = [], []
                for t in rows.column(1).to_pylist():
                    h = shingle_hashes(t, shingle, seed)
                    fps.append(majority(h))
                    more += [majority(remix(h, k)) for k in range(1, further + 1)]
                lists = pa.ListArray.from_arrays(pa.array([k * further for k in range(len(fps) + 1)], pa.int32()), pa.array(np.array(more, dtype=np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), lists], names=["id", "fp", "more"])
        give_back()

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long, more array<long>")


def best_split(points: np.ndarray, rng: np.random.Generator, radius: int) -> tuple[np.uint64, int] | None:
    """The vantage point and distance, of some tried, that leave the largest side smallest; None if none parts the points."""
    best, cost = None, 0.95 * len(points)
    probe = points if len(points) <= 2000 else points[rng.integers(0, len(points), 2000)]
    scale = len(points) / len(probe)
    for _ in range(4):
        vantage = points[rng.integers(0, len(points))]
        count = np.bincount(np.bitwise_count(probe ^ vantage), minlength=65)
        inside = np.cumsum(count)
        outside = len(probe) - np.concatenate([np.zeros(radius, int), inside[:-radius]]) if radius else len(probe) - inside
        larger = np.maximum(inside, outside) * scale
        mu = int(np.argmin(larger))
        if larger[mu] < cost and inside[mu] < len(probe):
            best, cost = (vantage, mu), larger[mu]
    return best


def parts(points: np.ndarray, vantage: np.uint64, mu: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the points go: inside up to mu; outside beyond mu - radius, so that no linked pair is parted."""
    d = np.bitwise_count(points ^ vantage)
    return np.flatnonzero(d <= mu), np.flatnonzero(d > mu - radius)


def grow(sample: np.ndarray, shards: int, radius: int, seed: int = 7) -> list[tuple]:
    """A tree as rows (vantage, mu, inside, outside); a leaf is (None, number). Splits the largest leaf next."""
    rng = np.random.default_rng(seed)
    nodes: list = [None]
    leaves = [(len(sample), 0, sample)]
    while len(leaves) < shards:
        leaves.sort(key=lambda x: x[0])
        n, at, points = leaves.pop()
        split = best_split(points, rng, radius) if n > 8 else None
        if split is None:
            leaves.append((0, at, points))
            if leaves[-2:-1] and max(x[0] for x in leaves) == 0:
                break
            continue
        a, b = parts(points, *split, radius)
        nodes[at] = (*split, len(nodes), len(nodes) + 1)
        leaves += [(len(a), len(nodes), points[a]), (len(b), len(nodes) + 1, points[b])]
        nodes += [None, None]
    for number, (_, at, _) in enumerate(leaves):
        nodes[at] = (None, number)
    return nodes


def route(nodes: list[tuple], points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        node = nodes[at]
        if node[0] is None:
            yield node[1], rows
            continue
        a, b = parts(points[rows], node[0], node[1], radius)
        todo += [(node[2], rows[a]), (node[3], rows[b])]


def links(points: np.ndarray, radius: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """For a shard: links that join the same points as all links do (of a block's component, each point to one other)."""
    rng = np.random.default_rng(len(points))
    todo, left, right = [np.arange(len(points))], [], []
    while todo:
        rows = todo.pop()
        if len(rows) > block and (split := best_split(points[rows], rng, radius)) is not None:
            a, b = parts(points[rows], *split, radius)
            todo += [rows[a], rows[b]]
            continue
        own = points[rows]
        label = np.arange(len(rows))
        for i in range(0, len(rows), TILE):
            for j in range(i, len(rows), TILE):
                x, y = np.nonzero(np.bitwise_count(own[i : i + TILE, None] ^ own[None, j : j + TILE]) <= radius)
                keep = x + i < y + j
                if keep.any():
                    root = local_roots(len(rows), np.concatenate([np.arange(len(rows)), x[keep] + i]), np.concatenate([label, y[keep] + j]))
                    label = root
        linked = np.flatnonzero(label != np.arange(len(rows)))
        left.append(rows[linked])
        right.append(rows[label[linked]])
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def components_of(fps: DataFrame, radius: int = 2, shard: int = SHARD, further: int = 0, crowd: int = CROWD) -> DataFrame:
    """id, fp, comp (the smallest id reachable by links of at most ``radius`` bits) for ``fps`` (id, fp, more), a table.

    With ``further`` fingerprints, rows are linked if any of theirs are; each has trees and shards of its own.
    """
    spark = fps.sparkSession
    least = F.min_by("more", "id") if further else F.lit(None).cast("array<long>")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"), least.alias("more")), "simhash-nodes")
    n_nodes, n_rows = nodes.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_nodes:
        return fps.select("id", "fp", F.col("id").alias("comp"))
    points = nodes.select(F.lit(0).alias("kind"), "node", "fp")
    same = None
    if further:
        # every row's, not one row's for each node: rows of one first fingerprint may differ in the others
        rows = hot_key_join(fps.select("fp", "more"), nodes.select("fp", "node", "n"), ["fp"], "n", n_rows)
        each = rows.select("node", F.posexplode("more").alias("kind", "fp")).select((F.col("kind") + 1).alias("kind"), "node", "fp")
        each = materialize(each.distinct(), "simhash-further")
        groups = materialize(each.groupBy("kind", "fp").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n")), "simhash-groups")
        same = hot_key_join(each, groups.where("n > 1"), ["kind", "fp"], "n", n_nodes).where("root is not null").select("node", "root")
        points = points.unionByName(groups.select("kind", F.col("root").alias("node"), "fp"))
    n_shards = max(1, -(-n_nodes // shard), parallelism(spark))
    # bounded: at most MOST_SAMPLE fingerprints, those of the smallest hashes, whatever the number of documents
    size = min(MOST_SAMPLE // (further + 1), max(SAMPLE, 16 * n_shards))
    chosen = nodes.select("fp", "more").orderBy(F.xxhash64("fp"), "fp").limit(size).collect()
    trees = []
    for k in range(further + 1):
        sample = np.unique(np.array([r["more"][k - 1] if k else r["fp"] for r in chosen], dtype=np.int64)).view(np.uint64)
        trees.append(grow(np.random.default_rng(k).permutation(sample), min(n_shards, max(1, len(sample) // 16)), radius))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, part in batch.groupby("kind"):
                fp, node = part["fp"].to_numpy(), part["node"].to_numpy()
                for leaf, rows in route(trees[kind], fp.view(np.uint64), radius):
                    yield pd.DataFrame({"kind": np.int32(kind), "leaf": np.int32(leaf), "node": node[rows], "fp": fp[rows]})

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        a, b = links(group["fp"].to_numpy().view(np.uint64), radius)
        root = local_roots(len(group), a, b)
        touched = np.unique(np.concatenate([a, b]))
        ids = group["node"].to_numpy()
        return pd.DataFrame({"node": ids[touched], "root": ids[root[touched]]})

    shards = points.mapInPandas(dealt, "kind int, leaf int, node long, fp long")
    keys = ["kind", "leaf"]
    if (further + 1) * n_nodes > crowd:  # else no shard is crowded
        shards = materialize(shards, "simhash-shards")
        # a shard has at least ``crowd`` points here, so there are few
        cut = shards.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / (crowd / 2)).cast("int").alias("cuts")).where(F.col("cuts") > 2).collect()
        if cut:
            cuts = F.broadcast(spark.createDataFrame(cut, "kind int, leaf int, cuts int"))
            shards = shards.join(cuts, keys, "left").fillna(1, ["cuts"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
            shards = shards.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
            shards = shards.where("own <> other or cuts = 1")  # a segment meets itself in its pairs with others
            shards = shards.select(*keys, "node", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
            keys += ["i", "j"]
    found = shards.repartition(n_shards, *keys).groupBy(*keys).applyInPandas(linked, "node long, root long")
    found = found.unionByName(same) if same is not None else found
    comps = join_roots(materialize(found, "simhash-roots"))
    named = nodes.join(comps, "node", "left").select("fp", "n", F.coalesce("comp", "node").alias("comp"))
    named = materialize(named, "simhash-components")
    return hot_key_join(fps.select("id", "fp"), named, ["fp"], "n", n_rows).select("id", "fp", "comp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """id, fp, comp for all rows of ``docs``. Ids are longs; a null id stands for the smallest of longs."""
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias(id_col), text_col)
    fps = materialize(fingerprints(keyed, id_col, text_col, shingle), "simhash-fingerprints")
    out = components_of(fps, radius)
    null = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c))
    return out.select(null("id").alias(id_col), "fp", null("comp").alias("comp"))


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, further: int = 0) -> DataFrame:
    """One row of each component of ``docs``, that of the smallest id (of rows with that id, the first); all columns.

    Rows are numbered in a table first and linked by number, so rows that share an id are told apart.
    """
    row, own = free_name(docs, "row"), free_name(docs, "own")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-input")
    fps = materialize(fingerprints(numbered, row, text_col, shingle, further=further), "simhash-fingerprints")
    comps = materialize(components_of(fps, radius, further=further).select(F.col("id").alias(row), "comp"), "simhash-rows")
    # components of one row stay whatever its id is
    shared = materialize(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "simhash-shared")
    grouped = hot_key_join(comps, shared, ["comp"], "rows", comps.count()).where("rows is not null").drop("rows")
    grouped = materialize(grouped, "simhash-grouped")
    ids = numbered.select(row, F.col(id_col).alias(own)).join(grouped, row)
    ids = materialize(ids, "simhash-ids")
    keep = ids.groupBy("comp").agg(F.min(F.struct(own, row))[row].alias(row))
    gone = ids.select(row).join(keep, row, "left_anti")
    return numbered.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
