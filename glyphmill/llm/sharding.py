"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

A group is the documents of one text. Groups are dealt to cells by their hash; a group of more than one in SPLIT of all
rows, bytes or tokens, or of over GROUP_ROWS rows, is split, so no group fills a shard or a task. Each cell packs its groups
into as many bundles as there are shards, the largest first, each into the bundle where the dot product of its size and the
residual capacity is highest. The bundles of FAN cells are packed into the bundles of a cell above in the same way, level
by level, until at most FAN cells are left; their bundles, a few thousand, are placed in the shards likewise and swapped
between shards while that evens out bytes, tokens and rows. ``slot`` counts a shard's documents from 0 without gaps.

Rows that share id and text are alike: they move as one row with a count and are told apart by their slots only.

Defined results: a null text has no bytes and counts as an empty one. A null id, of any type that ids may have, stays null
and sorts first. Ids are whole numbers or strings; others raise TypeError. Ties go by text hash and id. An empty table
gives an empty table; other columns are not read. The result does not depend on how the input is partitioned but for
the number of cells, which follows the rows and the setting of shuffle partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import BROADCAST_ROWS, hot_key_join, materialize, parallelism

#: A group over one in so many rows, bytes or tokens is split: there are fewer than 3 * SPLIT such groups.
SPLIT = 256
#: Rows to a cell, about; rows from which a group is split; cells whose bundles are packed together.
CELL_ROWS, GROUP_ROWS, FAN = 100_000, 400_000, 256


def place(sizes: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each of ``sizes`` (items x resources), taken in their order.

    Residual capacities are in parts of the bins' equal share; an item goes where their dot product with its size is
    highest, among equals to the first bin.
    """
    share = np.maximum(sizes.sum(0) / bins, 1e-12)
    residual = np.ones((bins, sizes.shape[1]))
    out = np.empty(len(sizes), dtype=np.int64)
    for k, item in enumerate(sizes / share):
        b = out[k] = int(np.argmax(residual @ item))
        residual[b] -= item
    return out


def even_out(sizes: np.ndarray, where: np.ndarray, bins: int, weight: tuple[float, ...] = (4.0, 1.0, 1.0), look: int = 256) -> np.ndarray:
    """Swap items between the most uneven bin and another while that brings both nearer to their equal share.

    Bytes weigh most. Of each bin ``look`` items are tried, so a swap's cost is bounded.
    """
    z = sizes / np.maximum(sizes.sum(0) / bins, 1e-12) * np.sqrt(weight)
    where = where.copy()
    load = np.stack([np.bincount(where, z[:, k], bins) for k in range(z.shape[1])], axis=1)
    mean = load.mean(0)
    tried = [np.flatnonzero(where == k)[:look] for k in range(bins)]
    for _ in range(64 * bins):
        off = load - mean
        cost = (off**2).sum(1)
        worst, best = int(np.argmax(cost)), None
        mine = tried[worst]
        for other in range(bins):
            theirs = tried[other]
            if other == worst or not len(theirs) or not len(mine):
                continue
            moved = z[mine][:, None] - z[theirs][None]
            gain = ((off[worst] - moved) ** 2).sum(2) + ((off[other] + moved) ** 2).sum(2) - cost[worst] - cost[other]
            k = int(np.argmin(gain))
            if gain.flat[k] < -1e-12 and (best is None or gain.flat[k] < best[0]):
                best = (gain.flat[k], other, k // len(theirs), k % len(theirs))
        if best is None:
            break
        _, other, i, j = best
        a, b = mine[i], tried[other][j]
        load[worst] -= z[a] - z[b]
        load[other] += z[a] - z[b]
        where[a], where[b] = other, worst
        mine[i], tried[other][j] = b, a
    return where


def pack(sizes: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each of ``sizes``, placed the largest first; of equals in their order."""
    order = np.argsort(-(sizes / np.maximum(sizes.sum(0), 1e-12)).max(1), kind="stable")
    out = np.empty(len(sizes), dtype=np.int64)
    out[order] = place(sizes[order], bins)
    return out


def _fold(bundles: DataFrame, cells: int, shards: int, fan: int) -> DataFrame:
    """cell, bundle, shard, first (the slots before it) of the bundles (cell, bundle, b, t, n) of all cells."""
    spark = bundles.sparkSession

    def above(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["cell", "bundle"], ignore_index=True)
        group["up_bundle"] = pack(group[["b", "t", "n"]].to_numpy(dtype=float), shards).astype("int32")
        group["first"] = group.groupby("up_bundle")["n"].cumsum() - group["n"]
        return group[["cell", "bundle", "b", "t", "n", "up", "up_bundle", "first"]]

    steps = []
    while cells > fan:
        packed = bundles.withColumn("up", F.floor(F.col("cell") / fan).cast("int")).groupBy("up").applyInPandas(above, "cell int, bundle int, b long, t long, n long, up int, up_bundle int, first long")
        packed = materialize(packed, "shard-level")
        steps.append(packed.select("cell", "bundle", "up", "up_bundle", "first"))
        bundles = packed.groupBy(F.col("up").alias("cell"), F.col("up_bundle").alias("bundle")).agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n"))
        cells = -(-cells // fan)
    top = bundles.toPandas().sort_values(["cell", "bundle"], ignore_index=True)  # fan * shards rows at most
    sizes = top[["b", "t", "n"]].to_numpy(dtype=float)
    order = np.argsort(-(sizes / np.maximum(sizes.sum(0), 1e-12)).max(1), kind="stable")
    top["shard"] = 0
    top.loc[order, "shard"] = even_out(sizes[order], place(sizes[order], shards), shards)
    top = top.sort_values(["shard", "cell", "bundle"], ignore_index=True)
    top["first"] = top.groupby("shard")["n"].cumsum() - top["n"]
    where = spark.createDataFrame(top[["cell", "bundle", "shard", "first"]], "cell int, bundle int, shard int, first long")
    for step in reversed(steps):
        up = F.broadcast(where) if step is steps[-1] else where
        up = up.select(F.col("cell").alias("up"), F.col("bundle").alias("up_bundle"), "shard", F.col("first").alias("up_first"))
        where = step.join(up, ["up", "up_bundle"]).select("cell", "bundle", "shard", (F.col("first") + F.col("up_first")).alias("first"))
    return where


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS, group_rows: int = GROUP_ROWS, fan: int = FAN) -> DataFrame:
    """id, size, text_crc32, shard, slot for each row; size is the text's bytes and 1 for its end."""
    spark = docs.sparkSession
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint", "string"):
        raise TypeError(f"ids of type {kind}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.length(text) - F.length(F.translate(text, " \t\n\r\f\x0b", "")) + 1
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), words.cast("long").alias("tokens"), F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.md5(text)).alias("digest"))
    rows = materialize(rows.groupBy("id", "digest", "size", "tokens", "crc").agg(F.count(F.lit(1)).alias("n")), "shard-rows")
    n, size, tokens = rows.agg(F.sum("n"), F.sum(F.col("size") * F.col("n")), F.sum(F.col("tokens") * F.col("n"))).first()
    if not n:
        return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # groups that are split: fewer than 3 * SPLIT + n / GROUP_ROWS rows, each with the number of its parts
    groups = rows.groupBy("digest").agg(F.sum("n").alias("rows"), F.first("size").alias("b"), F.first("tokens").alias("t"))
    share = F.greatest(F.col("rows") / n, F.col("rows") * F.col("b") / size, F.col("rows") * F.col("t") / tokens)
    heavy = groups.select("digest", "rows", F.ceil(F.greatest(share * SPLIT, F.col("rows") / group_rows)).cast("long").alias("parts")).where("parts > 1")
    heavy = materialize(heavy, "shard-heavy")
    n_heavy = heavy.count()
    if n_heavy <= BROADCAST_ROWS:
        keyed = rows.join(F.broadcast(heavy.select("digest", "parts")), "digest", "left")
    else:
        keyed = hot_key_join(rows, heavy, ["digest"], "rows", n).drop("rows")
    # a row of a split group goes to the part of its id's hash; alike rows, of which one part would have too many, to all parts
    parts = F.coalesce("parts", F.lit(1))
    many = (parts > 1) & (F.col("n") >= parts)
    keyed = keyed.withColumn("salt", F.explode(F.when(many, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), parts)))))
    keyed = keyed.withColumn("n", F.when(many, F.floor(F.col("n") / parts) + F.when(F.col("salt") < F.col("n") % parts, 1).otherwise(0)).otherwise(F.col("n")).cast("long"))
    cells = max(parallelism(spark), -(-n // cell_rows))
    keyed = keyed.withColumn("cell", F.pmod(F.xxhash64("digest", "salt"), F.lit(cells)).cast("int"))

    def pack_cell(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["digest", "salt", "none", "id"], ascending=[True, True, False, True], ignore_index=True)
        group = cell.groupby(["digest", "salt"], sort=False).ngroup().to_numpy()
        count = cell["n"].to_numpy()
        sizes = np.stack([np.bincount(group, c * count) for c in (cell["size"].to_numpy(dtype=float), cell["tokens"].to_numpy(dtype=float), 1.0)], axis=1)
        cell["bundle"] = pack(sizes, shards)[group].astype("int32")
        cell["at"] = (cell.groupby("bundle")["n"].cumsum() - cell["n"]).astype("int64")
        return cell[["id", "none", "size", "tokens", "crc", "n", "cell", "bundle", "at"]]

    packed = keyed.select(F.coalesce("id", F.lit("" if kind == "string" else 0).cast(kind)).alias("id"), F.col("id").isNull().alias("none"), "size", "tokens", "crc", "n", F.hex("digest").alias("digest"), "salt", "cell")
    out = packed.repartition(cells, "cell").groupBy("cell").applyInPandas(pack_cell, f"id {kind}, none boolean, size long, tokens long, crc long, n long, cell int, bundle int, at long")
    out = materialize(out, "shard-cells")
    bundles = out.groupBy("cell", "bundle").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n"))
    where = _fold(bundles, cells, shards, fan)
    where = F.broadcast(where) if cells * shards <= BROADCAST_ROWS else where
    found = out.join(where, ["cell", "bundle"]).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return found.select(F.when(~F.col("none"), F.col("id")).alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("at") + F.col("k")).alias("slot"))
