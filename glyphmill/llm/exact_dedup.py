"""Exact deduplication by an extendible-hash index on shared files. DataFrame operations only.

Every row becomes an index entry (64-bit hash, SHA-256, row number, id). Entries are summed up by key before they
move, so copies, however many, cost a bucket one row. The directory starts with one bucket; a bucket with more keys
than its capacity is split by one more hash bit and the directory doubles when the bucket was as deep as the
directory. The directory is shared, so it ends at 2**MAX_DEPTH slots; from there on doubling goes on within a slot, by as many
more bits as its count of keys takes, and each owner has its own part of the directory. Buckets are sorted and written as
files to the shared folder, one owner task for each bucket, which chains the keys of its range that share a hash while
it writes them. Texts whose hash more than one row has then go to the place of their chain, where their bytes are
compared; copies are counted before they move, so a text however frequent is one row of each task that reads it.

Defined results: a null text counts as empty; all empty texts are one group. A null id counts as smaller than any id.
Rows that share both text and id are told apart by their place in the input; one of them stays. An empty table gives
an empty table. Columns of the input other than the id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import free_name, hot_key_join, materialize, parallelism, semi_join, text_or_empty

#: Bits of the hash that the shared directory uses at most; deeper buckets are found within its slots.
MAX_DEPTH = 16


def split_buckets(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int, int]]:
    """The directory: (slot, bucket, local depth, further bits) for each of 2**global depth slots.

    ``counts`` has the number of keys for each prefix of ``max_depth`` bits. Buckets over capacity are split until
    they fit or have the greatest depth; those that still don't fit are split by further bits of the hash, as many as
    bring an even spread of their keys under the capacity.
    """
    prefix = [0] * ((1 << max_depth) + 1)
    for slot, n in counts.items():
        prefix[slot + 1] = n
    for i in range(1 << max_depth):
        prefix[i + 1] += prefix[i]
    buckets, todo = [], [(0, 0)]
    while todo:
        depth, bits = todo.pop()
        width = 1 << (max_depth - depth)
        if prefix[(bits + 1) * width] - prefix[bits * width] > capacity and depth < max_depth:
            todo += [(depth + 1, 2 * bits + 1), (depth + 1, 2 * bits)]
        else:
            keys = prefix[(bits + 1) * width] - prefix[bits * width]
            buckets.append((depth, bits, max(0, -(-keys // capacity) - 1).bit_length()))
    whole = max(depth for depth, _, _ in buckets)
    slots = []
    for bucket, (depth, bits, more) in enumerate(buckets):
        first = bits << (whole - depth)
        slots += [(slot, bucket, depth, more) for slot in range(first, first + (1 << (whole - depth)))]
    return slots


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000, hash_expr=None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row for each row of ``docs``: row_uid, id, keep_id, group_size, kept, text_sha256, bucket (of groups, else null).

    ``hash_expr``: from a text column to a 64-bit hash column; weak ones make texts collide, for tests.
    """
    spark: SparkSession = docs.sparkSession
    hash_of = hash_expr or F.xxhash64
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    entries = materialize(texts.select("id", F.monotonically_increasing_id().alias("uid"), hash_of("text").alias("h"), F.unhex(F.sha2("text", 256)).alias("sha")), "dedup-entries")
    keys = entries.groupBy("h", "sha").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "uid")).alias("keep"))
    slot = lambda depth: F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    keys = materialize(keys.withColumn("prefix", slot(max_depth)), "dedup-keys")

    counts = {r["prefix"]: r["n"] for r in keys.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).collect()}  # 2**MAX_DEPTH rows at most
    slots = split_buckets(counts, capacity, max_depth)
    depth = (len(slots) - 1).bit_length()
    directory = F.broadcast(spark.createDataFrame(slots, "slot long, first int, depth int, more int"))
    further = F.expr(f"shiftrightunsigned(shiftleft(h, {depth}), 64 - more) & (shiftleft(1L, more) - 1)")
    bucket = F.when(F.col("more") > 0, further).otherwise(F.lit(0)).cast("long")
    placed = keys.withColumn("slot", slot(depth)).join(directory, "slot").withColumn("bucket", F.shiftleft(F.col("first").cast("long"), 32) + bucket)
    # an owner has its buckets' keys together: chains are made where the files are written, without another shuffle
    chain = Window.partitionBy("bucket", "h")
    owners = max(parallelism(spark), len({b for _, b, _, more in slots}) // 4, -(-sum(counts.values()) // (4 * capacity)))
    owned = placed.select("bucket", "h", "sha", "n", "keep").repartition(owners, "bucket")
    owned = owned.withColumn("rows", F.sum("n").over(chain)).withColumn("chain", F.count(F.lit(1)).over(chain))
    index = materialize(owned.sortWithinPartitions("bucket", "h"), "dedup-index")

    total = sum(counts.values())
    if not total:
        return entries.select("uid", "id").select(F.col("uid").alias("row_uid"), F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit("").alias("text_sha256"), F.lit(0).cast("long").alias("bucket"))
    # Hashes that more than one row has, be it copies or collisions: their texts' bytes are compared, no others.
    shared = materialize(index.where("rows > 1").select("bucket", "h", "chain").distinct(), "dedup-shared")
    n_shared = shared.count()
    candidates = semi_join(texts.select(hash_of("text").alias("h"), "text"), shared, ["h"], n_shared)
    chained = candidates.groupBy("h", "text").agg(F.count(F.lit(1)).alias("rows"))
    links = chained.groupBy("h", F.unhex(F.sha2("text", 256)).alias("sha")).agg(F.max("rows").alias("rows"), F.count(F.lit(1)).alias("texts"))
    same = F.when(F.col("texts") == 1, F.col("rows")).otherwise(F.raise_error(F.lit("two texts with one SHA-256 digest")).cast("long"))
    groups = index.where("n > 1").join(links.select("h", "sha", same.alias("group_size")), ["h", "sha"])
    groups = materialize(groups.select("h", "sha", "group_size", "keep", "bucket"), "dedup-groups")
    rows = hot_key_join(entries, groups, ["h", "sha"], "group_size", entries.count())
    return rows.select(
        F.col("uid").alias("row_uid"),
        F.col("id").alias(id_col),
        F.coalesce(F.col("keep"), F.struct("id", "uid"))["id"].alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.uid") == F.col("uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket",
    )


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``docs`` is written to the shared folder first, so that row numbers mean the same rows in both passes.
    """
    row = free_name(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "dedup-input")
    out = exact_dedup(numbered.select(F.struct(F.col(id_col).alias("id"), F.col(row).alias("row")).alias("id"), F.col(text_col).alias("text")), "id", "text")
    gone = out.where(~F.col("kept")).select(F.col("id.row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
