"""Multi-party perspective rotation of dialogues. DataFrame operations only.

For every participant of a conversation, the dialogue is rendered with that speaker as the assistant and the others as
named users; the mask has the character spans that the speaker says, the ones to learn from. Conversations are rendered
in pieces of PIECE turn numbers, so that none is ever gathered in one task; the pieces of a perspective in ascending
order make up the whole dialogue.

Defined results: turns are ordered by (turn, role, text); a null turn counts as -1 (before the others, in
piece 0, for numbers are divided towards zero), a null role is the speaker
``unknown``, a null text is empty and a null conv_id is a conversation of its own. A row that repeats another in all
four columns is one message delivered again: it is rendered once and n_rows counts it. Narrators (role ``system``) are
rendered under their role and have no perspective of their own, unless nobody else speaks. Turn numbers that more than
PIECE * 4 messages of a conversation fall on are split into parts of so many, in the order of the parts. ``whole`` puts
the rows of such a piece together again: one row for each piece of a perspective, with turn_key null and part 0. An empty
table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import BROADCAST_ROWS, hot_key_join, materialize

#: Turn numbers to a piece.
PIECE = 64
NARRATORS = ("system",)


def perspectives(turns: DataFrame, piece: int = PIECE, narrators: tuple[str, ...] = NARRATORS, whole: bool = False) -> DataFrame:
    """conv_id, speaker, block, turn_key, part, n_messages, n_rows, text, mask (array of start, end)."""
    said = turns.select(
        "conv_id",
        F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    said = said.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n_rows"))
    said = materialize(said.withColumn("block", F.expr(f"turn div {piece}")), "chat-messages")

    most = piece * 4
    crowded = materialize(said.groupBy("conv_id", "block", "turn").agg(F.count(F.lit(1)).alias("at_turn")).groupBy("conv_id", "block").agg(F.sum("at_turn").alias("in_block")).where(F.col("in_block") > most), "chat-crowded")
    n_crowded = crowded.count()
    if n_crowded:
        right = crowded.withColumnsRenamed({"conv_id": "c", "block": "b"})
        right = F.broadcast(right) if n_crowded <= BROADCAST_ROWS // 10 else right
        said = said.join(right, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
        place = F.row_number().over(Window.partitionBy("conv_id", "block", "turn").orderBy("role", "text"))
        said = said.withColumn("turn_key", F.when(F.col("c").isNotNull() | F.col("b").isNotNull(), F.col("turn"))).withColumn("part", F.floor((place - 1) / most).cast("long"))
    else:
        said = said.withColumn("turn_key", F.lit(None).cast("long")).withColumn("part", F.lit(0).cast("long"))
    pieces = said.groupBy("conv_id", "block", "turn_key", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"), F.sum("n_rows").alias("n_rows"))

    # a row for each conversation with its speakers; the pieces of a hot conversation meet it by a broadcast
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    roles = said.groupBy(key.alias("c")).agg(F.collect_set("role").alias("roles"), F.count(F.lit(1)).alias("messages_of"))
    speaking = F.filter("roles", lambda r: ~r.isin(*narrators))
    roles = roles.select("c", "messages_of", F.when(F.size(speaking) > 0, speaking).otherwise(F.col("roles")).alias("speakers"))
    out = hot_key_join(pieces.withColumn("c", key), materialize(roles, "chat-roles"), ["c"], "messages_of", said.count())
    out = out.withColumn("speaker", F.explode("speakers")).drop("c", "messages_of", "speakers")

    head = lambda m: F.when(m["role"] == F.col("speaker"), F.lit("<|assistant|>\n")).when(m["role"].isin(*narrators), F.concat(F.lit("<|"), m["role"], F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), m["role"], F.lit("|>\n")))
    foot = F.lit("<|end|>\n")
    out = out.withColumn("parts", F.transform("messages", lambda m: F.struct((m["role"] == F.col("speaker")).alias("own"), F.length(head(m)).alias("head"), F.concat(m["text"], foot).alias("body"), F.concat(head(m), m["text"], foot).alias("whole"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda a, p: F.struct(
        (a["at"] + F.length(p["whole"])).alias("at"),
        F.when(p["own"], F.concat(a["spans"], F.array(F.struct((a["at"] + p["head"]).alias("start"), (a["at"] + p["head"] + F.length(p["body"])).alias("end"))))).otherwise(a["spans"]).alias("spans"),
    )
    out = out.select("conv_id", "speaker", "block", "turn_key", "part", F.size("messages").alias("n_messages"), "n_rows", F.array_join(F.transform("parts", lambda p: p["whole"]), "").alias("text"), F.aggregate("parts", start, step)["spans"].alias("mask"))
    if not (whole and n_crowded):
        return out
    own = F.sort_array(F.collect_list(F.struct("turn_key", "part", "text", "mask")))
    out = out.groupBy("conv_id", "speaker", "block").agg(F.sum("n_messages").cast("int").alias("n_messages"), F.sum("n_rows").alias("n_rows"), own.alias("own"))
    moved = lambda a, p: F.struct(
        (a["at"] + F.length(p["text"])).alias("at"),
        F.concat(a["spans"], F.transform(p["mask"], lambda m: F.struct((a["at"] + m["start"]).alias("start"), (a["at"] + m["end"]).alias("end")))).alias("spans"),
    )
    return out.select("conv_id", "speaker", "block", F.lit(None).cast("long").alias("turn_key"), F.lit(0).cast("long").alias("part"), "n_messages", "n_rows", F.array_join(F.transform("own", lambda p: p["text"]), "").alias("text"), F.aggregate("own", start, moved)["spans"].alias("mask"))
