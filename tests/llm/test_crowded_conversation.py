"""op5_chat_format against its SQL on conversations with more messages in a piece than are rendered at once."""

import random

import duckdb

from glyphmill.llm import chat_format, queries


def test_crowded_conversation_equals_sql(spark, tmp_path):
    rng = random.Random(6)
    rows = [(1, None, rng.choice(["ann", "bob", "system"]), f"m{rng.randrange(10**6)} ü") for _ in range(900)]
    rows += [(2, rng.randrange(3), rng.choice(["ann", "bob"]), f"n{rng.randrange(10**6)}") for _ in range(1300)]
    rows += [(3, k, "ann" if k % 2 else "bob", f"o{k}") for k in range(70)] + rows[:5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op5_chat_format(spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = c.sql(queries.OP5_SQL)
    assert got.columns == want.columns
    got = sorted(tuple(r) for r in got.collect())
    assert got == sorted(want.fetchall())
    assert max(r[3] for r in got) > 4 * chat_format.PIECE
    in_order = chat_format.perspectives(df).where("conv_id = 1 and speaker = 'ann'").orderBy("block", "turn_key", "part").collect()
    assert len(in_order) > 1 and "".join(r.text for r in in_order) == next(r[4] for r in got if r[:2] == (1, "ann"))
