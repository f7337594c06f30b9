"""Views over the driver's tables that give the operators rasters, boxes, words and network inputs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.pages import spread

PX_SQL = """px as (select l_orderkey // 1500 as page_id, l_partkey % 100 as x, (l_suppkey*7 + l_linenumber*13 + l_orderkey) % 100 as y,
 cast(min(cast(floor(l_extendedprice) as bigint) % 256) as int) as gray from lineitem group by 1,2,3)"""
BX_SQL = """bx as (select l_orderkey // 1500 as page_id, l_orderkey*10 + l_linenumber as comp_id,
 cast(min((l_partkey*37) % 2000) as int) as x0, cast(min((l_suppkey*53 + l_linenumber*11 + l_orderkey) % 2800) as int) as y0,
 cast(min(4 + cast(floor(l_quantity) as bigint) % 30) as int) as w, cast(min(6 + l_partkey % 20) as int) as h from lineitem group by 1,2)"""
LEX_SQL = """lex as (select w, count(*) as n from (select unnest(regexp_extract_all(lower(text),'[a-z]+')) as w from benchmark) where length(w) >= 2 group by w)"""
QW_SQL = """qw as (select distinct w from (select unnest(regexp_extract_all(lower(text),'[a-z]+')) as w from documents) where length(w) >= 2)"""
CHARS_SQL = """chars as (select conv_id, turn, pos, substring(text, pos::int, 1) as ch from (select conv_id, turn, text, unnest(range(1, length(text)+1)) as pos from conversations where length(text) > 0))"""
NN_SQL = """nnin as (select vec_id, label, list_transform(embedding[1:48], lambda v: cast(v as double)) as f from embeddings)"""

#: Over the width of the rasters below, which are 100 x 100; the SQL numbers components by it.
STRIDE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px(page_id, x, y, gray): sparse rasters of 100 x 100."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.expr("l_orderkey div 1500").alias("page_id"),
        (F.col("l_partkey") % 100).alias("x"),
        ((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_orderkey")) % 100).alias("y"),
    ).agg(F.min(F.floor("l_extendedprice") % 256).cast("int").alias("gray"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bx(page_id, comp_id, x0, y0, w, h): boxes on pages of 2000 x 2800."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.expr("l_orderkey div 1500").alias("page_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("comp_id")
    ).agg(
        F.min((F.col("l_partkey") * 37) % 2000).cast("int").alias("x0"),
        F.min((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 11 + F.col("l_orderkey")) % 2800).cast("int").alias("y0"),
        F.min(4 + F.floor("l_quantity") % 30).cast("int").alias("w"),
        F.min(6 + F.col("l_partkey") % 20).cast("int").alias("h"),
    )


def _words(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).where(F.length("w") >= 2)


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lex(w, n): dictionary words and their counts."""
    return _words(table(spark, sf_dir, "benchmark")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qw(w): words to check, of all documents."""
    return _words(table(spark, sf_dir, "documents")).distinct()


def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chars(conv_id, turn, pos, ch): the members of lines, of whole texts."""
    return (
        table(spark, sf_dir, "conversations")
        .where(F.length("text") > 0)
        .select("conv_id", "turn", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("pos"))
        .select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.expr("substring(text, pos, 1)").alias("ch"))
    )


def network_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nnin(vec_id, label, f): 48 numbers for the network."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 48), lambda v: v.cast("double")).alias("f"))


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, width, height, raster: the rasters as page images of 100 x 100, white where there is no pixel."""

    def draw(page: pd.DataFrame) -> pd.DataFrame:
        gray = np.full((100, 100), 255, dtype=np.uint8)
        gray[page["y"].to_numpy(), page["x"].to_numpy()] = page["gray"].to_numpy()
        return pd.DataFrame({"path": [f"page-{page['page_id'].iloc[0]:06d}"], "width": [100], "height": [100], "raster": [gray.tobytes()]})

    return spread(pixels(spark, sf_dir), "page_id").groupBy("page_id").applyInPandas(draw, "path string, width int, height int, raster binary")
