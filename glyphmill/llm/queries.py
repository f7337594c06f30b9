"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import chat_format, embedding_dedup, exact_dedup, html_extract, packing, sentencepiece_codec, sharding, simhash, token_files, toxicity
from glyphmill.llm.common import read_parquet, tokenizer_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), decoded=True)
    return out.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, ["doc_id"])
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = html_extract.extract(pages, html_extract.fit(pages), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.perspectives(table(spark, sf_dir, "conversations"), whole=True)
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("conv_id", "speaker", F.col("block").alias("piece"), F.col("n_messages").cast("long").alias("n_messages"), "text", spans.alias("mask"))


OP5_SQL = """
with said as (select conv_id, coalesce(turn, -1) as turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text
              from conversations group by all),
speakers as (select distinct conv_id, role as speaker from said where role <> 'system' or conv_id not in (select conv_id from said where role <> 'system')),
parts as (select s.conv_id, p.speaker, s.turn // 64 as piece, s.turn, s.role, s.text, s.role = p.speaker as own,
                 case when s.role = p.speaker then '<|assistant|>' when s.role = 'system' then '<|system|>' else '<|user name=' || s.role || '|>' end || chr(10) as head,
                 s.text || '<|end|>' || chr(10) as body
          from said s join speakers p using (conv_id)),
placed as (select *, sum(length(head) + length(body)) over (partition by conv_id, speaker, piece order by turn, role, text rows unbounded preceding) as upto from parts)
select conv_id, speaker, piece, count(*) as n_messages, string_agg(head || body, '' order by turn, role, text) as text,
       coalesce(string_agg(case when own then (upto - length(body))::bigint || '-' || upto::bigint end, ',' order by turn, role, text), '') as mask
from placed group by conv_id, speaker, piece
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("comp").alias("component_id"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", F.col("comp").alias("component_id"), (F.col("vec_id") == F.col("comp")).alias("kept"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_html_extraction": op4_html_extraction,
    "op5_chat_format": op5_chat_format,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_token_files": op9_token_files,
    "op10_embedding_dedup": op10_embedding_dedup,
}
ORACLES = {"op5_chat_format": OP5_SQL, "op6_exact_dedup": OP6_SQL}
