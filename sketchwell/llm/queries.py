"""The thin queries over the tables: name -> f(spark, sf_dir); SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchwell.llm import chat, decontam, jaccard, licenses, media, mixing, quality, substrings, tokens, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, "score")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= model.options.threshold).cast("int").alias("predicted"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), good)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_as_media(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_documents(tokens.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), tokens.default_vocabulary(), end=1))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", *mixing.LEVELS, "mix_tokens", "mix_epoch")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_ngram_jaccard, op3_decontamination, op4_licenses, op5_token_output, op6_chat_format, op7_substring_dedup, op8_quality, op9_media, op10_mixing)}
ORACLES: dict[str, str] = {"op4_licenses": licenses.oracle(), "op6_chat_format": chat.oracle(), "op10_mixing": mixing.oracle()}
