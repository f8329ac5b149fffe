"""A corpus through five stages: toxicity, near duplicates, benchmark passages, mixture, token ids.

Every stage reads the columns of documents and ignores others. Null and empty texts pass the first three stages (no
stage finds anything in them), count one token in the mixture and are an end id alone in the output. Texts of any length
are read whole. Documents without an id stay in the filtering stages, but for the first, which judges texts. Rows that share an id are one
document from the second stage on: the least row of them by its other columns stays. Ties are broken as each operator says. Empty tables: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchwell.llm import decontam, jaccard, mixing, tokens, toxicity
from sketchwell.llm.common import reachable, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression model does not reject; their rows as they were, repeated ones too."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model, "toxicity").where(F.col("toxicity") < model.options.threshold).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets of similarity 0.8: the one whose id names the group.
    Of rows with one id, the least by the other columns; documents without an id stay."""
    docs = docs.select(*COLUMNS)
    groups = jaccard.near_duplicates(docs, num=80, den=100, width=5)
    copies = stored(groups.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    left = docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)
    again = stored(left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.limit(1).count():
        return left
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = left.join(again, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", *(F.col(f"row.{c}") for c in rest))
    return left.join(again, "doc_id", "left_anti").select(*COLUMNS).unionAll(one.select(*COLUMNS))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; those without an id stay."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.select(*COLUMNS).join(stored(found.select("doc_id").distinct(), "leaks"), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture; a document chosen for several epochs is there as often. Null languages and sources are groups of their own."""
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written as directly addressable codes; what a reader finds in them, a row for each row."""
    return tokens.read_documents(tokens.write_shards(docs, tokens.default_vocabulary()))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Learnt dictionaries, edit distances and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    reachable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
