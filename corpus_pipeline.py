"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents.

Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra columns of
any name are allowed in every stage: ``toxicity`` keeps rows with a null or empty text and judges each
row by its own text. ``near_duplicates`` keeps one row of each group, that with the smallest id (rows
without an id come last, ties go to the smaller hash of the text), and every row without words.
``substrings`` treats rows that repeat id and text as one document. ``mix`` repeats or drops whole rows, so equal
rows are rows like others. ``pack`` gives a null text its end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrand.llm import _queries, mixing, near_dup, packing, passages
from epistrand.llm import toxicity as toxicity_operator
from epistrand.llm._common import lookup, small_batches, stage, staged_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    model = _queries.toxic_model(docs, _queries.table(spark, sf_dir, "labels"))
    return toxicity_operator.keep_clean(docs, model, 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    # Rows of one id may differ in text, so a row is known by both.
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text"))
    found = stage(near_dup.near_duplicates(docs.select(key.alias("doc_id"), "text"), k=5, num=80, den=100), "near")
    gone = stage(found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    again = stage(found.where("kept and n_shingles > 0").groupBy(F.col("doc_id").alias("__again")).agg(F.count("*").alias("n")).where("n > 1").select("__again"), "again")
    kept = lookup(docs, gone, key == F.col("__gone"), "left_anti")
    if not again.limit(1).count():
        return kept
    once = lookup(kept, again, key == F.col("__again"), "left_anti")
    # Of rows that repeat id and text, the first by all columns stays; a group has few rows to compare, since one row a task goes on.
    rows = lookup(kept, again, key == F.col("__again"), "left_semi").select(key.alias("__key"), F.struct(*docs.columns).alias("__row"))
    return once.union(rows.groupBy("__key").agg(F.min("__row").alias("__row")).select("__row.*"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut."""
    return passages.remove(docs, passages.find(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "source", "text")  # whole rows, since ids may be null or repeated
    mixed = mixing.mix(rows, keep=["__row"]).where("copies > 0")
    return mixed.withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("__row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, _queries.tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mix", mix), ("pack", pack)]

#: SQL can't express the learnt scores of the first stage; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _queries.table(spark, sf_dir, "documents")
    for name, stage_of in STAGES:
        path = staged_path(spark, f"pipeline-{name}")
        stage_of(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
