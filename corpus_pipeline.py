"""From raw documents to token sequences: five stages, each by one operator of tessella.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import workers
from tessella.llm import _spark, mixing, ngram_join, pieces, quality, substring


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go, whole rows with all their columns.

    Null, empty and blank texts have too few words and go; texts are measured whole, however long; every row is judged by
    its own text, so repeated rows stay or go together; a null doc_id, lang or source does not matter; an empty table
    stays empty; extra columns of any name stay as they are.
    """
    workers.ready(spark)
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that word 5-grams link at a Jaccard similarity of 0.8 or more, one row stays: that of the
    smallest doc_id, of several with it the one with the least hash of its text, and of equal ids and texts the least row.

    A null doc_id is smaller than all others; rows with one doc_id and different texts are different documents; null,
    empty and blank texts are linked with nothing, and of those only rows equal in doc_id and text are one; an empty
    table stays empty; extra columns of any name stay as they are.
    """
    workers.ready(spark)
    found = ngram_join.groups(docs, k=5, percent=80).filter("first")
    found = _spark.cut(found.groupBy(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")).agg(F.count("*").alias("copies")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    stay = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    single = stay.filter("copies = 1").select("row")
    several = stay.filter("copies > 1").groupBy("kept_id", "kept_key").agg(F.min("row").alias("row")).select("row")
    return single.unionByName(several).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that lie in a run of 13 words or more which a document with a smaller doc_id has too go; every row stays.

    A text that loses nothing stays as it is, a null one too; one that loses all is empty; rows with equal doc_id take
    nothing from each other; a null doc_id is smaller than all others; texts are read whole; an empty table stays empty;
    extra columns of any name stay as they are.
    """
    workers.ready(spark)
    return substring.dedup(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document occurs as often as its source's rate draws, in random order.

    A null source is a source; null and empty texts count as one character; rows with equal doc_id draw alike, a null
    doc_id as the empty string; an empty table stays empty; extra columns of any name stay as they are.
    """
    return mixing.mix(docs).select(*docs.columns)


def token_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and ids, the pieces of each text.

    Null and empty texts have no ids; equal rows are cut alike; a null doc_id draws as 0; texts are cut whole; an empty
    table gives an empty one; extra columns are left out.
    """
    workers.ready(spark)
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixed_sources),
    ("SentencePiece encoding and decoding", token_sequences),
]
#: No SQL: the third and the last stage can't be put in it. tests/llm/test_pipeline.py has the same steps by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage before it returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = _spark.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
