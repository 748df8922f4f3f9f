"""The corpus pipeline: from raw documents to packed training bins.

``run`` applies ``STAGES`` to the ``documents`` table. Each stage works on all that its
predecessor kept, gives the columns of ``documents`` (the last one: bins), and is written as a
table before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runtime_insights.llm.line_dedup import dedup_lines
from runtime_insights.llm.packing import best_fit
from runtime_insights.llm.quality import keep_good, train
from runtime_insights.llm.secret_scan import mask_secrets
from runtime_insights.llm.simhash import keep_one_of_each
from runtime_insights.llm.tables import short_batches, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    short_batches(spark)
    docs = docs.select(*COLUMNS)
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line of which a near copy came before goes."""
    return dedup_lines(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies stays."""
    short_batches(spark)
    return keep_one_of_each(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    short_batches(spark)
    masked = mask_secrets(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in a bin."""
    short_batches(spark)
    return best_fit(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("secret scan", secrets),
    ("best-fit packing", packing),
]

# The classifier, MinHash and best-fit packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = store(docs, f"pipeline-{number}")
    return docs
