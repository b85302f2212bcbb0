"""From raw documents to packed training sequences: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import fold_of, staged, table
from tidegauge.llm.packing import pack_documents
from tidegauge.llm.quality import keep_good
from tidegauge.llm.secret_scan import redact_documents
from tidegauge.llm.simhash import near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.7) go."""
    return keep_good(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 4) != 2)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows the one with the smallest id stays (no id is below all ids), of equal ids the
    one with the smallest hash of its text, then of its row. An id with texts in several groups stays in each whose row it
    is the first of."""
    number = "row_no"
    while number.lower() in map(str.lower, docs.columns):
        number += "_"
    rows = staged(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    classes = near_duplicates(rows, id_col=number).select(F.col("doc_id").alias(number), "component_id")
    order = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), F.xxhash64(*docs.columns).alias("row_hash"), F.col(number).alias("number"))
    first = rows.select(number, order.alias("place")).join(classes, number).groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.number").alias(number))
    return rows.join(first, number, "left_semi").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; what the scan finds in them is replaced, and n_chars follows."""
    return redact_documents(docs, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4,096 tokens."""
    packed = pack_documents(docs, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", F.col("piece_crc32").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("secret scan", secrets), ("best-fit packing", packing)]
ORACLE_SQL = None
"""SQL has neither the classifier nor the tokenizer; tests/llm holds the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
