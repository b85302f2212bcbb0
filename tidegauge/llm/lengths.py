"""Token counts by an exact length histogram: documents per encoded length, and suffix sums that answer totals,
quantiles and truncated totals for every context limit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_texts

BYTE_FILE = "byte_bpe_50k.tiktoken"
BLOCK = 4096


@lru_cache(maxsize=2)
def byte_encoder(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row by the byte-level ranks in ``path``; null and empty texts have 0 tokens."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path(BYTE_FILE), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(path, pattern).encode_ordinary
        for batch in batches:
            counts = [len(encode(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): one row per length that occurs. Null lengths count as 0."""
    return lengths.groupBy(F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def with_running(hist: DataFrame, **values: Column) -> DataFrame:
    """Adds the sum of each value over this and all greater lengths. Blocks of ``BLOCK`` lengths are summed first, so
    that the one ordered pass runs over a row per block (the greatest length over ``BLOCK`` rows at most)."""
    rows = hist.withColumns({"block": F.floor(F.col("n_tokens") / BLOCK), **{f"own_{k}": v for k, v in values.items()}})
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(*[F.sum(f"own_{k}").alias(k) for k in values])
    above = blocks.select("block", *[F.coalesce(F.sum(k).over(later), F.lit(0)).alias(f"above_{k}") for k in values])
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(above, "block").select(*hist.columns, *[(F.sum(f"own_{k}").over(within) + F.col(f"above_{k}")).alias(k) for k in values])


def length_table(hist: DataFrame) -> DataFrame:
    """For every length L that occurs: n_docs of it; docs_at_least and tokens_at_least L; docs_at_most L; quantile (the
    share of documents of at most L tokens); truncated_total, the tokens left if L is the context limit. All sums are
    exact. An empty table has no rows."""
    sums = with_running(hist, docs_at_least=F.col("n_docs"), tokens_at_least=F.col("n_docs") * F.col("n_tokens"))
    total = hist.agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    rows = sums.crossJoin(F.broadcast(total))  # one row of totals
    at_most = F.col("docs") - F.col("docs_at_least") + F.col("n_docs")
    shorter = F.col("tokens") - F.col("tokens_at_least")
    return rows.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", at_most.alias("docs_at_most"), (at_most / F.col("docs")).alias("quantile"), (shorter + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"))


def truncated_totals(table: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, truncated_total) for any limits, attained or not, from ``length_table``: the next greater length
    that occurs has the sums. A limit above all lengths gives the whole total."""
    spark = table.sparkSession
    asked = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "context_limit long"))
    pairs = asked.join(table, table.n_tokens >= asked.context_limit, "left")
    nearest = pairs.groupBy("context_limit").agg(F.min_by(F.struct("n_tokens", "docs_at_least", "truncated_total"), "n_tokens").alias("next"))
    whole = table.agg(F.coalesce(F.max("truncated_total"), F.lit(0)).alias("whole"))
    cut = F.col("next.truncated_total") - (F.col("next.n_tokens") - F.col("context_limit")) * F.col("next.docs_at_least")
    return nearest.crossJoin(F.broadcast(whole)).select("context_limit", F.coalesce(cut, "whole").alias("truncated_total"))


def quantiles(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of documents does not exceed."""
    asked = F.broadcast(table.sparkSession.createDataFrame([(float(x),) for x in shares], "share double"))
    return asked.join(table, table["quantile"] >= asked.share, "left").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``length_table`` of all texts. Repeated rows count each; null ids count; extra columns are not read."""
    return length_table(length_histogram(encoded_lengths(docs, path, id_col, text_col)))
