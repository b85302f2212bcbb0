"""What both searches need: distinct keys with their smallest ids, and blocks of rows and queries to be compared."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_keys(rows: DataFrame, most: int) -> DataFrame:
    """(key, rep, ids) from (id, key): per distinct key its ``most`` smallest ids; ``rep`` is the smallest. Repeated rows
    count once. Ranks are cut in each partition before the shuffle, so a key with a third of all rows costs no task more."""
    order = Window.partitionBy("key").orderBy("id")
    ranked = rows.withColumn("at", F.dense_rank().over(order)).where(F.col("at") <= most)
    return ranked.groupBy("key").agg(F.min("id").alias("rep"), F.sort_array(F.collect_set("id")).alias("ids"))


def in_blocks(index: DataFrame, queries: DataFrame, by: list[str], compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, most_rows: int, most_queries: int) -> DataFrame:
    """``compare(rows, queries)`` for each bucket (equal ``by``) of (by..., rep, key) frames. A bucket of over
    ``most_rows`` rows or ``most_queries`` queries is cut into blocks. Pairs of blocks are spread over all shuffle partitions,
    for they are few bytes and much work, and are not to be coalesced."""
    sizes = index.groupBy(*by).agg(F.ceil(F.count("*") / most_rows).alias("row_blocks")).join(queries.groupBy(*by).agg(F.ceil(F.count("*") / most_queries).alias("query_blocks")), by)

    def dealt(df: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("rep"), F.col(own)).alias(own.removesuffix("s"))
        each = F.explode(F.sequence(F.lit(0), F.col(other).cast("long") - 1)).alias(other.removesuffix("s"))
        cut = df.join(sizes, by).select(*by, "rep", "key", block, own, other).select(*by, "rep", "key", own.removesuffix("s"), each)
        return cut.select(*by, F.col("row_block").cast("long").alias("row_block"), F.col("query_block").cast("long").alias("query_block"), "rep", "key", F.lit(is_query).alias("is_query"))

    both = dealt(index, "row_blocks", "query_blocks", False).union(dealt(queries, "query_blocks", "row_blocks", True))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asked = group["is_query"].to_numpy(bool)
        return compare(group[~asked], group[asked])

    pair = [*by, "row_block", "query_block"]
    spread = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), *pair)
    return spread.groupBy(*pair).applyInPandas(run, schema)


def nearest_ids(pairs: DataFrame, keys: DataFrame, queries: DataFrame, k: int, order: Column, measure: str) -> DataFrame:
    """(query_id, rank, id, ``measure``): ``k`` first by ``order`` then id, the query's own id left out. ``pairs``: (query,
    rep, measure) between representatives, with at least the k + 1 first of each query; ``queries``: (query_id, query)."""
    first = Window.partitionBy("query").orderBy(order, "rep")
    best = pairs.groupBy("query", "rep").agg(F.max(measure).alias(measure)).withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    listed = best.join(keys.select("rep", "ids"), "rep").select("query", F.explode("ids").alias("id"), measure)
    kept = listed.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(order, "id"))).where(F.col("at") <= k + 1).drop("at")
    mine = queries.join(kept, "query").where("id <> query_id")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", measure)
