"""Dataset tables: scan, replace, keyed upsert, metadata, incremental start, source choice, scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import keep_last
from ..schemas import conform


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``. Only a local session may leave it unset; it then
    gets a folder of its own for as long as it runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="spark-tidegauge-", dir="/tmp")
    return _local_folders[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def hand_off(df: DataFrame) -> DataFrame:
    """Stage boundary: a small daily table that several later branches read is checkpointed once, so they
    neither recompute it nor lose it with an executor."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Stage boundary for a large table: written once as parquet in the shared folder, so every later
    branch scans only the columns and rows it needs."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_panel(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Parquet scan with a declared schema; filters and pruned columns reach the files."""
    return spark.read.schema(ddl).parquet(path)


def save_dataset(df: DataFrame, path: str, partition_by: Sequence[str] = (), bounded: bool = False) -> None:
    """Replace the data set; ``bounded`` replaces only the partitions present in ``df``."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("partitionOverwriteMode", "dynamic" if bounded else "static").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key_columns: Sequence[str], row_order: str = "row_seq") -> DataFrame:
    """Union of both with the newest row per key: the new batch wins, later rows win within a batch."""
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    merged = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return keep_last(merged, list(key_columns), F.struct("_batch", row_order)).select(*columns)


def upsert_partitions(spark: SparkSession, path: str, new: DataFrame, key_columns: Sequence[str], partition: str, row_order: str = "row_seq") -> None:
    """Upsert into a partitioned data set, reading and rewriting only the partitions ``new`` touches."""
    stored = spark.read.parquet(path)
    touched = stored.join(new.select(partition).distinct(), partition, "left_semi")
    merged = hand_off(upsert(touched, new, key_columns, row_order))
    save_dataset(merged, path, [partition], bounded=True)


def dataset_metadata(df: DataFrame, source: str, version: str, notes: str = "", keys: Sequence[str] = (), date: str = "trade_date", code: str = "ts_code") -> DataFrame:
    """Date range, distinct symbols and row count; symbols are pre-aggregated so the count distributes."""
    per_code = df.groupBy(*keys, code).agg(F.min(date).alias("a"), F.max(date).alias("b"), F.count("*").alias("n"))
    return per_code.groupBy(*keys).agg(
        F.min("a").alias("date_start"), F.max("b").alias("date_end"), F.count(code).alias("symbol_count"), F.sum("n").alias("row_count"), F.lit(source).alias("source"), F.lit(version).alias("version"), F.lit(notes).alias("notes")
    )


def incremental_start(df: DataFrame, requested: str, pinned: bool = False, overlap_days: int = 5, keys: Sequence[str] = ("market",), date: str = "trade_date") -> DataFrame:
    """Day to resume from: the requested day when pinned, else not before the last stored day minus the overlap."""
    ask = F.lit(requested).cast("date")
    start = ask if pinned else F.greatest(ask, F.date_sub(F.max(date), overlap_days))
    return df.groupBy(*keys).agg(start.alias("start_date"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("header", True).csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a scratch table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def load_first_existing(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Newest contract table that exists."""
    for path in paths:
        if path_exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError("none of the tables exists: " + ", ".join(paths))


def select_source(candidates: DataFrame, start: str, end: str, keys: Sequence[str] = ("market",), rank: str = "source_rank", date: str = "trade_date") -> DataFrame:
    """Rows of the best-ranked source per key that is non-empty and covers the whole range."""
    spans = candidates.groupBy(*keys, rank).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    covering = spans.filter((F.col("a") <= F.lit(start).cast("date")) & (F.col("b") >= F.lit(end).cast("date")))
    chosen = covering.groupBy(*keys).agg(F.min(rank).alias(rank))
    return candidates.join(chosen, [*keys, rank], "left_semi")


def trading_calendar(raw: DataFrame, date: str = "cal_date") -> DataFrame:
    """Distinct open days of an exchange calendar."""
    from ..functions.text import number, parse_trade_date

    opened = raw.filter(number("is_open") == 1).select(parse_trade_date(date).alias("trade_date"))
    return opened.filter(F.col("trade_date").isNotNull()).distinct()


def business_days(spans: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Weekday fallback where no exchange calendar is available."""
    keys = [c for c in spans.columns if c not in (start, end)]
    days = spans.select(*keys, F.explode(F.sequence(F.col(start), F.col(end))).alias("trade_date"))
    return days.filter(~F.dayofweek("trade_date").isin(1, 7))


def load_observations(df: DataFrame, ddl: str) -> DataFrame:
    """Margin or option observations kept as delivered, with absent columns as typed NULL."""
    return conform(df, ddl)
