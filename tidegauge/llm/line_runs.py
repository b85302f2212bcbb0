"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches. A batch's distinct line hashes are counted, merge-anti-joined with the runs, which drops
lines already known to be common, and written as a run of level 0: a table bucketed and sorted by the hash, so that
joining and merging runs moves none of their rows. Two runs of a level are compacted to one of the next. Runs hold 16
bytes and a count for each line; texts never enter them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import drop_path
from .common import freed_shuffles, keyed_texts, shared_dir, staged

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ("h1", "h2")
SALTS = 32
ORDERING = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_keys(text: Column) -> Column:
    """Key of each line: blanks stripped at both ends, A-Z in lower case."""

    def key(line: Column) -> Column:
        bare = F.btrim(line, F.lit(BLANKS))
        return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))  # lower() is faster, but right for ASCII alone

    return F.transform(F.split(text, "\n"), key)


def hashed(key: Column) -> list[Column]:
    """128 bits of a key, as two independently seeded hashes."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


@contextmanager
def merging(spark: SparkSession) -> Iterator[None]:
    """Jobs inside take a bucket's single file as sorted, as it was written, and do not sort it again."""
    before = spark.conf.get(ORDERING, "false")
    spark.conf.set(ORDERING, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERING, before)


class LineRuns:
    """The runs by level, at most one in each. ``add`` takes a batch, ``common`` gives the hashes that ``min_docs`` documents
    or more hold."""

    def __init__(self, spark: SparkSession, min_docs: int) -> None:
        self.spark, self.min_docs = spark, min_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []
        self.folder = shared_dir(spark)

    def runs(self) -> list[str]:
        return [name for name in self.levels if name is not None]

    def write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        with merging(self.spark), freed_shuffles(self.spark):
            run.select(*HASH, "docs").write.format("parquet").bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        drop_path(self.spark, f"{self.folder}/{name}")

    def merged(self, left: str, right: str) -> DataFrame:
        """Two runs as one. Equal buckets meet in one task, so no row is shuffled."""
        a, b = (self.spark.table(name).select(*HASH, F.col("docs").alias(docs)).hint("merge") for name, docs in ((left, "docs_a"), (right, "docs_b")))
        return a.join(b, list(HASH), "full_outer").select(*HASH, (F.coalesce("docs_a", F.lit(0)) + F.coalesce("docs_b", F.lit(0))).alias("docs"))

    def fresh(self, lines: DataFrame) -> DataFrame:
        """Counts of a batch's lines that no run knows as common. The anti-joins stand as outer joins that keep what found
        no partner: Spark would move a ``left_anti`` below the count, where copies of a line are not yet merged."""
        own = lines.groupBy(*HASH).agg(F.count("*").alias("docs"))
        for name in self.runs():
            known = self.spark.table(name).where(F.col("docs") >= self.min_docs).select(*HASH, F.lit(True).alias("known")).hint("merge")
            own = own.join(known, list(HASH), "left").where(F.col("known").isNull()).drop("known")
        return own

    def compact(self, left: str, right: str) -> str:
        name = self.write(self.merged(left, right))
        self.drop(left)
        self.drop(right)
        return name

    def add(self, lines: DataFrame) -> None:
        """A batch of ``h1, h2``: one row for each distinct line of each of its documents. Its run takes level 0; where a
        level is taken, both runs merge into one for the next, so n batches stand in at most log2(n) + 1 runs."""
        run = self.write(self.fresh(lines))
        for level, other in enumerate(self.levels):
            if other is None:
                self.levels[level] = run
                return
            run, self.levels[level] = self.compact(other, run), None
        self.levels.append(run)

    def common(self) -> DataFrame:
        """Hashes of the common lines. All runs are compacted to one first. A line's count there can be too low, but never
        below ``min_docs`` for one that reaches it: only batches after it was reached leave the line out."""
        run = None
        for other in self.runs():
            run = other if run is None else self.compact(run, other)
        self.levels = [run]
        return self.spark.table(run).where(F.col("docs") >= self.min_docs).select(*HASH)

    def close(self) -> None:
        for name in self.runs():
            self.drop(name)
        self.levels = []


def common_lines(rows: DataFrame, min_docs: int, min_chars: int, batches: int) -> DataFrame:
    """(h1, h2) of the keys of ``min_chars`` code points or more that ``min_docs`` rows or more hold; rows (row_no, text)
    arrive in ``batches`` batches."""
    spark = rows.sparkSession
    batch = F.pmod(F.xxhash64("row_no"), F.lit(batches)).cast("int").alias("batch")
    keys = F.array_distinct(F.filter(line_keys(F.col("text")), lambda k: F.char_length(k) >= max(min_chars, 1)))
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    rows.select(batch, F.explode(keys).alias("key")).select("batch", *hashed(F.col("key"))).write.partitionBy("batch").parquet(path)
    arrived = spark.read.schema("h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(spark, min_docs)
    for number in range(batches):
        runs.add(arrived.where(F.col("batch") == number))
    found = staged(runs.common(), "common-lines")
    runs.close()
    drop_path(spark, path)
    return found


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row: lines whose key ``min_docs`` rows or more hold are gone, in every
    row; the others stay as they are, joined by line feeds.

    Each row is a document of its own: rows that repeat an id or a whole row count as often as they stand there. Null
    and empty texts are one empty line, which has no key and stays; so do lines of blanks. A row whose lines all go has
    an empty text. Null ids keep their row, extra columns are not read, an empty table gives no rows. A text is held
    whole by one task. A line in a third of all rows is dealt over ``SALTS`` tasks.
    """
    rows = staged(keyed_texts(docs, id_col, text_col).withColumn("row_no", F.monotonically_increasing_id()), "numbered-documents")
    common = common_lines(rows, min_docs, min_chars, batches)
    spread = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")  # its estimated size leaves the salts out
    lines = rows.select("row_no", F.posexplode(line_keys(F.col("text"))).alias("pos", "key")).where(F.char_length("key") >= max(min_chars, 1))
    marked = lines.select("row_no", "pos", *hashed(F.col("key")), F.pmod(F.col("row_no"), F.lit(SALTS)).cast("int").alias("salt"))
    gone = marked.join(spread, [*HASH, "salt"], "left_semi").groupBy("row_no").agg(F.array_sort(F.collect_list("pos")).alias("gone"))
    keep = F.flatten(F.transform("gone", lambda x, i: F.concat(F.array_repeat(F.lit(True), x - F.when(i == 0, -1).otherwise(F.get("gone", i - 1)) - 1), F.array(F.lit(False)))))
    found = rows.join(gone.select("row_no", "gone", keep.alias("keep")), "row_no", "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: F.coalesce(F.get("keep", i), F.lit(True)))
    return found.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
