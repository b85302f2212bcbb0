"""What the operators share: the documents frame, folding, the shared folder, staged tables, Arrow helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_CHARS = 1 << 20
"""Characters that a task works on at a time; a longer text is a slice of its own."""

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, as the session names it. Only a local session, as in tests,
    may leave it unset and then gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    folder = tempfile.mkdtemp(prefix="spark-llm-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs inside remove their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (null becomes empty); all other columns go, whatever their names."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def fold_of(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters in all."""
    return slices_of(list(map(len, texts)), most)


def slices_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` in all, given the size of each."""
    start = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def words_of(text: str) -> list[bytes]:
    """UTF-8 words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; other letters stay."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def int_lists(rows: list[bytes]) -> pa.ListArray:
    """Lists of 32-bit integers from their little-endian bytes."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32()))


def without_gc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; no search for cycles meanwhile, which would walk all remembered values again and again. The code
    that takes them makes no cycles."""
    gc.disable()
    try:
        yield from batches
    finally:
        gc.enable()


class Recent:
    """Values of keys met lately: two generations of ``most`` keys, the older dropped when the newer is full; ``make``
    gives those of a list of new keys. It changes speed only."""

    def __init__(self, make: Callable[[list], list], most: int):
        self.make, self.most = make, most
        self.now: dict = {}
        self.before: dict = {}

    def many(self, keys: list) -> list:
        """No value may be None."""
        found = list(map(self.now.get, keys))
        if None in found:
            gaps = [i for i, value in enumerate(found) if value is None]
            new = {keys[i] for i in gaps}
            fresh = {key: self.before[key] for key in new if key in self.before}  # before the generations change, or they would be lost
            new = list(new.difference(fresh))
            fresh.update(zip(new, self.make(new), strict=True))
            if len(self.now) + len(fresh) > self.most:
                self.before, self.now = self.now, {}
            self.now.update(fresh)
            for i in gaps:
                found[i] = fresh[keys[i]]
        return found

    def grouped(self, groups: list[list]) -> list[list]:
        """``many`` of each group, all at once."""
        found = self.many(list(chain.from_iterable(groups)))
        ends = list(accumulate(map(len, groups)))
        return [found[a:b] for a, b in zip([0, *ends], ends, strict=False)]
