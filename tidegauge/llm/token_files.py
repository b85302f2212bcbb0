"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped on reading.

Folder of one data set: for each range of document ids a file ``<n>.ids`` (unsigned 16-bit if every id fits, else
32-bit), ``<n>.offsets`` (signed 64-bit, one more than documents: where each document's ids begin) and ``<n>.docs``
(signed 64-bit document ids), all little-endian. Ranges ascend with n. The base of a range is the number of ids in
the ranges before it, a prefix sum over ranges.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_texts, shared_dir, staged, without_gc
from .word_bpe import default_path, word_encoder

NO_ID = np.iinfo(np.int64).min
"""Stands for a null document id in ``.docs``."""


def local_folder(uri: str) -> str:
    """The mounted path of a folder; memory mapping needs one."""
    parts = urlsplit(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped; {parts.scheme}: folders must be mounted first")
    return parts.path


def put(path: str, data: np.ndarray) -> None:
    """Whole or not at all, also if two attempts of a task write at once: a file of its own, then a rename."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as out:
        data.tofile(out)
    os.replace(own, path)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, id_type: str = "<u2", ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, adds ``end_id`` and writes ids in ascending order of document id (nulls first, equal ids by
    the hash of the text, then by place in the input, so an id with many rows takes several ranges). Returns (range, n_docs,
    n_tokens, ids_file) as a staged table; an empty table gives no files. ``ranges`` defaults to the shuffle partitions of
    the session. Null texts are empty; extra columns are not read. A task that runs again writes the same files anew, given an
    input whose rows come again in the same order, as those of a stored table do."""
    spark, target, path = docs.sparkSession, local_folder(folder), path or default_path()
    os.makedirs(target, exist_ok=True)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = np.iinfo(np.dtype(id_type)).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, n = word_encoder(path), TaskContext.get().partitionId()
        name = f"{target}/{n:08d}"
        own = f"{name}.ids.{uuid.uuid4().hex}"
        ids, lengths = [], []
        with open(own, "wb") as out:
            for batch in without_gc(batches):
                for docs, rows in encoder.ended(batch, end_id):
                    ids.append(docs.fill_null(NO_ID).to_numpy())
                    lengths.append(pc.binary_length(rows).to_numpy() // 4)
                    tokens = np.frombuffer(rows.buffers()[2], "<u4", lengths[-1].sum())
                    if tokens.max() > limit:
                        raise ValueError(f"an id over {limit} does not fit {id_type}")
                    tokens.astype(id_type).tofile(out)
        if not ids:
            os.remove(own)
            return
        ids, offsets = np.concatenate(ids), np.concatenate([[0], *lengths]).cumsum(dtype=np.int64)
        put(f"{name}.offsets", offsets.astype("<i8"))
        put(f"{name}.docs", ids.astype("<i8"))
        os.replace(own, f"{name}.ids")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([offsets[-1]], pa.int64()), pa.array([f"{name}.ids"])], ["range", "n_docs", "n_tokens", "ids_file"])

    order = ["doc_id", "text_hash", "place"]  # the place parts rows that are equal in both, so no id fills one range
    placed = keyed_texts(docs, id_col, text_col).withColumns({"text_hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    dealt = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return staged(dealt.mapInArrow(run, "range long, n_docs long, n_tokens long, ids_file string"), "token-ranges")


def with_bases(files: DataFrame) -> DataFrame:
    """Adds ``base``: ids in all ranges before. A row per file, so the ordered pass is small."""
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(files: DataFrame, id_type: str = "<u2", slice_tokens: int = 1 << 20) -> DataFrame:
    """(doc_id, start, ids) of every document in files that ``write_token_files`` returned: ``start`` counts the ids of
    all documents before it, ``ids`` are little-endian unsigned 32-bit. Files are mapped, not loaded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stem = row["ids_file"].removesuffix(".ids")
                tokens = np.memmap(row["ids_file"], id_type, "r")
                offsets, docs = np.memmap(f"{stem}.offsets", "<i8", "r"), np.memmap(f"{stem}.docs", "<i8", "r")
                if len(tokens) != row["n_tokens"] or len(docs) != row["n_docs"]:
                    raise OSError(f"{stem} is not the file that was written")
                a = 0
                while a < len(docs):
                    b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + slice_tokens, "right")) - 1)
                    own = np.array(docs[a:b])
                    cut = [tokens[offsets[i] : offsets[i + 1]].astype("<u4").tobytes() for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(offsets[a:b] + row["base"], pa.int64()), pa.array(cut, pa.binary())], ["doc_id", "start", "ids"])
                    a = b

    spread = with_bases(files)
    return spread.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "range").mapInArrow(run, "doc_id long, start long, ids binary")


def token_file_round_trip(docs: DataFrame, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents to a new folder in the shared one and reads them back."""
    folder = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, path, end_id, id_col=id_col, text_col=text_col))
