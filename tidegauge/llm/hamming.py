"""Exact top-k by Hamming distance: incremental multi-index hashing.

Codes are cut into segments of about as many bits as the number of codes has, each with a table from value to codes. A
query looks up its own segment values, then values one bit away, two bits away and so on, segment by segment. With a
segments searched to radius r and the others to r - 1, every code within m r + a - 1 bits has been seen; the search ends
when that covers the k-th distance verified so far. Codes are dealt over blocks of bounded size, each with its own tables;
every query meets every block, and the blocks' answers are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import distinct_keys, in_blocks, nearest_ids


@lru_cache(maxsize=None)
def flips(bits: int, radius: int) -> np.ndarray:
    """Numbers of ``bits`` bits with ``radius`` of them set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], np.int64)


def as_words(codes: np.ndarray) -> np.ndarray:
    """(words, codes) of 64 bits from (codes, bytes); zeros fill the last word."""
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64).T)


class SegmentTables:
    """Tables of a block of codes, an array (codes, bytes)."""

    def __init__(self, codes: np.ndarray):
        self.n, self.bits = len(codes), 8 * codes.shape[1]
        width = max(1, self.n.bit_length() - 1)
        self.segments = np.array_split(np.arange(self.bits), -(-self.bits // width))
        self.words, self.order, self.ends = as_words(codes), [], []
        for segment, values in zip(self.segments, self.values(codes), strict=True):
            self.order.append(np.argsort(values, kind="stable"))
            self.ends.append(np.concatenate([[0], np.bincount(values, minlength=1 << len(segment)).cumsum()]))

    def values(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """Of each segment the values that ``codes`` have there."""
        bits = np.unpackbits(codes, axis=1)
        for segment in self.segments:
            value = np.zeros(len(codes), np.int64)
            for bit in segment:
                value = 2 * value + bits[:, bit]
            yield value

    def at_radius(self, segment: int, value: int, radius: int) -> np.ndarray:
        values = flips(len(self.segments[segment]), radius) ^ value
        first, last = self.ends[segment][values], self.ends[segment][values + 1]
        many = last - first
        return self.order[segment][np.repeat(last - many.cumsum(), many) + np.arange(many.sum())]

    def nearest(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of ``queries``, an array (queries, bytes), numbers and distances of the ``k`` nearest, equals by number;
        all codes if fewer."""
        return [self.nearest_to(word, value, min(k, self.n)) for word, value in zip(as_words(queries).T, zip(*self.values(queries), strict=True), strict=True)]

    def nearest_to(self, word: np.ndarray, value: tuple[int, ...], k: int) -> tuple[np.ndarray, np.ndarray]:
        unseen, found, distances = np.ones(self.n, bool), [], []
        histogram = np.zeros(self.bits + 1, np.int64)
        for radius in range(max(map(len, self.segments)) + 1):
            for segment in range(len(self.segments)):
                near = self.at_radius(segment, value[segment], radius)
                near = near[unseen[near]]
                unseen[near] = False
                found.append(near)
                distances.append(np.bitwise_count(self.words[:, near] ^ word[:, None]).sum(axis=0, dtype=np.int64))
                histogram += np.bincount(distances[-1], minlength=self.bits + 1)
                covered = min(self.bits, len(self.segments) * radius + segment)
                if histogram[: covered + 1].sum() >= k:
                    numbers, distance = np.concatenate(found), np.concatenate(distances)
                    numbers, distance = numbers[distance <= covered], distance[distance <= covered]
                    best = np.lexsort((numbers, distance))[:k]
                    return numbers[best], distance[best]
        raise AssertionError("all values of a segment cover every code")


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, key): a bit per component, 1 if above zero (null and not-a-number are 0), first component highest. Rows with
    a null id or a null or empty vector are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("v"))
            for size in pc.unique(sizes.filter(pc.greater(sizes, 0))).to_pylist():
                own = batch.filter(pc.and_(pc.equal(sizes, size), batch.column("id").is_valid()))
                above = pc.fill_null(pc.greater(own.column("v").flatten(), 0.0), False).to_numpy(zero_copy_only=False)
                keys = [key.tobytes() for key in np.packbits(above.reshape(-1, size), axis=1)]
                yield pa.RecordBatch.from_arrays([own.column("id"), pa.array(keys, pa.binary())], ["id", "key"])

    return vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v")).mapInArrow(run, "id long, key binary")


def hamming_top_k(codes: DataFrame, is_query: Column, k: int = 10, block: int = 1 << 20, queries_at_once: int = 2048) -> DataFrame:
    """(query_id, rank, id, distance) of the ``k`` nearest codes of every query, exact, ties to the smaller id, the query's
    own id left out. ``codes``: (id, key binary); ``is_query``: a condition on ``id``.

    Codes are compared with those of their own length. Rows with a null id or a null or empty key take no part; equal rows count once;
    fewer other ids than ``k`` give fewer rows; an empty table gives none.
    """
    rows = staged(codes.where("id is not null and octet_length(key) > 0"), "codes")
    keys = staged(distinct_keys(rows, k + 1), "distinct-codes")
    asking = rows.where(is_query).distinct().join(keys.select("key", "rep"), "key").select(F.col("id").alias("query_id"), F.col("rep").alias("query"))
    index = keys.select(F.octet_length("key").alias("length"), "rep", "key")
    asked = asking.select(F.col("query").alias("rep")).distinct().join(index, "rep").select("length", "rep", "key")

    def compare(found: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("rep")
        length = len(found["key"].iloc[0])
        as_bytes = lambda frame: np.frombuffer(b"".join(frame["key"]), np.uint8).reshape(len(frame), length)
        reps, tables = found["rep"].to_numpy(), SegmentTables(as_bytes(found))
        answers = tables.nearest(as_bytes(queries), k + 1)
        return pd.DataFrame({"query": np.repeat(queries["rep"].to_numpy(), [len(a[0]) for a in answers]), "rep": reps[np.concatenate([a[0] for a in answers])], "distance": np.concatenate([a[1] for a in answers])})

    pairs = in_blocks(index, asked, ["length"], compare, "query long, rep long, distance long", block, queries_at_once)
    return nearest_ids(pairs, keys, asking, k, F.asc("distance"), "distance")
