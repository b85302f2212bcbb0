"""Approximate nearest neighbours: multiprobe hashing with p-stable (Gaussian) projections.

Unit vectors fall into buckets by floor((a v + b) / w) of several projections, in several tables. A query visits its own
bucket and then perturbed ones in the order of estimated success (sum of squared distances to the walls crossed).
Candidates of all tables are ranked by exact cosine inside the buckets and merged. Vectors of each length have
projections and buckets of their own. How many probes are needed is read off a bounded sample of queries whose true
neighbours are found by brute force.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .vectors import distinct_keys, in_blocks, nearest_ids


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, key): vectors as little-endian doubles, halved or doubled until the largest component is between 0.5 and 1,
    so that no norm overflows or vanishes. Rows with a null id, a null, zero or empty vector, or a null or non-finite
    component are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is not None and v and None not in v:
                    x = np.array(v, float)
                    largest = np.abs(x).max()
                    if 0 < largest < np.inf:
                        out.append((i, (np.ldexp(x, -np.frexp(largest)[1]) + 0.0).astype("<f8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["id", "key"])

    return vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v")).mapInArrow(run, "id long, key binary")


def matrix(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<f8").reshape(len(keys), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Tables:
    """``normals`` (tables, dims, hashes) and ``offsets`` (tables, hashes) of the projections; width of a slot."""

    normals: np.ndarray
    offsets: np.ndarray
    width: float
    probes: int = 1

    def places(self, x: np.ndarray) -> np.ndarray:
        """(tables, rows, hashes): projections in slots."""
        return (np.einsum("nd,tdh->tnh", unit(x), self.normals) + self.offsets[:, None, :]) / self.width


def bucket_keys(slots: np.ndarray) -> np.ndarray:
    """64-bit name of each row of slot numbers; its mixing keeps different rows apart but for chance of 2^-64."""
    h = np.full(slots.shape[:-1], 0x9E3779B97F4A7C15, np.uint64)
    for k in range(slots.shape[-1]):
        h = (h ^ slots[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def perturbations(place: np.ndarray, most: int) -> list[np.ndarray]:
    """Up to ``most`` slot rows of one query in one table, by falling estimated success; the own bucket is first."""
    own = np.floor(place)
    if not len(own):
        return [own]
    inside = place - own
    walls = sorted([(x * x, k, -1) for k, x in enumerate(inside)] + [((1 - x) ** 2, k, 1) for k, x in enumerate(inside)])
    out, heap = [own], [(walls[0][0], (0,))]
    while heap and len(out) < most:
        cost, chosen = heapq.heappop(heap)
        if len({walls[j][1] for j in chosen}) == len(chosen):
            slots = own.copy()
            for j in chosen:
                slots[walls[j][1]] += walls[j][2]
            out.append(slots)
        last = chosen[-1]
        if last + 1 < len(walls):
            heapq.heappush(heap, (cost - walls[last][0] + walls[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + walls[last + 1][0], (*chosen, last + 1)))
    return out


def top_cosines(rows: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries, k) cosines and row numbers, best first, equals by row number."""
    scores = (asked @ rows.T) / np.outer(np.sqrt((asked * asked).sum(axis=1)), np.sqrt((rows * rows).sum(axis=1)))
    k = min(k, scores.shape[1])
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    best = np.argsort(np.where(scores >= kth, -scores, np.inf), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, best, axis=1), best


def true_neighbours(keys: DataFrame, sample: list[tuple[int, bytes]], k: int) -> list[tuple[int, bytes]]:
    """(number in sample, key) of the ``k`` nearest distinct vectors of each sample vector, by brute force."""
    asked, own = matrix([key for _, key in sample]), [rep for rep, _ in sample]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                raw, reps = part.column("key").to_pylist(), part.column("rep").to_pylist()
                scores, best = top_cosines(matrix(raw), asked, k + 1)
                found = [(i, raw[b], float(s)) for i in range(len(own)) for b, s in zip(best[i], scores[i], strict=True) if reps[b] != own[i]]
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int32(), pa.binary(), pa.float64()))], ["i", "key", "score"])

    found = keys.select("rep", "key").mapInArrow(run, "i int, key binary, score double")
    ranked = found.withColumn("at", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "key"))).where(F.col("at") <= k)
    return [(r.i, bytes(r.key)) for r in ranked.select("i", "key").collect()]  # k rows a sample vector


def whole(dims: int) -> Tables:
    """One bucket for all: every vector is compared."""
    return Tables(np.zeros((1, dims, 0)), np.zeros((1, 0)), 1.0)


def fit_tables(keys: DataFrame, asked: DataFrame, dims: int, n: int, k: int, tables: int, width: float, sample: int, recall: float, most_probes: int, seed: int) -> Tables:
    """Projections by the number ``n`` of distinct vectors, all of ``dims`` components, and as many probes as bring
    ``recall`` of the sample's neighbours. Where ``most_probes`` do not bring it, the last hash of every table goes, which
    makes its buckets larger, until they do; without hashes every vector is compared."""
    picked = [(r.rep, bytes(r.key)) for r in asked.orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()]
    hashes = int(np.clip(round(np.log2(max(n, 2)) / 3), 2, 24))
    rng = np.random.default_rng(seed)
    drawn = Tables(rng.normal(size=(tables, dims, hashes)), rng.uniform(0, width, (tables, hashes)), width)
    near = true_neighbours(keys, picked, k)
    if not near:
        return drawn
    found, own = matrix([key for _, key in near]), matrix([key for _, key in picked])
    for left in range(hashes, 0, -1):
        fewer = Tables(drawn.normals[:, :, :left], drawn.offsets[:, :left], width)
        there, places = np.floor(fewer.places(found)), fewer.places(own)
        orders = [[{tuple(s): t for t, s in reversed(list(enumerate(perturbations(places[t0, i], most_probes))))} for i in range(len(picked))] for t0 in range(tables)]
        needed = np.sort([min(orders[t][i].get(tuple(there[t, j]), np.inf) for t in range(tables)) for j, (i, _) in enumerate(near)])
        last = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]
        if last < np.inf:
            return Tables(fewer.normals, fewer.offsets, width, int(last) + 1)
    return whole(dims)


def approximate_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = 4, width: float = 2.0, recall: float = 0.96, sample: int = 64, most_probes: int = 256, seed: int = 5, few: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` nearest by cosine that were found, nearest first, ties to the smaller id.
    ``is_query`` is a condition on ``id``.

    Rows with null ids and vectors that are null, empty, zero or not finite take no part. Vectors are compared with those
    of their own length; a length with at most ``few`` distinct vectors is compared whole. Equal rows count once, equal vectors under other ids each; extra columns are not
    read; fewer candidates give fewer rows, an empty table none. Only the choice of the number of probes rests on a
    sample (of ``sample`` queries against all vectors); every vector is indexed and every query answered.
    """
    rows = staged(usable(vectors, id_col, vector_col), "vectors")
    keys = staged(distinct_keys(rows, k + 1), "distinct-vectors")
    asking = staged(rows.where(is_query).distinct().join(keys.select("key", "rep"), "key").select(F.col("id").alias("query_id"), F.col("rep").alias("query")), "queries")
    asked = asking.select(F.col("query").alias("rep")).distinct().join(keys.select("rep", "key"), "rep")
    size = F.octet_length("key")
    counts = keys.groupBy(size.alias("size")).count().where(F.col("count") > few)
    large = counts.join(asked.select(size.alias("size")).distinct(), "size").orderBy("size").collect()  # few: each has many vectors
    models = {r["size"]: fit_tables(keys.where(size == r["size"]), asked.where(size == r["size"]), r["size"] // 8, r["count"], k, tables, width, sample, recall, most_probes, seed) for r in large}

    def buckets(probing: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    some = batch.slice(a, 512)
                    sizes = np.array([len(key) for key in some.column("key").to_pylist()])
                    for own in np.unique(sizes).tolist():
                        part = some.take(pa.array(np.flatnonzero(sizes == own)))
                        model = models.get(own) or whole(own // 8)
                        places = model.places(matrix(part.column("key").to_pylist()))
                        for t in range(len(places)):
                            if probing:
                                slots = [perturbations(place, model.probes) for place in places[t]]
                                at = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
                                names = bucket_keys(np.array([s for each in slots for s in each]))
                            else:
                                at, names = np.arange(part.num_rows), bucket_keys(np.floor(places[t]))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), own), pa.int32()), pa.array(np.full(len(at), t), pa.int32()), pa.array(names), part.column("rep").take(pa.array(at)), part.column("key").take(pa.array(at))], ["size", "tab", "bucket", "rep", "key"])

        return run

    def compare(found: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("rep")
        reps, own = found["rep"].to_numpy(), queries["rep"].to_numpy()
        scores, best = top_cosines(matrix(list(found["key"])), matrix(list(queries["key"])), k + 1)
        return pd.DataFrame({"query": np.repeat(own, best.shape[1]), "rep": reps[best].ravel(), "score": scores.ravel()})

    schema = "size int, tab int, bucket long, rep long, key binary"
    index = keys.select("rep", "key").mapInArrow(buckets(False), schema)
    probes = asked.select("rep", "key").mapInArrow(buckets(True), schema)
    pairs = in_blocks(index, probes, ["size", "tab", "bucket"], compare, "query long, rep long, score double", 4096, 2048)
    return nearest_ids(pairs, keys, asking, k, F.desc("score"), "score")
