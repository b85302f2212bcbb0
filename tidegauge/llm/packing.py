"""Best-fit packing under several capacities (vector best fit).

A sequence has a residual of tokens, of documents and of attention cost (sum of squared piece lengths). Pieces go
longest first, each to the open sequence that holds it under every capacity and whose weighted residual norm after
placement is least (rule "norm"), or whose weighted dot product of demand and residual is least (rule "dot"); if
none holds it, a new one opens. Pieces are dealt at random over shards of a fixed size, each packed by one task,
so work and memory per task stay the same at any input size; a shard wastes at most one sequence's rest or so.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, staged
from .word_bpe import default_path, encode_words


@dataclass(frozen=True)
class Capacity:
    """Of one sequence. By default only tokens bind: as many documents as tokens fit, and full attention is paid for."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"

    def __post_init__(self):
        if self.tokens < 1 or self.documents < 1 or self.attention < self.tokens**2:
            raise ValueError("a full piece must fit an empty sequence")
        if self.rule not in ("norm", "dot"):
            raise ValueError(f"no such rule: {self.rule}")


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; lengths of 0 take a place of their own length."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    limit = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weight = np.array(capacity.weights) / limit**2
    rest = np.zeros((3, 1024))
    names = np.zeros(1024, np.int64)
    used = made = 0
    for k, i in enumerate(order):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        live = rest[:, :used]
        after = live - need[:, None]
        fits = (after >= 0).all(axis=0)
        score = weight @ (after * after) if capacity.rule == "norm" else (weight * need) @ live
        score[~fits] = np.inf
        best = int(score.argmin()) if used else -1
        if best < 0 or score[best] == np.inf:
            if used == rest.shape[1]:
                rest, names = np.hstack([rest, np.zeros_like(rest)]), np.concatenate([names, np.zeros_like(names)])
            best, used = used, used + 1
            rest[:, best], names[best] = limit, made
            made += 1
        sequence[i], offset[i] = names[best], capacity.tokens - int(rest[0, best])
        rest[:, best] -= need
        if k % 256 == 255:  # sequences that not even the shortest piece left fits are closed
            least = lengths[order[-1]]
            keep = (rest[0, :used] >= least) & (rest[1, :used] >= 1) & (rest[2, :used] >= float(least) ** 2)
            n = int(keep.sum())
            rest[:, :n], names[:n], used = rest[:, :used][:, keep], names[:used][keep], n
    return sequence, offset


def cut_pieces(encoded: DataFrame, most: int) -> DataFrame:
    """(doc_id, ids) to pieces (doc_id, piece, start, length, piece_ids) of ``most`` tokens; only the last may be shorter."""
    pieces = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("ids") - 1) / (4 * most)).cast("int"))).alias("piece")
    own = F.expr(f"substring(ids, piece * {4 * most} + 1, {4 * most})").alias("piece_ids")
    cut = encoded.select("doc_id", "ids", pieces).select("doc_id", "piece", own)
    return cut.select("doc_id", "piece", (F.col("piece").cast("long") * most).alias("start"), F.floor(F.octet_length("piece_ids") / 4).alias("length"), "piece_ids")


def place(pieces: DataFrame, capacity: Capacity = Capacity(), shard_pieces: int = 16_384) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length``. ``pieces`` must be a stored table: it is read twice,
    and each row's place in it says its shard. Repeated rows are dealt like any others. An empty table stays empty."""
    rows = pieces.withColumn("at", F.monotonically_increasing_id())
    shards = max(1, -(-pieces.count() // shard_pieces))
    kept = pieces.columns

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at", kind="stable")
        sequence, offset = best_fit(group["length"].to_numpy(np.int64), capacity)
        return group[kept].assign(sequence_id=(int(group["shard"].iloc[0]) << 32) + sequence, offset=offset)

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return rows.withColumn("shard", F.pmod(F.xxhash64("at"), F.lit(shards))).groupBy("shard").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their sequence and the offset in it: doc_id, piece, start, length, piece_crc32,
    sequence_id, offset, and ``piece_ids`` (little-endian unsigned 32-bit) if ``with_ids``.

    Null and empty texts are one piece of ``end_id``; null ids and repeated rows are kept as they are; extra columns
    are not read; an empty table gives no rows. Only texts longer than ``capacity.tokens`` are cut. Which of equally
    long pieces shares a sequence with which others is left open.
    """
    pieces = cut_pieces(encode_words(keyed_texts(docs, id_col, text_col), path or default_path(), end_id), capacity.tokens)
    columns = ["doc_id", "piece", "start", "length", F.crc32("piece_ids").alias("piece_crc32")] + ["piece_ids"] * with_ids
    return place(staged(pieces.select(*columns), "pieces"), capacity)
