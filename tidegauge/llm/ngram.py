"""Language-model scores by deleted interpolation.

p(w | h) = l2 c(h, w) / c(h) + l1 c(w) / N + l0 / (V + 1): maximum-likelihood estimates of bigram and unigram and a
uniform part, mixed with weights that depend on how often the context h was seen (a bucket per power of two). The
weights come from expectation-maximisation on held-out counts: events of one training part in 16, against counts from
which that part is deleted. Then all training counts are used.

Texts are dealt over blocks of some megabytes. A block asks for the counts of its distinct words and word pairs, each
once, as sorted 64-bit hashes in arrays, one array for each range of hashes; the range's task adds up what all blocks
bring, and answers each in its order. So a frequent word or a copied passage costs one entry a block, nothing is
broadcast but the weights, and a task holds one block or one range. Hashes of pairs keep 24 bits more than the
logarithm of the number of bytes, so one pair in 16 million may share its count with another, at any input size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, staged, words_of

END, START = b"\n", b"\n\n"
"""No word holds a line feed. The start is a context only, seen as often as the end."""
HELD_PARTS = 16
FIRST_WEIGHTS = np.array([0.5, 0.4, 0.1])
LEVELS = 64
WORDS, PAIRS = 0, 1


@dataclass
class Block:
    """Tokens of a block of texts: word numbers, the document of each, distinct keys and where each token's stand."""

    n_docs: int
    tokens: np.ndarray
    doc: np.ndarray
    word_keys: np.ndarray
    word_at: np.ndarray
    context_at: np.ndarray
    pair_keys: np.ndarray
    pair_at: np.ndarray


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of ordered pairs of hashes."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def read_block(texts: list[str], pair_bits: int) -> Block:
    numbers: dict[bytes, int] = {END: 0}
    tokens, lengths = [], []
    for text in texts:
        words = words_of(text)
        for w in set(words).difference(numbers):
            numbers[w] = len(numbers)
        tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        tokens.append(np.zeros(1, np.int64))
        lengths.append(len(words) + 1)
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ends = np.cumsum(lengths)
    context = np.concatenate([[0], flat[:-1]]) if len(flat) else flat  # after an end stands a start, which has its count
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64) if lengths else np.zeros(0, np.int64)
    context_hash = hashes[context]
    context_hash[first] = np.uint64(xxhash.xxh64_intdigest(START))
    pairs = mixed(context_hash, hashes[flat]) & np.uint64((0xFFFFFFFFFFFFFFFF << (64 - pair_bits)) & 0xFFFFFFFFFFFFFFFF)
    pair_keys, pair_at = np.unique(pairs, return_inverse=True)
    return Block(len(texts), flat, np.repeat(np.arange(len(texts)), lengths), hashes[order], place[flat], place[context], pair_keys, pair_at)


def to_planes(keys: np.ndarray) -> bytes:
    """Bytes of equal weight side by side; those of sorted keys then compress."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def in_ranges(keys: np.ndarray, range_bits: int) -> np.ndarray:
    """Where each range of the highest bits begins in sorted keys, and the end."""
    starts = np.arange(1 << range_bits, dtype=np.uint64) << np.uint64(64 - range_bits) if range_bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


REQUEST = "kind int, part int, block long, held boolean, keys binary, counts binary"
REPLY = "block long, kind int, part int, totals binary, deleted binary, distinct long, tokens long, deleted_tokens long"


def arrow_rows(ddl: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(ddl)})


REQUEST_ARROW = [("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("held", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())]
REPLY_ARROW = [("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("totals", pa.binary()), ("deleted", pa.binary()), ("distinct", pa.int64()), ("tokens", pa.int64()), ("deleted_tokens", pa.int64())]


def request_rows(table: pa.Table, pair_bits: int, range_bits: int) -> pa.Table:
    """One block's distinct keys with their counts in its training texts, a row for each range."""
    number = table.column("block")[0].as_py()
    block = read_block(table.column("text").to_pylist(), pair_bits)
    train = np.array(table.column("train").to_pylist(), bool)[block.doc]
    rows = []
    for kind, keys, at in ((WORDS, block.word_keys, block.word_at), (PAIRS, block.pair_keys, block.pair_at)):
        counts = np.bincount(at[train], minlength=len(keys)).astype("<u4")
        cuts = in_ranges(keys, range_bits)
        rows += [(kind, p, number, number % HELD_PARTS == 0, to_planes(keys[a:b]), counts[a:b].tobytes()) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    return arrow_rows(REQUEST_ARROW, rows)


def reply_rows(table: pa.Table) -> pa.Table:
    """Totals of one range for every block that asked, in its order; a last row without block has the range's sums.
    Counts of the held-out part go to its own blocks only."""
    columns = [table.column(c).to_pylist() for c in ("kind", "part", "block", "held", "keys", "counts")]
    keys = [from_planes(k) for k in columns[4]]
    ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    counts = np.concatenate([np.frombuffer(c, "<u4") for c in columns[5]]).astype(np.int64)
    held = np.repeat(columns[3], np.diff(ends))
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(at, counts, len(distinct)).astype(np.int64)
    deleted = np.bincount(at[held], counts[held], len(distinct)).astype(np.int64)
    rows = []
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        own = at[a:b]
        rows.append((columns[2][i], columns[0][i], columns[1][i], totals[own].tobytes(), deleted[own].tobytes() if columns[3][i] else None, None, None, None))
    rows.append((-1, columns[0][0], columns[1][0], None, None, int((totals > 0).sum()), int(totals.sum()), int(deleted.sum())))
    return arrow_rows(REPLY_ARROW, rows)


def answered(replies: pa.Table, kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals and deleted counts of a block's ``n`` keys."""
    rows = sorted((r for r in replies.select(["kind", "part", "totals", "deleted"]).to_pylist() if r["kind"] == kind), key=lambda r: r["part"])
    gather = lambda name: np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r[name], "<i8") for r in rows if r[name] is not None]])
    deleted = gather("deleted")
    return gather("totals"), deleted if len(deleted) else np.zeros(n, np.int64)


def level(counts: np.ndarray) -> np.ndarray:
    """Bucket of a context: 0 if never seen, else one more than the whole part of the binary logarithm."""
    return np.frexp(counts.astype(float))[1].clip(0, LEVELS - 1)


@dataclass(frozen=True)
class Model:
    tokens: int
    distinct: int
    deleted_tokens: int
    weights: np.ndarray
    """(bucket, 3): shares of bigram, unigram and uniform part."""


def estimates(pair: np.ndarray, context: np.ndarray, word: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    """(tokens, 3) maximum-likelihood estimates; a context never seen has none, and its share is the unigram's."""
    unigram = word / max(tokens, 1)
    bigram = np.where(context > 0, pair / np.maximum(context, 1), unigram)
    return np.stack([bigram, unigram, np.full(len(unigram), 1 / (distinct + 1))], axis=1)


def maximise(events: DataFrame, rounds: int = 15) -> np.ndarray:
    """Weights by expectation-maximisation over (level, e2, e1, e0) arrays; a round sums four numbers a bucket. Each
    bucket starts with one event's worth of the first weights, which stay where nothing is seen."""
    weights = np.tile(FIRST_WEIGHTS, (LEVELS, 1))
    for _ in range(rounds):
        now = weights

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((LEVELS, 3))
            for batch in batches:
                for raw_level, raw in zip(batch.column("levels").to_pylist(), batch.column("estimates").to_pylist(), strict=True):
                    at, e = np.frombuffer(raw_level, np.uint8), np.frombuffer(raw, "<f8").reshape(-1, 3)
                    share = now[at] * e
                    share /= share.sum(axis=1, keepdims=True)
                    for j in range(3):
                        sums[:, j] += np.bincount(at, share[:, j], LEVELS)
            k, j = sums.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[k, j])], ["level", "part", "value"])

        found = events.mapInArrow(run, "level int, part int, value double").groupBy("level", "part").agg(F.sum("value").alias("value")).collect()  # three a bucket
        sums = np.tile(FIRST_WEIGHTS, (LEVELS, 1))
        for row in found:
            sums[row["level"], row.part] += row.value
        weights = sums / sums.sum(axis=1, keepdims=True)
        if np.abs(weights - now).max() < 1e-4:
            break
    return weights


def deleted_interpolation(docs: DataFrame, train: Column, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of every row. ``train``: a condition on
    ``doc_id`` that says which rows are learned from. ``score`` is the log10 probability of the text and its end.

    Null and empty texts are the end alone; null ids are held out unless ``train`` says otherwise; repeated rows count
    and are scored each; extra columns are not read; an empty table gives no rows. Without training texts all weight
    rests on the uniform part. At a much larger input ``block_bytes`` should grow with it, so that arrays stay long.
    """
    texts = keyed_texts(docs, id_col, text_col).withColumn("train", F.coalesce(train, F.lit(False)))
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = max(2 * HELD_PARTS, -(-size // block_bytes))
    range_bits = max(2, int(np.ceil(np.log2(max(size, 1) / (2 * block_bytes) + 1))))
    pair_bits = min(64, 8 * -(-(int(size).bit_length() + 24) // 8))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    requests = dealt.groupBy("block").applyInArrow(lambda t: request_rows(t, pair_bits, range_bits), REQUEST)
    replies = staged(requests.groupBy("kind", "part").applyInArrow(reply_rows, REPLY), "ngram-replies")
    sums = replies.where((F.col("block") == -1) & (F.col("kind") == WORDS)).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct", "deleted_tokens")]).first()
    to_blocks = replies.where("block >= 0").select("block", "kind", "part", "totals", "deleted")
    tokens, distinct, deleted_tokens = map(int, sums)

    def held_events(left: pa.Table, right: pa.Table) -> pa.Table:
        keep = np.array(left.column("train").to_pylist(), bool)
        block = read_block(left.column("text").to_pylist(), pair_bits)
        words, w = answered(right, WORDS, len(block.word_keys))
        pairs, p = answered(right, PAIRS, len(block.pair_keys))
        words, pairs, mine = words - w, pairs - p, keep[block.doc]
        context = words[block.context_at[mine]]
        e = estimates(pairs[block.pair_at[mine]], context, words[block.word_at[mine]], tokens - deleted_tokens, distinct)
        return pa.table({"levels": pa.array([level(context).astype(np.uint8).tobytes()], pa.binary()), "estimates": pa.array([e.astype("<f8").tobytes()], pa.binary())})

    is_held = F.col("block") % HELD_PARTS == 0
    events = staged(dealt.where(is_held).groupBy("block").cogroup(to_blocks.where(is_held).groupBy("block")).applyInArrow(held_events, "levels binary, estimates binary"), "held-events")
    model = Model(tokens, distinct, deleted_tokens, maximise(events))

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        block = read_block(left.column("text").to_pylist(), pair_bits)
        words, _ = answered(right, WORDS, len(block.word_keys))
        pairs, _ = answered(right, PAIRS, len(block.pair_keys))
        word, context = words[block.word_at], words[block.context_at]
        e = estimates(pairs[block.pair_at], context, word, model.tokens, model.distinct)
        p = (model.weights[level(context)] * e).sum(axis=1)
        per_doc = lambda x: np.bincount(block.doc, x, block.n_docs)
        base = np.log10((word + 1) / (model.tokens + model.distinct + 1))
        n = np.bincount(block.doc, minlength=block.n_docs)
        return pa.table({"doc_id": left.column("doc_id"), "train": left.column("train"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(np.bincount(block.doc[word > 0], minlength=block.n_docs), pa.int64()), "train_tokens": pa.array(np.full(block.n_docs, model.tokens), pa.int64()), "base_score": pa.array(per_doc(base)), "score": pa.array(per_doc(np.log10(p)))})

    return dealt.groupBy("block").cogroup(to_blocks.groupBy("block")).applyInArrow(scores, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
