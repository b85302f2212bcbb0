"""Runs of repeated words by block convolution.

A run of period q repeats three times or more, so at the scale B = 2^k with B <= q < 2 B (8 for shorter periods) it holds a
whole block of B words that starts at a multiple of B, together with its copy q words on. At each scale all blocks are
laid against the words that follow: the sum of squared differences at every distance is the squares' sums less twice a
correlation, which a number-theoretic transform gives exactly. Where the sum is zero the block occurs again; that
distance seeds an extension to both sides over the words themselves. Words enter the transform as codes small enough
that no sum reaches the modulus; different words with one code only cost an extension.

Texts of a slice stand in one array, longest first, so that each scale transforms the blocks of all texts long enough
for it at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MODULUS, ROOT = 23068673, 3
"""11 * 2^21 + 1 and a generator of its multiplicative group. Sixteen products of residues stay under 2^53, exact in doubles."""
RADIX, BASE, WIDEST = 16, 8, 1 << 12
"""Points of one transform step; the least scale; the longest block. Longer periods are met with blocks of ``WIDEST``."""
ROWS_AT_ONCE = 1 << 18


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` less a multiple of the modulus: from 0 to the modulus, or one off at either end; exact for integers below 2^53."""
    return x - np.floor(x * (1.0 / MODULUS)) * MODULUS


@lru_cache(64)
def powers(size: int, inverse: bool) -> tuple[np.ndarray, int]:
    root = pow(ROOT, (MODULUS - 1) // size, MODULUS)
    root = pow(root, -1, MODULUS) if inverse else root
    out = np.ones(size, np.int64)
    for i in range(1, size):
        out[i] = out[i - 1] * root % MODULUS
    return out, root


@lru_cache(64)
def matrix(size: int, inverse: bool) -> np.ndarray:
    row, _ = powers(size, inverse)
    at = np.arange(size)
    return row[np.outer(at, at) % size].astype(np.float64)


@lru_cache(64)
def twiddles(first: int, rest: int, inverse: bool) -> np.ndarray:
    row, _ = powers(first * rest, inverse)
    return row[np.outer(np.arange(first), np.arange(rest))].astype(np.float64)


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two long); the inverse is not divided by the length. A long row is
    a table of ``RADIX`` rows: its columns are transformed, turned by powers of the root, then its rows."""
    rows, size = x.shape
    if size <= RADIX:
        return reduced(x @ matrix(size, inverse))
    rest = size // RADIX
    columns = reduced(np.matmul(matrix(RADIX, inverse), x.reshape(rows, RADIX, rest)))
    turned = reduced(columns * twiddles(RADIX, rest, inverse))
    done = transform(turned.reshape(rows * RADIX, rest), inverse)
    return np.ascontiguousarray(done.reshape(rows, RADIX, rest).transpose(0, 2, 1)).reshape(rows, size)


def repeats(codes: np.ndarray, scale: int, block: int, chunks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) where a block of ``block`` codes at a multiple of ``scale`` has no mismatch ``distance`` codes on. Chunk c
    covers distances c * block to (c + 1) * block - 1."""
    count = -(-len(codes) // block)
    padded = np.zeros((count + chunks[-1] + 2) * block, np.int64)
    padded[: len(codes)] = codes
    squares = np.concatenate([[0], np.cumsum(padded * padded)])
    size, half = 2 * block, block
    negative = -np.arange(size) % size
    sign = np.where(np.arange(size) % 2 == 0, 1.0, -1.0)
    scaled = pow(size, -1, MODULUS)
    step, reach = scale // block, chunks[-1] + 2
    at_once = max(1, ROWS_AT_ONCE // size)
    starts, distances = [], []
    whole = len(codes) // block  # only blocks that lie in the codes can recur
    for a in range(0, whole, at_once):
        own = np.arange(-(-a // step) * step, min(a + at_once, whole), step)
        if not len(own):
            continue
        low = int(own[0])
        near = np.zeros((min(int(own[-1]) + reach + 1, len(padded) // block) - low, size))
        near[:, :half] = padded[low * block : (low + len(near)) * block].reshape(-1, block)
        seen = transform(near)
        mine = seen[own - low][:, negative]
        for c in chunks:
            follow = seen[own - low + c] + sign * seen[np.minimum(own - low + c + 1, len(seen) - 1)]  # block c, then block c + 1 shifted by one block
            both = transform(reduced(mine * reduced(follow + MODULUS)), inverse=True)[:, :half]
            product = np.rint(both).astype(np.int64) % MODULUS * scaled % MODULUS
            first = own[:, None] * block
            copy = first + c * block + np.arange(half)
            mismatch = (squares[first + block] - squares[first]) + (squares[copy + block] - squares[copy]) - 2 * product
            row, d = np.nonzero(mismatch == 0)
            starts.append(own[row] * block)
            distances.append(c * block + d)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(distances)


def stretch(words: np.ndarray, low: int, high: int, start: int, distance: int) -> tuple[int, int]:
    """The longest range in low..high around ``start`` whose words equal those ``distance`` on, and those."""
    end, step = start, 64
    while end + distance < high:
        n = min(step, high - distance - end)
        differ = np.flatnonzero(words[end : end + n] != words[end + distance : end + distance + n])
        if len(differ):
            end += int(differ[0])
            break
        end, step = end + n, step * 2
    begin, step = start, 64
    while begin > low:
        n = min(step, begin - low)
        differ = np.flatnonzero(words[begin - n : begin] != words[begin - n + distance : begin + distance])
        if len(differ):
            begin += int(differ[-1]) + 1 - n
            break
        begin, step = begin - n, step * 2
    return begin, end + distance


def runs_of(words: np.ndarray, bounds: np.ndarray, least: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run in each text, by start, then period. Text t has the words (numbers under 2^62)
    bounds[t] to bounds[t + 1], longest text first. ``times`` is 3 or more and ``least`` 24 or more: blocks rely on it."""
    if times < 3 or least < 3 * BASE:
        raise ValueError("runs repeat three times or more and have 24 words or more")
    found: list[list[tuple[int, int, int]]] = [[] for _ in bounds[1:]]
    lengths = np.diff(bounds)
    scale = BASE
    while len(lengths) and lengths[0] >= max(least, times * (scale if scale > BASE else 1)):
        texts = int(np.searchsorted(-lengths, -max(least, times * (scale if scale > BASE else 1)), side="right"))
        end = int(bounds[texts])
        block = min(scale, WIDEST)
        spread = np.uint64(0x9E3779B97F4A7C15)
        codes = ((words[:end].astype(np.uint64) * spread) >> np.uint64(32)).astype(np.int64) % int(((MODULUS - 1) / block) ** 0.5)
        chunks = list(range(scale // block, 2 * scale // block)) if scale > BASE else [0, 1]
        start, distance = repeats(codes, scale, block, chunks)
        use = distance > 0
        start, distance = start[use], distance[use]
        text = np.searchsorted(bounds, start, side="right") - 1
        fits = start + distance + block <= bounds[text + 1]
        start, distance, text = start[fits], distance[fits], text[fits]
        order = np.lexsort((start, distance, text))
        start, distance, text = start[order], distance[order], text[order]
        edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1)) if len(text) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            t = int(text[a])
            extend(words, int(bounds[t]), int(bounds[t + 1]), start[a:b], distance[a:b], block, found[t], least, times)
        scale *= 2
    return [sorted((s - int(bounds[t]), n, q) for s, n, q in own) for t, own in enumerate(found)]


def extend(words: np.ndarray, low: int, high: int, start: np.ndarray, distance: np.ndarray, block: int, runs: list[tuple[int, int, int]], least: int, times: int) -> None:
    """Extends seeds of one text, by distance, and adds the runs. A seed in a run whose period divides its distance is that
    run's again: its stretch shares ``distance`` words with the run and so has the run's period throughout."""
    open_seeds = np.ones(len(start), bool)

    def settle(s: int, n: int, q: int) -> None:
        open_seeds[(start >= s) & (start + distance + block <= s + n) & (distance % q == 0)] = False

    for run in runs:
        settle(*run)
    at = 0
    while at < len(start):
        later = np.flatnonzero(open_seeds[at:])
        if not len(later):
            return
        at += int(later[0])
        d = int(distance[at])
        begin, end = stretch(words, low, high, int(start[at]), d)
        if end - begin >= max(least, times * d) and not any(d % q == 0 and s <= begin and end <= s + n for s, n, q in runs):
            runs.append((begin, end - begin, d))
        settle(begin, max(end - begin, int(start[at]) + d + block - begin), d)
        open_seeds[at] = False
        at += 1


def repeating(words: list[bytes], key: bytes) -> list[bytes]:
    """The words, for one key in ten with a stretch that repeats up to the end."""
    h, n = zlib.crc32(key), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> list:
    """The runs' number, the one of greatest length / period, and digests of all runs and of the words that no run repeats."""
    best = [None] * 4
    if runs:
        top = runs[0]
        for run in runs[1:]:
            if run[1] * top[2] > top[1] * run[2]:
                top = run
        best = [*top, 1000 * top[1] // top[2]]
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q : s + n] = False
    kept = [words[i] for i in np.flatnonzero(keep)] if runs else words
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return [len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode("utf-8", "surrogatepass"), runs]


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
WHOLE = ", collapsed string, runs array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame, plant: bool = False, whole: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's runs: stretches of words with smallest period q and a length of at least 24 and 3 q that no neighbour
    extends. Gives their number, the one of greatest exact length / period (ties: least start, then period; four nulls if
    there is none), digests, and with ``whole`` the runs and the words left when each keeps its first period.

    ``plant`` first makes one text in ten repeat, by its id. Null and empty texts have no words and no runs; a null id counts
    as an empty one; repeated rows stay; extra columns are not read; an empty table gives no rows. A very long text is a
    slice of its own and is held whole by one task, with its words as numbers and ``ROWS_AT_ONCE`` transformed values.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    fields = COLUMNS + (WHOLE if whole else "")
    types = [pa.int64()] * 6 + [pa.string()] * 2 + ([pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))] if whole else [])
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed", "runs"][: len(types)]

    def of_slice(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
        given = [text.encode("utf-8", "surrogatepass").split() for text in texts]
        if plant:
            given = [repeating(words, b"" if i is None else str(i).encode()) for i, words in zip(ids, given, strict=True)]
        order = sorted(range(len(given)), key=lambda i: -len(given[i]))
        number: dict[bytes, int] = {}
        numbered = [number.setdefault(w, len(number)) for i in order for w in given[i]]
        bounds = np.cumsum([0, *(len(given[i]) for i in order)])
        runs: list = [None] * len(given)
        for i, own in zip(order, runs_of(np.array(numbered, np.int64), bounds), strict=True):
            runs[i] = own
        rows = [[i, *summary(words, own)] for i, words, own in zip(ids, given, runs, strict=True)]
        columns = list(zip(*rows, strict=True))[: len(types)]
        if whole:
            columns[-1] = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in columns[-1]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts):
                yield of_slice(ids[a:b], texts[a:b])

    return rows.mapInArrow(run, fields)
