"""SimHash near-duplicates by bit-sliced comparison.

Documents with one fingerprint are one class from the start. Two fingerprints within ``radius`` bits agree on one of
``radius + 1`` parts, so on its first bits; equal prefixes share a bucket, and a large bucket is split again over the
bits left, where the same holds. In a bucket fingerprints stand as bit planes, 64 to a word: each is compared with all
by carry-save counters over the planes, and a block is given up once all in it exceed the radius. Links inside a bucket are
reduced to a forest before they leave it; classes are the connected components of all forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, slices, staged, words_of

BITS = 64
HOT_SHARE = 1000
"""Fingerprints of more than one row in so many are joined apart from the others."""


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of all shingles; one for fewer words than ``size``, none without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingles], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes have."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        raw = hashes[a : a + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):  # a histogram of each byte gives its eight bit counts
            counts[8 * byte : 8 * byte + 8] += np.bincount(raw[:, byte], minlength=256) @ BYTE_BITS
    return int(((counts * 2 > len(hashes)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bits) of every row; ``bits`` as signed 64-bit. Texts without words have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = batch.column("text").to_pylist()
            for a, b in slices(content):
                bits = np.array([majority(shingle_hashes(text, shingle)) for text in content[a:b]], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(bits)], ["doc_id", "bits"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, bits long")


def bit_planes(codes: np.ndarray) -> np.ndarray:
    """(64, words): word w of plane b holds bit b of codes 64 w to 64 w + 63; the last word is filled with zeros."""
    padded = np.zeros(-(-len(codes) // 64) * 64, "<u8")
    padded[: len(codes)] = codes
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def close_pairs(planes: np.ndarray, n: int, codes: np.ndarray, radius: int, block: int = 8, after: np.ndarray | None = None, at_once: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``codes``, numbers of planes' codes) at ``radius`` bits or fewer, in pieces. Counters stand vertically:
    ``count[k]`` holds bit k of each lane's distance, ``over`` the lanes past the radius. A code and a block of ``block``
    words are a unit, abandoned once all its lanes are over. ``after`` gives each code a number whose lane, like all
    before it, counts as over from the start, as do the lanes that fill the last word."""
    width = (radius + 1).bit_length()
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    first = np.zeros(len(codes), np.int64) if after is None else after + 1
    for a in range(0, planes.shape[1], block):
        part = planes[:, a : a + block]
        lane = 64 * np.arange(a, a + part.shape[1])
        spare = ~low_mask(n - lane)
        todo = (first < min(n, int(lane[-1]) + 64)).nonzero()[0]
        for c in range(0, len(todo), at_once):
            own = todo[c : c + at_once]
            over = low_mask(first[own][:, None] - lane) | spare
            count = np.zeros((width, *over.shape), np.uint64)
            for b in range(0, BITS, 2):
                flip = [np.where(codes[own] >> np.uint64(b + i) & np.uint64(1), full, np.uint64(0))[:, None] for i in (0, 1)]
                x, y = part[b] ^ flip[0], part[b + 1] ^ flip[1]
                u = count[0] ^ x  # full adder of the lowest counter bit and two planes
                carry = (count[0] & x) | (u & y)
                count[0] = u ^ y
                for k in range(1, width):
                    count[k], carry = count[k] ^ carry, count[k] & carry
                over |= carry | greater(count, radius)
                if b % 8 == 6:
                    alive = (over != full).any(axis=1)
                    if not alive.all():
                        own, over, count = own[alive], over[alive], count[:, alive]
                        if not len(own):
                            break
            else:
                row, near = np.unpackbits((~over).astype("<u8").view(np.uint8), axis=1, bitorder="little").nonzero()
                if len(row):
                    yield own[row], near + 64 * a


def low_mask(bits: np.ndarray) -> np.ndarray:
    """Words with as many low bits set; none below 0, all from 64 on."""
    some = np.clip(bits, 0, 63).astype(np.uint64)
    return np.where(bits >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << some) - np.uint64(1))


def within(planes: np.ndarray, n: int, code: int, radius: int, block: int = 8) -> np.ndarray:
    """Numbers of codes at ``radius`` bits or fewer from ``code``."""
    hits = [near for _, near in close_pairs(planes, n, np.array([code], np.uint64), radius, block)]
    return np.concatenate(hits) if hits else np.zeros(0, np.int64)


def greater(count: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose vertical counter is above ``radius``."""
    above, equal = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & count[k]
        else:
            above = above | (equal & count[k])
            equal = equal & ~count[k]
    return above


def forest(codes: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of numbers that connect all codes linked within ``radius``, no more than needed."""
    root = list(range(len(codes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    pairs = []
    for left, right in close_pairs(bit_planes(codes), len(codes), codes, radius, after=np.arange(len(codes))):
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                pairs.append((i, j))
    return np.array(pairs, np.int64).reshape(-1, 2)


def bucket_masks(radius: int, prefix: int, levels: int) -> list[list[int]]:
    """Per level the bits that a bucket's codes share: level 0 has the first ``prefix`` bits of one of ``radius + 1`` parts
    of all bits, each further level one of as many parts of the bits then left. Child j of bucket kind p is kind
    ``p * (radius + 1) + j``."""
    kinds: list[list[int]] = [[0]]
    for level in range(levels):
        below = []
        for mask in kinds[-1]:
            left = [b for b in range(BITS) if not mask >> b & 1]
            parts = [part[:prefix] if level == 0 else part for part in np.array_split(np.array(left), radius + 1)]
            below += [mask | sum(1 << int(b) for b in part) for part in parts]
        kinds.append(below)
    return kinds[1:]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, salts: int = 16) -> DataFrame:
    """Inner join where ``left`` may hold one key very often and ``right`` has one row a key: each row of ``right`` stands
    once for every salt, rows of ``left`` take one by the hash of ``by``."""
    salted = right.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(salted.hint("merge"), [*keys, "salt"]).drop("salt")


def links(codes: DataFrame, radius: int, most: int = 2048, levels: int = 5, usual: int = 512) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints in column ``bits`` within ``radius`` that connect all that are
    linked. The first key is a prefix as long as leaves about ``usual`` evenly spread fingerprints a bucket. A bucket of
    over ``most`` fingerprints is dealt out again by further bits, up to ``levels`` times; the last (51 of 64 bits shared
    at radius 2, or more) can hold 8,192 distinct fingerprints, which bounds every task."""
    parts = radius + 1
    prefix = min(BITS // parts, max(1, (codes.count() // usual).bit_length()))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = np.sort(group["bits"].to_numpy(np.int64))
        pairs = found[forest(found.view(np.uint64), radius)]
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    rows, out = codes.select("bits", F.lit(0).alias("kind")), []
    for level, masks in enumerate(bucket_masks(radius, prefix, levels)):
        own = F.array(*[F.lit(m - (1 << BITS) if m >> (BITS - 1) else m) for m in masks])
        child = F.explode(F.array(*[F.col("kind") * parts + j for j in range(parts)])).alias("kind")
        dealt = rows.select("bits", child).select("bits", "kind", F.col("bits").bitwiseAND(own[F.col("kind")]).alias("key"))
        sizes = staged(dealt.groupBy("kind", "key").count().where("count > 1"), "bucket-sizes")
        last = level == levels - 1
        fit = sizes if last else sizes.where(F.col("count") <= most)
        mine = spread_join(dealt, fit.select("kind", "key"), ["kind", "key"], "bits")
        spread = mine.repartition(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "key")  # few bytes, much work: not to be coalesced
        out.append(spread.groupBy("kind", "key").applyInPandas(run, "a long, b long"))
        if last or sizes.where(F.col("count") > most).isEmpty():
            break
        crowded = sizes.where(F.col("count") > most).select("kind", "key")
        rows = staged(spread_join(dealt, crowded, ["kind", "key"], "bits").select("bits", "kind").distinct(), "crowded")
    return reduce(DataFrame.union, out).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root): least node reachable over edges (a, b), for all nodes but the roots. Large-star and small-star rounds by turns; each round is
    written to the shared folder, and a node's neighbours are never gathered: stars are joins with a minimum."""
    current, seen = edges, None
    for _ in range(rounds):
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select("b", "a")).where("u != v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = spread_join(both.where("v > u"), least, ["u"], "v").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b")
        high = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = high.groupBy("u").agg(F.min("v").alias("m"))
        small = high.join(low.hint("merge"), "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a != b")
        current = staged(small.distinct(), "stars")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node")
        seen = state
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bits, component_id) of every row: its fingerprint and the smallest doc_id reachable over links of
    ``radius`` differing bits or fewer, itself included.

    Null and empty texts share the fingerprint zero and link like any other. Null ids keep their row and never name a
    component unless all its ids are null, when it is null. Repeated rows stay and share a component; extra columns are
    not read; an empty table gives no rows. A very long text is read whole by the one task that holds it.
    """
    marks = staged(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    codes = staged(marks.groupBy("bits").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows")), "codes")
    roots = components(staged(links(codes, radius), "links"))
    named = codes.join(roots.hint("merge"), codes.bits == roots.node, "left").select("bits", "least_id", "rows", F.coalesce("root", "bits").alias("root"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = staged(spread_join(named, ids, ["root"], "bits").select("bits", "rows", "component_id"), "classes")
    common = F.col("rows") * HOT_SHARE > marks.count()  # fewer than HOT_SHARE fingerprints, however many rows there are
    hot = F.broadcast(classes.where(common).drop("rows"))
    rare = marks.join(hot, "bits", "left_anti").join(classes.where(~common).drop("rows").hint("merge"), "bits")
    return marks.join(hot, "bits").union(rare.select("bits", "doc_id", "component_id")).select("doc_id", "bits", "component_id")
