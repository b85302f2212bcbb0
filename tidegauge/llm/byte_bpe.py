"""Byte-level BPE, encoding and decoding, from a file of ranks.

Two tiers: a minimal perfect hash over the vocabulary resolves a pre-token that is a token as a whole; any other is
merged with a heap of (rank, place) over its bytes as a linked list. A worker remembers the ids of the chunks between
spaces that it has met (bounded, and only to save time), so each is resolved once in a while and not at every place.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import Recent, keyed_texts, int_lists, slices, without_gc

CACHED_CHUNKS, CACHED_PIECES = 300_000, 150_000
NONE = None
UNSAFE = b""
NUMBERS = list(range(-1, 70))
ODD_A, ODD_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank; ranks must be 0, 1, 2, ... and hold every single byte."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    tokens = [ranks[i] for i in range(len(ranks))]
    if len({t for t in tokens if len(t) == 1}) != 256:
        raise ValueError("the ranks lack single bytes")
    return tokens


class PerfectHash:
    """Minimal perfect hash by displacement: keys fall into buckets by one hash; the displacement kept for a bucket
    sends all its keys to free places of a table with exactly one place a key."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 2)
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        self.shift = [0] * self.buckets
        self.at: list[int] = [-1] * self.n
        for bucket, own in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(own) == 1:
                break
            d = 1
            while True:
                places = [self.moved(hashes[i], d) for i in own]
                if len({*places}) == len(own) and all(self.at[p] < 0 for p in places):
                    break
                d += 1
            self.shift[bucket] = d
            for i, p in zip(own, places, strict=True):
                self.at[p] = i
        free = iter([p for p in range(self.n) if self.at[p] < 0])
        for bucket, own in groups.items():
            if len(own) == 1:  # a lone key takes any place left, which is noted as such
                p = next(free)
                self.shift[bucket], self.at[p] = -p - 1, own[0]

    def moved(self, h: int, d: int) -> int:
        return (((h ^ (d * ODD_A)) * ODD_B & 0xFFFFFFFFFFFFFFFF) >> 24) % self.n

    def place(self, key: bytes) -> int:
        """Number of the one key that ``key`` may equal."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.at[-d - 1 if d < 0 else self.moved(h, d)]


class ByteEncoder:
    def __init__(self, path: str, pattern: str):
        import regex

        self.tokens = read_ranks(path)
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.raw = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = {(t[0], t[1]): i for t, i in self.ranks.items() if len(t) == 2}
        self.whole = PerfectHash(self.tokens)
        self.split = regex.compile(pattern).findall
        self.met_chunks = Recent(self.chunks, CACHED_CHUNKS)
        self.met_pieces = Recent(lambda new: list(map(self.pre_token, new)), CACHED_PIECES)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: always the pair of least rank, the leftmost of equals, until no pair is a token. ``best`` has the
        rank of each part with its right neighbour, NONE if that is no token or the part is gone."""
        n, rank = len(piece), self.ranks.get
        after, before = (NUMBERS[2 : n + 3], NUMBERS[:n]) if n < 64 else (list(range(1, n + 2)), list(range(-1, n)))
        ids = list(map(self.single.__getitem__, piece))
        best = list(map(self.pairs.get, zip(piece, piece[1:], strict=False)))
        best.append(NONE)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        heap = [r << shift | i for i, r in enumerate(best) if r is not NONE]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & mask, top >> shift
            if best[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], best[i], best[j] = r, -1, NONE, NONE
            if k < n:
                before[k] = i
                if (r := rank(piece[i : after[k]])) is not None:
                    best[i] = r
                    heappush(heap, r << shift | i)
            if i:
                h = before[i]
                if (r := rank(piece[h:k])) is not None:
                    heappush(heap, r << shift | h)
                best[h] = r
        return [i for i in ids if i >= 0]

    def pre_token(self, piece: str) -> bytes:
        spelled = piece.encode("utf-8", "surrogatepass")
        at = self.whole.place(spelled)
        return self.raw[at] if self.tokens[at] == spelled else b"".join([self.raw[i] for i in self.merge(spelled)])

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that the pattern splits as wholes."""
        return [b"".join(x) for x in self.met_pieces.grouped(list(map(self.split, texts)))]

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks with the space before them; UNSAFE if white space beside that space could join it."""
        safe = [bool(c) and not c[0].isspace() and not c[-1].isspace() for c in chunks]
        ids = iter(self.texts([f" {c}" for c, ok in zip(chunks, safe, strict=True) if ok]))
        return [next(ids) if ok else UNSAFE for ok in safe]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. A match of the pattern holds a space only as its first character or in a
        run of white space. So a text whose spaces all stand alone can be cut before each; any other text is split by the
        pattern as a whole."""
        parts = [text.split(" ") for text in texts]
        rest = self.met_chunks.grouped([p[1:] for p in parts])
        cut = [UNSAFE not in r and bool(p[0]) and not p[0][-1].isspace() for p, r in zip(parts, rest, strict=True)]
        heads = self.texts([p[0] if ok else text for p, ok, text in zip(parts, cut, texts, strict=True)])
        return [b"".join([h, *r]) if ok else h for h, r, ok in zip(heads, rest, cut, strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_encoder(path: str, pattern: str) -> ByteEncoder:
    """One per worker."""
    return ByteEncoder(path, pattern)


def vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode_bytes(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row. Null and empty texts have no ids; null ids and repeated rows stay; extra columns are
    not read. A pre-token of any length takes n log n steps."""
    path, pattern = vocabulary(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path, pattern)
        for batch in without_gc(batches):
            content = batch.column("text").to_pylist()
            for a, b in slices(content):
                rows = encoder.encode(content[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), int_lists(rows)], ["doc_id", "ids"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_bytes(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) to (doc_id, ids, decoded): the bytes that the ids stand for. Null ids decode to null; an id that
    is no token fails."""
    path, pattern = vocabulary(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = byte_encoder(path, pattern).decode
        for batch in batches:
            ids = batch.column("ids")
            for a in range(0, len(ids), 256):
                part = ids.slice(a, 256)
                flat = part.flatten().to_numpy().tolist()
                ends = np.cumsum(part.value_lengths().fill_null(0).to_numpy()).tolist()
                decoded = [decode(flat[x:y]) for x, y in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, 256), part, pa.array(decoded, pa.binary(), mask=part.is_null().to_numpy(zero_copy_only=False))], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
