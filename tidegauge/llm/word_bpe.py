"""Ids of the public word tokenizer, by the tokenizers library, for whole texts.

White space always ends a token there, so a text is split into chunks at spaces and line feeds, and chunks of plain
characters into the tokenizer's own pieces. Arrow splits the texts of a slice and numbers the distinct chunks, then the distinct
pieces; only these are looked up in Python, and Arrow lays their ids in place again. A worker keeps the ids of the pieces it
has met, as bytes (a bounded memory that only saves time). New pieces go to the library's merge model, any
other chunk whole to the library's encoder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Recent, slices_of, without_gc

WORD_FILE = "word_bpe_49k.json"
CACHED_PIECES = 250_000
SLICE_BYTES = 1 << 23
"""Bytes of text that a task encodes at a time; a longer text is a slice of its own."""

# The tokenizer's own split pattern, applied to lower-cased chunks of the characters in PLAIN.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
PLAIN = r"[\x21-\x3B\x3D-\x7E\xC0-\xFF]+"  # "<" is not plain: it may begin one of the added tokens


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if visible in Latin-1, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(other)) for b in range(256)]


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merges = self.library.model
        self.letters = byte_letters()
        self.raw = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.plain = re.compile(PLAIN)
        self.met = Recent(lambda new: list(map(self.ids, new)), CACHED_PIECES)

    def ids(self, part: str) -> bytes:
        """Ids of one plain piece, or of a chunk that is not plain."""
        if not self.plain.fullmatch(part):
            return b"".join([self.raw[i] for i in self.library.encode(part, add_special_tokens=False).ids])
        spelled = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        return b"".join([self.raw[token.id] for token in self.merges.tokenize(spelled)])

    def parts(self, chunks: pa.StringArray) -> pa.ListArray:
        """Pieces of every chunk, and an empty one; a chunk that is not plain stays whole."""
        chunks = chunks.cast(pa.large_string())  # with a space after each piece, a chunk may double
        pieces = pc.replace_substring_regex(pc.utf8_lower(chunks), PIECES, r"\0 ")
        return pc.split_pattern(pc.if_else(pc.match_substring_regex(chunks, f"^{PLAIN}$"), pieces, chunks), " ")

    def encode_array(self, texts: pa.StringArray) -> pa.LargeBinaryArray:
        """Little-endian unsigned 32-bit ids of each text; no text may be null."""
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        numbered = chunks.flatten().dictionary_encode()
        parts = self.parts(numbered.dictionary)
        distinct = parts.flatten().dictionary_encode()
        known = pa.array(self.met.many(distinct.dictionary.to_pylist()), pa.large_binary())
        return joined(chunks, joined(parts, known.take(distinct.indices)).take(numbered.indices))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The same of a list."""
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()

    def ended(self, batch: pa.RecordBatch, end_id: int) -> Iterator[tuple[pa.Array, pa.LargeBinaryArray]]:
        """Ids of documents and of their texts, ``end_id`` last, by slices of a batch of (doc_id, text)."""
        end = pa.scalar(end_id.to_bytes(4, "little"), pa.large_binary())
        content, none = batch.column("text"), pa.scalar(b"", pa.large_binary())
        for a, b in slices_of(pc.binary_length(content).to_pylist(), SLICE_BYTES):
            yield batch.column("doc_id").slice(a, b - a), pc.binary_join_element_wise(self.encode_array(content.slice(a, b - a)), end, none)


def joined(groups: pa.ListArray, values: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
    """The values of each group, one after the other; ``values`` stand for the elements of all groups."""
    _, starts, data = values.buffers()
    starts = np.frombuffer(starts, np.int64)[groups.offsets.to_numpy()]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(groups), [None, pa.py_buffer(starts), data])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One per worker."""
    return WordEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_FILE)


def encode_words(texts: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, text) to (doc_id, ids): little-endian unsigned 32-bit ids, ``end_id`` last; an empty text gives ``end_id`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in without_gc(batches):
            for docs, ids in encoder.ended(batch, end_id):
                yield pa.RecordBatch.from_arrays([docs, ids.cast(pa.binary())], ["doc_id", "ids"])

    return texts.mapInArrow(run, "doc_id long, ids binary")
