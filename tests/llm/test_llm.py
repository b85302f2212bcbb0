"""Operators of tidegauge.llm against brute force, on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm import ann, byte_bpe, common, hamming, lengths, ngram, packing, quality, registry, secret_scan, simhash, token_files, vectors, word_bpe

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, score double, ids string, block long, label int, bits long, train boolean, n_tokens string, key string, base long"
PIECES = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "日", "1", "99", "\x1c", "ing", "ABC", "!", "_", "　", "😀", "\r\n", "don't", "<", "<|endoftext|>", "Σ", "İ", "½", "'RE", "ÀÉ×÷"]


def scribble(seed, n, most=30):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, most))) for _ in range(n)]


def odd_rows():
    long = " ".join(f"word{i % 97} and" for i in range(9000))
    base = [(1, "the quick brown fox jumps over the lazy dog"), (1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "no id here at all"), (None, None), (4, " \n\t "), (5, long), (6, "Ünïcode  ÀÉ日本 password=abcdef12")]
    return [(*row, 0.5, "x", 7, 1, 3, True, "y", "z", 9) for row in base]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


def texts_by_id(spark, sf=SF):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_perfect_hash_has_a_place_for_each_key_and_no_more():
    keys = [f"k{i}".encode() for i in range(3000)]
    table = byte_bpe.PerfectHash(keys)
    assert [table.place(k) for k in keys] == list(range(len(keys))) and len(table.at) == len(keys)


def test_byte_ids_equal_the_library_and_decode_to_the_text():
    mine, library = byte_bpe.byte_encoder(*byte_bpe.vocabulary(None, None)), lengths.byte_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = [*scribble(1, 3000), "a" * 20_000, "ab" * 9000, " " * 5000, " x", "x ", ""]
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        ids = np.frombuffer(ids, "<i4").tolist()
        assert ids == library.encode_ordinary(text), text
        assert mine.decode(ids) == text.encode()


def test_word_ids_equal_the_library():
    mine = word_bpe.WordEncoder(word_bpe.default_path())
    texts = [*scribble(2, 3000), "x" * 5000, ""]
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == mine.library.encode(text, add_special_tokens=False).ids, text


def test_word_ids_of_plain_and_other_chunks_equal_the_library():
    mine = word_bpe.WordEncoder(word_bpe.default_path())
    letters = "".join(map(chr, range(0x21, 0x250))) + "'s'll\x00\t\x0b\x85\xa0\u0301\u1e9e\u0130\u03a3\u2028<|endoftext|>"
    r = random.Random(4)
    texts = [*letters, *("".join(r.choices(letters + " " * 60 + "\n" * 20, k=r.randrange(60))) for _ in range(3000)), "It'S 'LL don'T", "<|endoftext|>x<|", "", " ", "\n\n"]
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == mine.library.encode(text, add_special_tokens=False).ids, text
    assert mine.encode([""]) == [b""] and mine.encode(["", " "]) == [b"", b""]


def test_word_pieces_are_looked_up_once_a_slice():
    mine = word_bpe.WordEncoder(word_bpe.default_path())
    asked, many = [], common.Recent.many

    class Watched(common.Recent):
        def many(self, keys):
            asked.extend(keys)
            return many(self, keys)

    for name, value in vars(mine).items():
        if isinstance(value, common.Recent):
            setattr(mine, name, Watched(value.make, value.most))
    assert len(set(mine.encode(["The same words, the same\nWORDS. " * 100] * 50))) == 1
    assert len(asked) < 20  # of 30,050 chunks; before, each was looked up


def test_recent_values_met_in_every_call_are_made_once():
    made = []
    small = common.Recent(lambda keys: made.extend(keys) or [k * 2 for k in keys], 10)
    for i in range(20):
        assert small.many([1, 2, 3, *range(100 + i * 6, 106 + i * 6)])[:3] == [2, 4, 6]
    assert [made.count(k) for k in (1, 2, 3)] == [1, 1, 1]  # before, made again in every other call


def test_recent_values_do_not_depend_on_the_memory():
    small = common.Recent(lambda keys: [k * 2 for k in keys], 3)
    assert [small.many([i % 7, i, i]) for i in range(20)] == [[i % 7 * 2, i * 2, i * 2] for i in range(20)]


def test_byte_query_on_odd_rows(odd, none):
    out = byte_bpe.decode_bytes(byte_bpe.encode_bytes(odd)).collect()
    assert sorted(bytes(r.decoded).decode() for r in out) == sorted(r[1] or "" for r in odd_rows())
    assert byte_bpe.decode_bytes(byte_bpe.encode_bytes(none)).count() == 0


def test_byte_query_digests(spark):
    library = lengths.byte_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = texts_by_id(spark)
    for r in registry.op9_byte_bpe(spark, SF).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_length_table_equals_counting(spark, odd, none):
    rows = [0, 0, 1, 5, 5, 5, 4096, 4097, 9000, 9000, None]
    table = lengths.length_table(lengths.length_histogram(spark.createDataFrame([(x,) for x in rows], "n_tokens long"))).cache()
    found = np.array([x or 0 for x in rows])
    for r in table.collect():
        at = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.docs_at_most) == ((found == at).sum(), (found >= at).sum(), found[found >= at].sum(), (found <= at).sum())
        assert r.truncated_total == np.minimum(found, at).sum() and r.quantile == (found <= at).mean()
    limits = [0, 1, 3, 5, 100, 4096, 8999, 9000, 20_000]
    assert {r.context_limit: r.truncated_total for r in lengths.truncated_totals(table, limits).collect()} == {x: np.minimum(found, x).sum() for x in limits}
    assert {r.share: r.n_tokens for r in lengths.quantiles(table, [0.1, 0.5, 1.0]).collect()} == {0.1: 0, 0.5: 5, 1.0: 9000}
    assert lengths.token_counts(odd).agg(F.sum("n_docs")).first()[0] == len(odd_rows())
    assert lengths.token_counts(none).count() == 0


def packed_rows(found, capacity):
    bins = defaultdict(list)
    for length, s, o in found:
        bins[s].append((o, length))
    for own in bins.values():
        at = 0
        for o, length in sorted(own):
            assert o == at
            at += length
        assert at <= capacity.tokens and len(own) <= capacity.documents and sum(x * x for _, x in own) <= capacity.attention
    return bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    sizes = np.random.default_rng(3).integers(1, 101, 700)
    for capacity in (packing.Capacity(100, 100, 10_000, rule=rule), packing.Capacity(100, 3, 10_000, rule=rule), packing.Capacity(100, 100, 10_000, (1.0, 0.5, 0.5), rule), packing.Capacity(200, 4, 40_000, rule=rule)):
        sequence, offset = packing.best_fit(sizes, capacity)
        bins = packed_rows(zip(sizes.tolist(), sequence.tolist(), offset.tolist(), strict=True), capacity)
        if capacity.documents == 100:
            assert len(bins) <= 1.1 * math.ceil(sizes.sum() / capacity.tokens)
    assert len(packing.best_fit(np.zeros(0, np.int64), packing.Capacity())[0]) == 0


def test_packing_odd_rows(spark, odd, none):
    out = packing.pack_documents(odd, end_id=1, capacity=packing.Capacity(64, 64, 64 * 64)).collect()
    packed_rows([(r.length, r.sequence_id, r.offset) for r in out], packing.Capacity(64, 64, 64 * 64))
    whole = defaultdict(bytes)
    for r in sorted(out, key=lambda r: (str(r.doc_id), r.piece)):
        assert r.length == len(r.piece_ids) // 4 and r.piece_crc32 == zlib.crc32(r.piece_ids)
        if r.doc_id in (2, 3, 4, 5, 6):
            whole[r.doc_id] += bytes(r.piece_ids)
    library = word_bpe.word_encoder(word_bpe.default_path()).library
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    for d, raw in whole.items():
        assert np.frombuffer(raw, "<u4").tolist() == [*library.encode(texts[d], add_special_tokens=False).ids, 1]
    assert sum(r.piece == 0 for r in out) == len(odd_rows())
    assert packing.pack_documents(none).count() == 0


def test_packing_uses_few_sequences(spark):
    out = registry.op6_best_fit_packing(spark, SF).collect()
    bins = packed_rows([(r.length, r.sequence_id, r.offset) for r in out], packing.Capacity())
    assert len(bins) <= math.ceil(sum(r.length for r in out) / 4096) + 2


def test_token_files_round_trip(spark, odd, none):
    library = word_bpe.word_encoder(word_bpe.default_path()).library
    out = token_files.token_file_round_trip(odd).collect()
    order = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None, None, 1, 1, 2, 3, 4, 5, 6]
    at = 0
    for r in order:
        assert r.start == at
        at += len(r.ids) // 4
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    for r in order[2:]:
        assert np.frombuffer(r.ids, "<u4").tolist() == [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
    assert token_files.token_file_round_trip(none).count() == 0


def test_bit_sliced_distances_equal_counting():
    rng = np.random.default_rng(4)
    for n in (1, 64, 65, 1000):
        codes = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        codes[::3] = codes[0] ^ (np.uint64(1) << rng.integers(0, 64, len(codes[::3])).astype(np.uint64))
        for radius in (0, 1, 2, 3, 7, 20):
            for q in codes[:5]:
                assert simhash.within(simhash.bit_planes(codes), n, int(q), radius, 4).tolist() == np.flatnonzero(np.bitwise_count(codes ^ q) <= radius).tolist()


def brute_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes_equal_brute_force(spark, odd, none):
    texts = texts_by_id(spark)
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    want = roots(texts, [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    for r in registry.op2_simhash_near_dedup(spark, SF).collect():
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
    found = sorted((r.doc_id is None, r.doc_id or 0, -1 if r.component_id is None else r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert [f[1:] for f in found if not f[0]] == [(1, 1), (1, 1), (2, 2), (3, 2), (4, 2), (5, 5), (6, 6)]
    assert [f[2] for f in found if f[0]] == [-1, 2]
    assert simhash.near_duplicates(none).count() == 0


def test_crowded_buckets_lose_no_link(spark):
    rng = np.random.default_rng(6)
    near = {int(0x0123456789ABCDEF ^ (1 << int(a)) ^ (1 << int(b))) for a, b in rng.integers(0, 64, (400, 2))}
    codes = sorted({*near, *map(int, rng.integers(0, 1 << 63, 50))})
    want = roots(codes, [(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 2])
    frame = spark.createDataFrame([(c if c < 1 << 63 else c - (1 << 64),) for c in codes], "bits long")
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame, 2, most=20).collect()]
    got = roots(codes, pairs)
    assert {frozenset(c for c in codes if got[c] == r) for r in got.values()} == {frozenset(c for c in codes if want[c] == r) for r in want.values()}


def test_components_of_a_chain_a_star_and_pairs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(-5, 7), (300, 301)]
    frame = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    want = roots({n for e in edges for n in e}, edges)
    assert {r.node: r.root for r in simhash.components(frame).collect()} == {n: r for n, r in want.items() if n != r}


def test_quality_separates_and_handles_odd_rows(spark, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = {r.doc_id: r for r in registry.op4_quality_discriminant(spark, "/root/testdata/sf0.01").collect()}
    held = [(r.quality, out[r.doc_id]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if out[r.doc_id].held_out]
    assert np.mean([q == r.predicted for q, r in held]) > 0.97
    learn = common.fold_of(F.col("doc_id"), 4) != 2
    scored = quality.quality_scores(odd, labels, learn).collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0), learn).collect()} == {0.5}
    assert quality.quality_scores(none, labels, learn).count() == 0
    assert quality.keep_good(odd, labels.limit(0), learn).count() == len(odd_rows())


def test_discriminant_is_the_difference_of_gaussian_log_densities(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(1.5, 2, (200, 3))])
    y = [0] * 300 + [1] * 200
    model = quality.fit_discriminant(spark.createDataFrame([(k, v.tolist()) for k, v in zip(y, x, strict=True)], "label int, stats array<double>"), pooling=0.0, ridge=0.0)
    want = []
    for k in (0, 1):
        own = x[np.array(y) == k]
        cov, mean = np.cov(own.T, bias=True), own.mean(axis=0)
        want.append(np.log(len(own) / 500) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean))
    assert np.allclose(model.difference(x), want[1] - want[0])


def test_neighbours_reach_recall_and_leave_unusable_vectors_out(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = {(r.query_id, r.vec_id) for r in registry.op5_multiprobe_neighbours(spark, "/root/testdata/sf0.01").collect()}
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    np.fill_diagonal(cos, -9)
    want = {(ids[i], ids[j]) for i in np.flatnonzero(ids % 50 == 0) for j in np.argsort(-cos[i], kind="stable")[:5]}
    assert len(want & got) >= 0.9 * len(want)
    nan, inf = float("nan"), float("inf")
    odd = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (50, [2.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (10, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(*r, 1.0, "c", 2) for r in odd], "vec_id long, embedding array<double>, score double, key string, rank int")
    out = ann.approximate_neighbours(frame, F.col("id") % 50 == 0, k=3).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in out) == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert ann.approximate_neighbours(frame.limit(0), F.col("id") % 50 == 0).count() == 0


def nearest_by_brute_force(rows, queries, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    np.fill_diagonal(cos, -9)
    return {(int(ids[i]), int(ids[j])) for i in np.flatnonzero(np.isin(ids, queries)) for j in np.argsort(-cos[i], kind="stable")[:k]}


def test_vectors_of_every_length_and_magnitude_are_compared(spark):
    rng = np.random.default_rng(21)
    rows = {dims: [(first + i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, dims)))] for dims, first, n in ((8, 0, 400), (5, 1000, 300), (3, 2000, 40))}
    queries = [i for first in (0, 1000, 2000) for i in range(first, first + 40, 10)]
    scaled = [(i, [c * {0: 1.0, 1: 1e200, 2: 1e-200}[i % 3] for c in v]) for own in rows.values() for i, v in own]
    out = ann.approximate_neighbours(spark.createDataFrame(scaled, "vec_id long, embedding array<double>"), F.col("id").isin(queries), k=3).collect()
    got = {(r.query_id, r.id) for r in out}
    assert len(out) == 3 * len(queries)
    for own in rows.values():
        want = nearest_by_brute_force(own, queries, 3)
        assert len(want & got) >= 0.8 * len(want)
    assert nearest_by_brute_force(rows[3], queries, 3) <= got


def test_recall_is_kept_where_the_probes_do_not_reach(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(22).normal(size=(1500, 64)))]
    frame, queries = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), list(range(0, 1500, 50))
    want = nearest_by_brute_force(rows, queries, 5)
    for tables, most_probes in ((1, 1), (2, 8)):
        got = {(r.query_id, r.id) for r in ann.approximate_neighbours(frame, F.col("id") % 50 == 0, tables=tables, most_probes=most_probes).collect()}
        assert len(got & want) >= 0.95 * len(want), (tables, most_probes)


def test_perturbations_come_by_cost_and_do_not_repeat():
    place = np.array([3.2, -1.9, 0.55, 7.01])
    rows = ann.perturbations(place, 500)
    cost = [sum((place[k] - np.floor(place[k])) ** 2 if d < 0 else (1 - place[k] + np.floor(place[k])) ** 2 for k, d in enumerate(s - np.floor(place)) if d) for s in rows]
    assert len({tuple(r) for r in rows}) == len(rows) == 3**4 and all(b >= a - 1e-12 for a, b in zip(cost, cost[1:], strict=False))


def test_hamming_search_is_exact(spark):
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 256, (300, 3), dtype=np.uint8)
    codes[50:120] = codes[0]
    rows = [(i, bytes(c)) for i, c in enumerate(codes)]
    frame = spark.createDataFrame([*rows, rows[3], (None, b"abc"), (900, None), (901, b""), (902, b"xy")], "id long, key binary")
    got = defaultdict(list)
    for r in hamming.hamming_top_k(frame, F.col("id") % 20 == 0, k=4, block=64, queries_at_once=5).collect():
        got[r.query_id].append((r["rank"], r.distance, r.id))
    for q in range(0, 300, 20):
        want = sorted((int(np.bitwise_count(codes[q] ^ codes[i]).sum()), i) for i in range(300) if i != q)[:4]
        assert sorted(got[q]) == [(k + 1, *w) for k, w in enumerate(want)]
    assert 900 not in got and hamming.hamming_top_k(frame.limit(0), F.col("id") == 0).count() == 0


def test_hamming_query_equals_brute_force(spark):
    rows = [(r.vec_id, np.packbits(np.array(r.embedding) > 0)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = defaultdict(list)
    for r in registry.op7_hamming_top_k(spark, SF).collect():
        got[r.query_id].append((r["rank"], r.distance, r.vec_id))
    for q, code in rows:
        if q % 20 == 0:
            want = sorted((int(np.bitwise_count(code ^ c).sum()), i) for i, c in rows if i != q)[:10]
            assert sorted(got[q]) == [(k + 1, *w) for k, w in enumerate(want)]


def test_pairs_of_blocks_go_to_several_tasks(spark):
    """They are few bytes, so that adaptive execution would give them all to one task."""
    frame = spark.createDataFrame([(i, i.to_bytes(2)) for i in range(400)], "rep long, key binary").withColumn("length", F.octet_length("key"))
    compare = lambda found, queries: queries[["rep"]].head(1)
    tasks = vectors.in_blocks(frame, frame, ["length"], compare, "rep long", 50, 50).select(F.spark_partition_id().alias("task"))
    assert tasks.distinct().count() > 1 and tasks.count() >= 16


@pytest.mark.parametrize("length", [3, 8, 9, 20])
def test_segment_tables_find_the_nearest_and_read_few_codes(length, monkeypatch):
    codes = np.random.default_rng(length).integers(0, 256, (20000, length), dtype=np.uint8)
    codes[::2, 1:] = codes[0, 1:]  # half of the codes are close to one another
    tables, read, at_radius = hamming.SegmentTables(codes), [], hamming.SegmentTables.at_radius
    monkeypatch.setattr(hamming.SegmentTables, "at_radius", lambda *a: read.append(at_radius(*a)) or read[-1])
    queries = codes[[0, 2, 4]]
    for query, (numbers, distances) in zip(queries, tables.nearest(queries, 7), strict=True):
        want = np.bitwise_count(codes ^ query).sum(axis=1)
        best = np.lexsort((np.arange(len(codes)), want))[:7]
        assert numbers.tolist() == best.tolist() and distances.tolist() == want[best].tolist()
    few = np.random.default_rng(1).integers(0, 256, (20000, 4), dtype=np.uint8)
    read.clear()
    hamming.SegmentTables(few).nearest(few[:50], 5)
    assert sum(map(len, read)) < 50 * len(few) / 10  # segments of eight bits read more than half


def test_interpolation_counts_and_held_out_gain(spark):
    texts = texts_by_id(spark)
    words = {d: [*t.encode().lower().split(), b"\n"] for d, t in texts.items()}
    counts = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v, base, score = sum(counts.values()), len(counts), 0.0, 0.0
    for r in registry.op1_deleted_interpolation(spark, SF).collect():
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words[r.doc_id]), sum(counts[w] > 0 for w in words[r.doc_id]), n)
        assert r.base_score == pytest.approx(want, rel=1e-9) and r.score < 0
        if r.held_out:
            base, score = base + r.base_score, score + r.score
    assert score > base


def test_interpolation_score_is_the_mixture(spark, monkeypatch):
    rows = [(1, "a b a b"), (2, "a c"), (3, None), (4, "b z")]
    monkeypatch.setattr(ngram, "maximise", lambda events: np.tile([0.6, 0.3, 0.1], (ngram.LEVELS, 1)))
    out = {r.doc_id: r for r in ngram.deleted_interpolation(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 4).collect()}
    seqs = {d: ["<"] + (t or "").split() + [">"] for d, t in rows}
    uni = Counter(w for d in (1, 2, 3) for w in seqs[d][1:])
    bi = Counter(p for d in (1, 2, 3) for p in zip(seqs[d], seqs[d][1:], strict=False))
    context = Counter(h for d in (1, 2, 3) for h in seqs[d][:-1])
    n, v = sum(uni.values()), len(uni)
    for d, s in seqs.items():
        p = [0.6 * (bi[h, w] / context[h] if context[h] else uni[w] / n) + 0.3 * uni[w] / n + 0.1 / (v + 1) for h, w in zip(s, s[1:], strict=False)]
        assert out[d].score == pytest.approx(sum(map(math.log10, p)), rel=1e-9)


def test_interpolation_odd_rows(odd, none):
    out = ngram.deleted_interpolation(odd, F.col("doc_id") != 6).collect()
    assert len(out) == len(odd_rows()) and all(math.isfinite(r.score) for r in out)
    assert sorted(r.n_tokens for r in out if r.doc_id in (2, 3, 4)) == [1, 1, 1]
    assert all(not r.train for r in out if r.doc_id is None)
    assert ngram.deleted_interpolation(none, F.lit(True)).count() == 0
    nothing = ngram.deleted_interpolation(odd, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in nothing)


def test_secret_rules_equal_plain_expressions():
    parts = ["password", "PassWord", "token", "=", ": ", ' = "', "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "abc", " ", "'", "api_key", "apikey:", "é", "\n", "secret"]
    r = random.Random(5)
    rule = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        want = [(m.start(), 0, m.end()) for m in rule.finditer(x) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
        assert secret_scan.base_spans(x) == sorted(want)
        for a, b in secret_scan.other_runs(x, sorted(want)):
            assert b - a >= 12 and all(b <= s or a >= e for s, _, e in want)


def test_secret_scan_odd_rows_and_redaction(odd, none):
    found = {(r.doc_id, len(r.findings)) for r in secret_scan.scan_secrets(odd).collect()}
    assert (6, 1) in found and (2, 0) in found and (None, 0) in found
    clean = {r.doc_id: r for r in secret_scan.redact_documents(odd, length_col="base").collect()}
    assert clean[6].text.endswith("日本 [SECRET]") and clean[6].base == len(clean[6].text) and clean[2].text is None and clean[5].base == 9
    assert secret_scan.scan_secrets(none).count() == 0
    assert secret_scan.redact("ab12cd", [(1, 3), (2, 4)]) == "a[SECRET]cd"


def test_network_tells_keys_from_words(spark):
    r = random.Random(3)
    keys = ["".join(r.choice("0123456789abcdef") for _ in range(r.randint(16, 40))) for _ in range(300)]
    names = ["host" + str(r.randint(1, 99)) + ".example.com" + "x" * r.randint(0, 5) for _ in range(300)]
    x = np.frombuffer(b"".join(secret_scan.window(f"see {k} now", 4, 4 + len(k)) for k in keys + names), np.uint8).reshape(-1, secret_scan.WINDOW)
    y = np.array([1.0] * 300 + [0.0] * 300)
    order = np.random.default_rng(1).permutation(600)
    net = secret_scan.train_network(x[order], y[order], recall=0.95)
    hit = net.score(x) >= net.threshold
    assert hit[:300].mean() > 0.9 and hit[300:].mean() < 0.05


def test_every_character_of_a_long_candidate_is_scored():
    table = np.zeros((5, secret_scan.INPUTS, 1))
    for k, c in enumerate("KQZXJ"):
        table[k, secret_scan.CODES[ord(c)] + secret_scan.CLASSES, 0] = 1
    net = secret_scan.Network(table, np.array([-4.5]), np.array([40.0]), -10.0)
    for n in (12, 39, 40, 41, 64, 65, 88, 89, 200, 5000):
        for at in {0, 1, n // 3, n // 2, n - 6, n - 5}:
            run = "a" * at + "KQZXJ" + "b" * (n - at - 5)
            seen = secret_scan.window(f"see {run} now", 4, 4 + n)
            clean = secret_scan.window(f"see {'a' * n} now", 4, 4 + n)
            high, low, again = net.score_candidates([seen, clean, seen])
            assert high == again > 0.5 > low, (n, at)
    windows = secret_scan.slid(secret_scan.window("x" * 9000, 0, 9000))
    assert len(windows) > 300 and windows.shape[1] == secret_scan.WINDOW


def test_keys_of_a_form_the_rules_miss_are_found(spark):
    r = random.Random(12)
    words = "river stone market winter garden letter yellow bridge people morning paper mountain silver window".split()
    key = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    prose = lambda: " ".join(r.choice(words) for _ in range(30))
    rows = [(i, f"{prose()} password = {key()} {prose()}") for i in range(150)] + [(i, f"{prose()} {key()} {prose()}") for i in range(1000, 1900)]
    rows += [(i, f"{prose()} {r.choice(words)}/{r.choice(words)}-{r.choice(words)}_{r.randint(1, 999)} {prose()}") for i in range(3000, 3200)]
    found = {x.doc_id: [f.kind for f in x.findings] for x in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("assign" in found[i] for i in range(150))
    assert sum(found[i] == ["model"] for i in range(1000, 1900)) >= 0.9 * 900
    assert sum(found[i] == ["model"] for i in range(3000, 3200)) <= 0.1 * 200


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = common.staged(stage(spark, before, SF), "test-stage")
        assert kept.columns == columns, name
        if name == "SimHash near-dedup":
            prints = {r.doc_id: brute_fingerprint(r.text or "") for r in before.collect()}
            want = roots(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
            assert {r.doc_id for r in kept.collect()} == set(want.values())
        if name == "secret scan":
            assert kept.count() == before.count()
            assert not any(secret_scan.base_spans(r.text or "") for r in kept.collect())
    packed = corpus_pipeline.packing(spark, kept, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()}
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())


def test_dedup_keeps_all_texts_of_a_repeated_id(spark):
    text = lambda seed: " ".join(f"w{random.Random(seed * 1000 + i).randint(0, 10**6)}" for i in range(60))
    rows = [(3, text(3)), (3, text(3)), (5, text(50)), (5, text(3)), (5, text(51)), (7, text(50)), (None, text(8)), (None, text(9)), (8, text(8)), (5, text(60))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id or -1, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()))
    assert kept == sorted([(3, text(3)), (5, text(50)), (5, text(51)), (5, text(60)), (-1, text(8)), (-1, text(9))])


def test_dedup_keeps_a_column_named_like_its_row_number(spark):
    rows = [(i, f"some words that stand here once {i} " * 9, -7, i * 10) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_no int, ROW_NO_ long")
    assert sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, SF).collect())) == rows


def test_stages_take_odd_rows(spark):
    rows = [(1, "a few clean words in a line", None, "s", 27), (1, "a few clean words in a line", None, "s", 27), (None, "a few clean words in a line!", "en", None, None), (None, None, None, None, None), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, SF).collect()


def test_every_bucket_goes_through_the_bit_sliced_comparison(monkeypatch):
    rng = np.random.default_rng(12)
    asked, close = [], simhash.close_pairs
    monkeypatch.setattr(simhash, "close_pairs", lambda planes, n, codes, radius, **more: asked.append(n) or close(planes, n, codes, radius, **more))
    sizes = (1, 2, 3, 64, 65, 700)
    for n in sizes:
        codes = np.unique(np.uint64(0x0F0F) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)))
        pairs = [(i, j) for i in range(len(codes)) for j in range(i) if int(codes[i] ^ codes[j]).bit_count() <= 2]
        assert roots(range(len(codes)), pairs) == roots(range(len(codes)), simhash.forest(codes, 2).tolist())
    assert len(asked) == len(sizes)


def test_hot_fingerprints_join_like_others(spark, monkeypatch):
    rows = [(i, "same words in every copy here") for i in range(40)] + [(100 + i, f"text {i} of its own {i * i} kind {i * 7}") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, simhash.near_duplicates(frame).collect()))
    monkeypatch.setattr(simhash, "HOT_SHARE", 3)
    assert sorted(map(tuple, simhash.near_duplicates(frame).collect())) == plain and len(plain) == 70
    assert {c for d, _, c in plain if d < 40} == {0}


def test_every_long_run_is_a_candidate():
    text = "plain words, AbCdEfGhIjKlMnOpQrStUvWxYz and 123456789012 or a/b-c_d=e+fgh; short1 ------------ é" + "x" * 12
    runs = [text[a:b] for a, b in secret_scan.other_runs(text, [])]
    assert runs == [m[0] for m in re.finditer(r"[A-Za-z0-9+/_=-]{12,}", text)] and len(runs) == 5
    assert [text[a:b] for a, b in secret_scan.other_runs(text, [], least=6)] == [m[0] for m in re.finditer(r"[A-Za-z0-9+/_=-]{6,}", text)]
    first = secret_scan.window("key: secret = 'abcDEF12'", 5, 23)
    assert secret_scan.bare(first) == secret_scan.window(" abcDEF12 ", 1, 9)
    assert secret_scan.bare(first, secret_scan.window("the river, then", 4, 9)) == secret_scan.window("the abcDEF12, then", 4, 12)


def test_keys_of_letters_alone_are_found_and_clean_runs_left(spark):
    r = random.Random(21)
    words = "river stone market winter garden letter international responsibilities state-of-the-art characteristically --------------------".split()
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    key = lambda n, of: "".join(r.choice(of) for _ in range(n))
    prose = lambda: " ".join(r.choice(words) for _ in range(30))
    rows = [(i, f"{prose()} password = {key(24, letters + '0123456789')} {prose()}") for i in range(300)]
    rows += [(i, f"{prose()} {key(26, letters)} {prose()}") for i in range(1000, 1100)] + [(i, f"{prose()} {prose()}") for i in range(3000, 3200)]
    found = {x.doc_id: [f.kind for f in x.findings] for x in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("model" in found[i] for i in range(1000, 1100)) >= 40  # before, none was a candidate
    assert sum("model" in found[i] for i in range(3000, 3200)) <= 4


def test_secret_query_equals_plain_expressions(spark):
    rule = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    texts, kinds = texts_by_id(spark), ("assign", "access", "hex", "model")
    for row in registry.op10_secret_scan(spark, SF).collect():
        x = texts.pop(row.doc_id)
        base = [(m.start(), 0, m.end()) for m in rule.finditer(x) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(base))
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        spans = [(int(a), kinds.index(k), int(b)) for k, a, b in (s.split(":") for s in row.spans.split(",") if s)]
        assert spans == sorted(spans) and sorted(base) == [s for s in spans if s[1] < 3]
    assert not texts


def test_token_queries_equal_the_library(spark):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts, start, seen = texts_by_id(spark), 0, {r.doc_id: r for r in registry.op8_token_files(spark, SF).collect()}
    assert len(seen) == len(texts)
    for doc_id in sorted(texts):
        ids = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 2], "<u4")
        row = seen[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_length_query_equals_counting(spark):
    encode = lengths.byte_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    sizes = sorted(len(encode.encode_ordinary(t)) for t in texts_by_id(spark).values())
    got = {r.n_tokens: r for r in registry.op3_token_counts(spark, SF).collect()}
    assert set(got) == set(sizes)
    for n, row in got.items():
        longer, at_most = [s for s in sizes if s >= n], sum(s <= n for s in sizes)
        assert (row.n_docs, row.docs_at_least, row.tokens_at_least, row.docs_at_most) == (sizes.count(n), len(longer), sum(longer), at_most)
        assert row.truncated_total == sum(min(s, n) for s in sizes) and row["quantile"] == pytest.approx(at_most / len(sizes))


@pytest.mark.parametrize("distinct", [0, 5, 400, 6000])
def test_training_windows_are_chosen_from_few_rows_whatever_the_partitions(spark, distinct):
    names = [f"candidate {i}".encode() for i in range(distinct)]
    rows = spark.createDataFrame([(w, b"p" if i % 2 else None) for i, w in enumerate(names * 3)], "w binary, place binary").repartition(64)
    low = secret_scan.lowest_hashes(rows, 400)
    want = rows.groupBy("w").agg(F.xxhash64("w").alias("h")).orderBy("h", "w").limit(400)
    first = low.groupBy("w").agg(F.xxhash64("w").alias("h")).orderBy("h", "w").limit(400)
    assert first.collect() == want.collect()
    assert low.count() <= 3 * (400 + 10)


def test_rows_of_one_id_take_several_token_files(spark, tmp_path):
    docs = spark.createDataFrame([(None, "same words")] * 3000 + [(i, f"text {i}") for i in range(1000)], "doc_id long, text string").repartition(6)
    files = token_files.write_token_files(docs, str(tmp_path), ranges=8)
    sizes = [r.n_docs for r in files.collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1500
    rows = token_files.read_token_files(files).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None] * 3000 + list(range(1000)) and len({r.start for r in rows}) == 4000
    assert len({bytes(r.ids) for r in rows[:3000]}) == 1


def test_the_network_learns_from_all_findings_and_counterexamples(spark, monkeypatch):
    r = random.Random(8)
    words = "river stone market winter garden letter yellow bridge people morning paper mountain silver window".split()
    key = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(20))
    docs = spark.createDataFrame([(i, f"{r.choice(words)} {key()[:8]} {''.join(r.sample('abcdefghijklmnop', 9))} token = {key()}") for i in range(3000)], "doc_id long, text string").repartition(8)
    found = common.staged(secret_scan.find_candidates(docs), "found")
    rows = secret_scan.with_held(secret_scan.training_rows(found)).cache()
    counts = {(x.label, x.held): x["count"] for x in rows.groupBy("label", "held").count().collect()}
    assert counts[1, False] + counts[1, True] == 6000 and counts[0, False] + counts[0, True] > 3000  # before, 2,000 of each at most
    assert rows.groupBy("label", "fold").agg(F.countDistinct("held").alias("n")).where("n > 1").count() == 0
    net = secret_scan.learn_network(found, 0.98)
    assert net.held[0] == counts[1, True] and net.held[1] >= 0.98
    few = rows.where("label = 0").unionByName(rows.where("label = 1").limit(3))
    dealt = secret_scan.in_parts(few, 500).groupBy("part").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad")).collect()
    assert len(dealt) > 5 and all(x.good == 3 and x.bad > 0 for x in dealt)


def test_ordinary_words_equal_a_plain_loop():
    odd = ["ǅ", "𝐀", "𝐚b", "²", "ª", "ﬁn", "ß", "\ud800", "secret='abcdef1'", "deadbeef" * 4, "mytoken=qwertyuiop", "AKIA" + "Z" * 17]
    r = random.Random(6)
    for text in ["", " ", *("".join(r.choice(PIECES + odd) for _ in range(r.randint(0, 40))) for _ in range(3000))]:
        taken = [(a, b) for a, _, b in secret_scan.base_spans(text)]
        words = [m for m in re.finditer(r"\S+", text) if m[0].isalpha() and m[0][1:] == m[0][1:].lower() and not any(a < m.end() and m.start() < b for a, b in taken)]
        starts, ends = secret_scan.ordinary_words(text, taken)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [m.span() for m in words]
        made = secret_scan.counterexamples(text, secret_scan.classes(text), taken)
        longest = max(words, key=lambda m: len(m[0]), default=None)
        assert made[:2] == [secret_scan.window(text, *m.span()) for m in ([words[len(words) // 2], longest] if words else [])]


@pytest.mark.parametrize("least", [6, 12, 24, 40])
def test_findings_and_other_runs_do_not_depend_on_the_least_length(least):
    r = random.Random(7)
    parts = [*PIECES, "0123456789abcdef" * 2, "x/y", "token: ", "abcdef12", "AKIA" + "Q" * 16, "-" * 20]
    for text in ("".join(r.choice(parts) for _ in range(20)) for _ in range(500)):
        base = sorted((m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{24,}", text))
        found, other = secret_scan.all_spans(text, least)
        assert [f for f in found if f[1] == 2] == base and found == secret_scan.base_spans(text)
        runs = [m.span() for m in re.finditer("[A-Za-z0-9+/_=-]+", text) if len(m[0]) >= least]
        assert other == [(a, b) for a, b in runs if not any(p < b and a < q for p, _, q in found)]


def test_scores_are_read_without_what_only_training_needs(spark):
    found = secret_scan.scan_secrets(spark.read.parquet(f"{SF}/documents.parquet"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    read = found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "window:binary" in read and "place" not in read


def test_parts_are_learned_from_in_several_tasks(spark, monkeypatch):
    """They are few bytes, so that adaptive execution would give them all to one task."""
    rows = spark.createDataFrame([(i % 2, secret_scan.window(f"the word{i} here", 4, 9), i % 16) for i in range(320)], "label int, codes binary, part long")
    plans, grouped = [], type(rows).groupBy
    monkeypatch.setattr(type(rows), "groupBy", lambda df, *by: plans.append((by, df)) or grouped(df, *by))
    secret_scan.learned_round(rows, secret_scan.starting_network(), 0.01)
    (spread,) = [df for by, df in plans if by == ("part",)]
    assert "REPARTITION_BY_NUM" in spread._jdf.queryExecution().executedPlan().toString()
