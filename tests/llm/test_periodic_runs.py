"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidegauge.llm import periodic_runs as pr
from tidegauge.llm import registry

from .test_llm import ODD, SF, odd_rows, texts_by_id


def brute_runs(words, least=24, times=3):
    """All maximal stretches for each period, smallest period first; one inside a run of a divisor is that run's."""
    x, out = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if len(words) else np.zeros(0, int), []
    for q in range(1, len(words) // times + 1):
        same = np.concatenate([[0], (x[:-q] == x[q:]).astype(int), [0]])
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for s, e in zip(starts.tolist(), (ends + q).tolist(), strict=True):
            if e - s >= max(least, times * q) and not any(q % p == 0 and a <= s and e <= a + n for a, n, p in out):
                out.append((s, e - s, q))
    return sorted(out)


def runs(texts):
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    number = {}
    words = np.array([number.setdefault(w, len(number)) for i in order for w in texts[i]], np.int64)
    out = [None] * len(texts)
    for i, own in zip(order, pr.runs_of(words, np.cumsum([0, *(len(texts[i]) for i in order)])), strict=True):
        out[i] = own
    return out


@pytest.mark.parametrize("size", [2, 8, 16, 64, 128, 512])
def test_transform_is_exact(size):
    x = np.random.default_rng(size).integers(0, pr.MODULUS, (5, size))
    root = pow(pr.ROOT, (pr.MODULUS - 1) // size, pr.MODULUS)
    want = [[sum(int(v) * pow(root, i * k, pr.MODULUS) for i, v in enumerate(row)) % pr.MODULUS for k in range(size)] for row in x]
    got = pr.transform(x.astype(float))
    assert (np.rint(got).astype(int) % pr.MODULUS).tolist() == want
    assert (np.rint(pr.transform(got, inverse=True)).astype(int) * pow(size, -1, pr.MODULUS) % pr.MODULUS == x).all()


@pytest.mark.parametrize("scale, block, chunks", [(8, 8, [0, 1]), (16, 16, [1]), (64, 16, [4, 5, 6, 7])])
def test_zero_mismatches_equal_comparison(scale, block, chunks):
    rng = np.random.default_rng(scale)
    codes = rng.integers(0, 2, 3000)
    codes[500:1500] = np.tile(codes[500 : 500 + chunks[-1] * block + 3], 1000)[:1000]
    got = set(zip(*(a.tolist() for a in pr.repeats(codes, scale, block, chunks)), strict=True))
    padded = np.concatenate([codes, np.zeros(4 * scale + block, int)])
    want = {(s, d) for s in range(0, len(codes) - block + 1, scale) for d in range(chunks[0] * block, (chunks[-1] + 1) * block) if (padded[s : s + block] == padded[s + d : s + d + block]).all()}
    assert got == want and len(want) > 10


def words_with_runs(r, n):
    words = [f"w{r.randint(0, r.choice((3, 50, 500)))}" for _ in range(n)]
    for _ in range(r.randint(0, 4)):
        if n > 30:
            a, q = r.randrange(n), r.randint(1, max(1, n // 4))
            for i in range(a + q, min(n, a + q * r.randint(2, 6) + r.randint(0, q))):
                words[i] = words[i - q]
    return words


def test_runs_equal_brute_force():
    r = random.Random(7)
    for _ in range(12):
        texts = [words_with_runs(r, r.choice((0, 1, 23, 24, 30, 70, 200, 600, 1500))) for _ in range(25)]
        texts += [["a"] * r.randint(0, 300), ["a", "b"] * r.randint(0, 200), [r.choice("ab") for _ in range(400)], ["a", "a", "b"] * 40 + ["a", "b"] * 40]
        assert runs(texts) == [brute_runs(t) for t in texts]


def test_periods_longer_than_the_widest_block(monkeypatch):
    monkeypatch.setattr(pr, "WIDEST", 32)
    monkeypatch.setattr(pr, "ROWS_AT_ONCE", 1 << 10)
    r = random.Random(8)
    texts = [words_with_runs(r, 2500) for _ in range(6)]
    for q in (31, 32, 33, 63, 64, 65, 127, 128, 129, 300, 511, 512, 700):
        period = [str(r.random()) for _ in range(q)]
        texts.append([str(r.random()) for _ in range(r.randint(0, 90))] + (period * 3)[: 3 * q] + ["end"])
    assert runs(texts) == [brute_runs(t) for t in texts]
    assert all(any(n == 3 * q for _, n, q in own) for own in runs(texts)[6:])


def contract(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    own = brute_runs([w.hex() for w in words])
    top = min(own, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
    gone = {i for s, n, q in own for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (len(own), *best, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark):
    want = {d: contract(d, t) for d, t in texts_by_id(spark).items()}
    got = {r.doc_id: tuple(r)[1:] for r in registry.op13_periodic_runs(spark, SF).collect()}
    assert got == want and sum(r[0] > 0 for r in want.values()) > 5


def test_odd_rows_and_whole_results(spark):
    rows = [(*row[:1], row[1], *row[2:]) for row in odd_rows()]
    got = pr.periodic_runs(spark.createDataFrame(rows, ODD), plant=True).collect()
    assert sorted(map(str, (tuple(r)[:8] for r in got))) == sorted(str((row[0], *contract(row[0], row[1]))) for row in rows)
    for r in got:
        assert len(r.runs) == r.n_runs and hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256
    assert pr.periodic_runs(spark.createDataFrame([], ODD)).count() == 0
