"""Secret scan: base rules, and a character convolutional network over every candidate and its surroundings.

Candidates are the findings of the rules and all other runs of key characters of a least length. The
network learns from all labelled findings of the corpus itself: what the rules found, whole or cut and without the
words that gave it away, against ordinary words, runs made of them and ruled lines. Other candidates carry no label, for they may
be what the rules miss. Parts of the training rows are learned from in different tasks, round by round, and the networks of a
round are averaged. A logistic curve calibrates the output, and the threshold is the highest that keeps the wanted recall, both
over all findings and counterexamples held out. Rule findings always stay.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freed_shuffles, keyed_texts, slices, staged

# The rules, with the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX_LEAST = 24
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "model")

HINTS = ("passw", "secret", "token", "key")
KEY_CHARACTERS = "[A-Za-z0-9+/_=-]"
CANDIDATE_LEAST = 12
SIDE, MIDDLE = 12, 40
WINDOW = 2 * SIDE + MIDDLE
STEP = WINDOW - MIDDLE
"""From one window of a long candidate to the next: any ``MIDDLE`` characters in a row lie whole in one of them."""
AT_ONCE = 256
ROUNDS = 3
PART_WINDOWS = 16_384
"""Training windows of the larger class in a part, which one task learns from."""
PART_LEAST = 64
"""Rows of either class that a part gets on average, by copies if the class is rare."""
BIN = 1 / 256
MOST_BIN = 1 << 14
SCALE = 1 << 32
FINDING = "array<struct<kind:string,start:int,end:int,base:boolean,window:binary,place:binary>>"


def key_runs(text: str, least: int = CANDIDATE_LEAST) -> list[tuple[int, int]]:
    """All runs of key characters, ``least`` long or more."""
    return [m.span() for m in re.finditer(f"{KEY_CHARACTERS}{{{least},}}", text)]


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rules' findings, in order. ``runs``: those of key characters, if known, of a least
    length that no hex finding is below; without a long one there is no hex finding to look for."""
    folded = text.lower()
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST] if any(h in folded for h in HINTS) else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if runs is None or any(b - a >= HEX_LEAST for a, b in runs):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def clear_of(runs: list[tuple[int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Those of ``runs`` that touch none of ``taken``; both in order."""
    out, busy = [], iter([*taken, (sys.maxsize, 0, sys.maxsize)])
    nearest = next(busy)
    for start, end in runs:
        while nearest[2] <= start:
            nearest = next(busy)
        if nearest[0] >= end:
            out.append((start, end))
    return out


def other_runs(text: str, taken: list[tuple[int, int, int]], least: int = CANDIDATE_LEAST) -> list[tuple[int, int]]:
    """All runs of key characters, ``least`` long or more, clear of ``taken``."""
    return clear_of(key_runs(text, least), taken)


def all_spans(text: str, least: int = CANDIDATE_LEAST) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """The rules' findings and the other runs of key characters."""
    runs = key_runs(text, least)
    base = base_spans(text, runs if least <= HEX_LEAST else None)
    return base, clear_of(runs, base)


# Classes of characters: one per letter, one for digits, others for what stands around keys.
CODES = np.zeros(256, np.uint8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"):
    CODES[ord(_c)] = _i + 1
for _i, _group in enumerate(("0123456789", " ", "\n\t\r", "\"'", "=", ":", "-_", "/+", ".", "@", ",;!?()|")):
    for _c in _group:
        CODES[ord(_c)] = 53 + _i
CODES[128:] = 64
CLASSES = 65
INPUTS = 2 * CLASSES  # the same classes again for what lies inside the candidate


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def classes(text: str) -> np.ndarray:
    return CODES[np.minimum(code_points(text), 255)]


def window(text: str, start: int, end: int) -> bytes:
    """Classes of the whole candidate between those around it, ``WINDOW`` of them at least; 0 is nothing."""
    left = min(start, SIDE)
    return cut_window(classes(text[start - left : end + SIDE]), left, left + end - start)


def cut_window(codes: np.ndarray, start: int, end: int) -> bytes:
    """``window`` from the ``classes`` of a text."""
    left = min(start, SIDE)
    around = codes[start - left : end + SIDE]
    out = np.zeros(max(WINDOW, 2 * SIDE + end - start), np.uint8)
    out[SIDE - left : SIDE - left + len(around)] = around
    out[SIDE : SIDE + end - start] += CLASSES
    return out.tobytes()


def slid(found: bytes) -> np.ndarray:
    """(windows, WINDOW): overlapping windows over all of a candidate; the last ends with it."""
    codes = np.frombuffer(found, np.uint8)
    last = len(codes) - WINDOW
    if not last:
        return codes[None]
    return np.lib.stride_tricks.sliding_window_view(codes, WINDOW)[np.array([*range(0, last, STEP), last])]


SPACE, LETTER, NOT_CAPITAL, UNKNOWN = 1, 2, 4, 255
LETTERS = np.full(sys.maxunicode + 1, UNKNOWN, np.uint8)
"""Of each code point met so far, what ordinary words ask of it."""


def letters(text: str) -> np.ndarray:
    """For each character of ``text`` the sum of those that hold: it is white space, a letter, a letter that is its own
    small form."""
    codes = code_points(text)
    if len(new := np.unique(codes[LETTERS[codes] == UNKNOWN])):
        LETTERS[new] = [SPACE * c.isspace() + LETTER * c.isalpha() + NOT_CAPITAL * (c.isalpha() and c == c.lower()) for c in map(chr, new.tolist())]
    return LETTERS[codes]


def ordinary_words(text: str, taken: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of letters only, small but for their first, that touch no rule finding (``taken``)."""
    kinds = letters(text)
    for start, end in taken:
        kinds[start:end] = 0
    space = np.concatenate([[True], kinds == SPACE, [True]])
    turns = np.flatnonzero(space[1:] != space[:-1])
    start, end = turns[::2], turns[1::2]
    others = np.concatenate([[0], np.cumsum(kinds & NOT_CAPITAL == 0)])  # before each character
    ordinary = (kinds[start] & LETTER > 0) & (others[end] == others[start + 1])
    return start[ordinary], end[ordinary]


def counterexamples(text: str, codes: np.ndarray, taken: list[tuple[int, int]]) -> list[bytes]:
    """Windows known to be clean: an ordinary word, the longest one, and in its place a made-up run of words after it
    (joined by key marks or by capitals, some with a short number, as paths and names have) or a ruled line. ``codes``: the
    ``classes`` of the text."""
    starts, ends = ordinary_words(text, taken)
    if not len(starts):
        return []
    start, end = int(starts[len(starts) // 2]), int(ends[len(starts) // 2])
    longest = np.argmax(ends - starts)
    out = [cut_window(codes, start, end), cut_window(codes, int(starts[longest]), int(ends[longest]))]
    free = next((a for a, _ in taken if a >= end), len(text))
    words = [w for w in text[start : min(start + 200, free)].split()[:-1] if w.isascii() and w.isalpha() and w[1:] == w[1:].lower()]
    if len(words) > 1:
        pick = zlib.crc32(" ".join(words).encode())
        mark, some, number = ("", *"/-_+=-_")[pick % 8], words[: 2 + pick // 8 % 4], pick // 32 % 10 ** (1 + pick // 32 % 4)
        run = mark.join(some if mark else [some[0], *(w.capitalize() for w in some[1:])]) + f"{mark}{number}" * (pick // 1024 % 2)
        rule = "-=_+/"[pick // 2048 % 5] * (CANDIDATE_LEAST + pick // 8192 % 60)
        left, right = text[max(0, start - SIDE) : start], text[end : end + SIDE]
        out += [window(left + made + right, len(left), len(left) + len(made)) for made in ((run, rule) if pick // 4096 % 4 == 0 else (run,))]
    return out


def find_candidates(docs: DataFrame, least: int = CANDIDATE_LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found, plain): candidates of every row, in order, and windows known to be clean as counterexamples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("window", pa.binary()), ("place", pa.binary())]))
        for batch in batches:
            found, plain = [], []
            for text in batch.column("text").to_pylist():
                base, other = all_spans(text, least)
                spans = sorted(base + [(a, 3, b) for a, b in other])
                codes = classes(text)
                plain.append(counterexamples(text, codes, [(a, b) for a, _, b in base]))
                found.append([{"kind": KINDS[k], "start": a, "end": b, "base": k < 3, "window": cut_window(codes, a, b), "place": plain[-1][0] if k < 3 and plain[-1] else None} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind), pa.array(plain, pa.list_(pa.binary()))], ["doc_id", "found", "plain"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, f"doc_id long, found {FINDING}, plain array<binary>")


@dataclass(frozen=True)
class Network:
    """Embedding and convolution in one table (offset, class, filter), maximum over places, then a logistic unit."""

    table: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    held: tuple[int, float, float] = (0, 0.0, 0.0)
    """Findings held out, the share of them at the threshold or above, and that of the counterexamples held out."""

    def raw(self, windows: np.ndarray) -> np.ndarray:
        return convolve(windows, self.table, self.bias).max(axis=0).clip(0) @ self.weights + self.intercept

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -60, 60)))

    def score(self, windows: np.ndarray) -> np.ndarray:
        return self.calibrated(self.raw(windows))

    def score_candidates(self, found: list[bytes]) -> np.ndarray:
        """The highest score over the windows of each candidate."""
        return self.calibrated(self.raw_candidates(found))

    def raw_candidates(self, found: list[bytes]) -> np.ndarray:
        """The same before the logistic curve, which only rises."""
        best, waiting, size = np.full(len(found), -np.inf), [], 0
        for i, codes in enumerate(found):
            own = slid(codes)
            for a in range(0, len(own), AT_ONCE):
                waiting.append((i, own[a : a + AT_ONCE]))
                size += len(waiting[-1][1])
                if size >= AT_ONCE:
                    self.raise_to(best, waiting)
                    waiting, size = [], 0
        if waiting:
            self.raise_to(best, waiting)
        return best

    def raise_to(self, best: np.ndarray, waiting: list[tuple[int, np.ndarray]]) -> None:
        scores = self.raw(np.concatenate([w for _, w in waiting]))
        np.maximum.at(best, np.repeat([i for i, _ in waiting], [len(w) for _, w in waiting]), scores)


def convolve(windows: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(places, windows, filters), in single precision."""
    table, codes = table.astype(np.float32), np.ascontiguousarray(windows.T).astype(np.intp)
    places = len(codes) - len(table) + 1
    out = np.take(table[0], codes[:places], axis=0)
    for k in range(1, len(table)):
        out += np.take(table[k], codes[k : k + places], axis=0)
    return out + bias.astype(np.float32)


def starting_network(filters: int = 16, width: int = 5, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    return Network(rng.normal(0, 0.2, (width, INPUTS, filters)), np.zeros(filters), rng.normal(0, 0.3, filters), 0.0)


def both_classes(y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Every row in random order; rows of the smaller class come again until the classes are equal."""
    own = [rng.permutation((y == label).nonzero()[0]) for label in (0.0, 1.0)]
    most = max(map(len, own))
    return rng.permutation(np.concatenate([np.resize(rows, most) for rows in own if len(rows)]))


def descend(net: Network, tx: np.ndarray, ty: np.ndarray, epochs: int, rate: float = 0.01, seed: int = 7) -> Network:
    """``net`` after some epochs of Adam on the log loss."""
    rng = np.random.default_rng(seed)
    p = {"table": net.table, "bias": net.bias, "weights": net.weights, "intercept": np.array([net.intercept])}
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    width, _, filters = net.table.shape
    step = 0
    for _ in range(epochs):
        order = both_classes(ty, rng)
        for own in np.array_split(order, max(1, len(order) // 128)):
            bx, by = tx[own], ty[own]
            pre = convolve(bx, p["table"], p["bias"])
            best = pre.argmax(axis=0)
            top = np.take_along_axis(pre, best[None], axis=0)[0]
            pooled = top.clip(0)
            error = (1 / (1 + np.exp(-np.clip(pooled @ p["weights"] + p["intercept"], -60, 60))) - by) / len(own)
            through = (error[:, None] * p["weights"]) * (top > 0)
            grad = {"weights": pooled.T @ error + 1e-4 * p["weights"], "intercept": error.sum(keepdims=True), "bias": through.sum(axis=0), "table": 1e-5 * p["table"]}
            for k in range(width):  # only the place of the maximum passes a gradient
                at = np.take_along_axis(bx, best + k, axis=1).astype(np.intp) * filters + np.arange(filters)
                grad["table"][k] += np.bincount(at.ravel(), through.ravel(), INPUTS * filters).reshape(INPUTS, filters)
            step += 1
            for name, g in grad.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                p[name] = p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return Network(p["table"], p["bias"], p["weights"], float(p["intercept"][0]))


def train_network(x: np.ndarray, y: np.ndarray, recall: float, epochs: int = 12) -> Network:
    """From rows in memory; every fifth is kept for the calibration and the threshold."""
    held = np.arange(len(y)) % 5 == 4
    net = descend(starting_network(), x[~held], y[~held], epochs)
    return with_threshold(net, binned(net.raw(x[held])), y[held], np.ones(held.sum()), recall)


def binned(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(raw / BIN), -MOST_BIN, MOST_BIN).astype(int)


def with_threshold(net: Network, bins: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> Network:
    """Calibrated by Newton's steps on ``n`` held-out rows of each bin of raw scores and label; the threshold is the lower edge
    of the highest bin with ``recall`` there. Without a finding held out it is 0.5."""
    z = bins * BIN
    total, good = n.sum(), n[y > 0].sum()
    features, beta = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (total - good + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -60, 60)))
        hessian = (features * (n * p * (1 - p))[:, None]).T @ features + 1e-2 * np.eye(2)
        move = np.linalg.solve(hessian, features.T @ (n * (target - p)) - 1e-2 * (beta - np.array([1.0, 0.0])))
        beta = beta + move * min(1.0, 1.0 / max(1e-9, np.abs(move).max()))
    tuned = Network(net.table, net.bias, net.weights, net.intercept, max(float(beta[0]), 1e-3), float(beta[1]))
    threshold, edge = 0.5, np.inf
    if good:
        order = np.argsort(z[y > 0], kind="stable")
        below = np.cumsum(n[y > 0][order])
        edge = float(z[y > 0][order][np.searchsorted(below, int((1 - recall) * good), side="right")])
        threshold = float(tuned.calibrated(np.array([edge]))[0])
    above = tuned.calibrated(z) >= threshold
    held = (int(good), *(float(n[above & (y == label)].sum() / max(1, n[y == label].sum())) for label in (1, 0)))
    return replace(tuned, threshold=threshold, held=held)


# Classes inside a candidate: what stands between the name and the value of an assignment.
MARK = re.compile(b"[" + re.escape(bytes([CLASSES + CODES[ord(c)] for c in "=:"])) + b"]")
OPENING = bytes([CLASSES + CODES[ord(c)] for c in " \""])


def bare(found: bytes, place: bytes | None = None) -> bytes:
    """A finding without what stands around it, and of an assignment the value alone; between spaces, or in the place
    of the ordinary word whose window ``place`` is."""
    codes = np.frombuffer(found, np.uint8)
    inside = (codes >= CLASSES).nonzero()[0]
    mark = MARK.search(found)
    first = mark.end() if mark else inside[0]
    while first < inside[-1] and found[first] in OPENING:
        first += 1
    value = codes[first : inside[-1] + 1]
    out = np.zeros(max(WINDOW, 2 * SIDE + len(value)), np.uint8)
    out[SIDE : SIDE + len(value)] = value
    out[SIDE - 1] = out[SIDE + len(value)] = CODES[ord(" ")]
    if place is not None:
        word = np.frombuffer(place, np.uint8)
        after = int((word >= CLASSES).nonzero()[0][-1]) + 1
        out[:SIDE], out[SIDE + len(value) : 2 * SIDE + len(value)] = word[:SIDE], word[after : after + SIDE]
    return out.tobytes()


HEAD_BITS = 16


def lowest_hashes(rows: DataFrame, most: int) -> DataFrame:
    """Those of ``rows`` whose hash of ``w`` is low enough that, by their leading bits, ``most`` distinct hashes or all come
    first. Only hashes are shuffled to find the bound, and the choice after it gets little more than ``most`` windows,
    however many partitions hold candidates."""
    head = lambda hashed: F.shiftright(hashed, 64 - HEAD_BITS)
    counts = rows.select(F.xxhash64("w").alias("h")).distinct().groupBy(head(F.col("h")).alias("head")).count()
    before = F.sum("count").over(Window.orderBy("head")) - F.col("count")  # at most 2^HEAD_BITS rows
    bound = counts.withColumn("before", before).where(F.col("before") < most).agg(F.max("head")).first()[0]
    return rows.where(head(F.xxhash64("w")) <= bound) if bound is not None else rows.limit(0)


def training_rows(candidates: DataFrame) -> DataFrame:
    """(label, codes, fold): every distinct finding of the rules, as it stands and in bare form in the place of a word, and every
    distinct counterexample. Rows of one bare form have one fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, codes, folds = [], [], []
            for label, found, place in zip(*(batch.column(c).to_pylist() for c in ("label", "w", "place")), strict=True):
                forms = [found, bare(found, place)] if label else [found]
                labels += [label] * len(forms)
                codes += forms
                folds += [zlib.crc32(bare(found))] * len(forms)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(codes, pa.binary()), pa.array(folds, pa.int64())], ["label", "codes", "fold"])

    good = candidates.select(F.explode("found").alias("f")).where("f.base").select(F.lit(1).alias("label"), F.col("f.window").alias("w"), F.col("f.place").alias("place"))
    bad = candidates.select(F.lit(0).alias("label"), F.explode("plain").alias("w"), F.lit(None).cast("binary").alias("place"))
    return good.unionByName(bad).groupBy("label", "w").agg(F.min("place").alias("place")).mapInArrow(run, "label int, codes binary, fold long")


def with_held(rows: DataFrame) -> DataFrame | None:
    """Adds ``held``: a fifth of the folds of either label, at least one of them if there are two. None if a label has no row."""
    folds = rows.select("label", "fold").distinct().groupBy("label")
    counts = {r.label: r for r in folds.agg(F.count("*").alias("all"), F.count_if(F.col("fold") % 5 == 4).alias("held"), F.max("fold").alias("last")).collect()}
    if counts.keys() != {0, 1}:
        return None
    held = F.lit(False)
    for label, c in counts.items():
        own = F.col("fold") % 5 == 4 if 0 < c.held < c.all else (F.col("fold") == c.last) & F.lit(c.all > 1)
        held = F.when(F.col("label") == label, own).otherwise(held)
    return rows.withColumn("held", held)


def in_parts(rows: DataFrame, most: int = PART_WINDOWS) -> DataFrame:
    """Adds ``part``, of about ``most`` windows of the larger class. Rows of a rare class go to several parts, so that each has
    some of both."""
    windows = F.sum(1 + F.ceil((F.octet_length("codes") - WINDOW) / STEP))
    sizes = {r.label: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), windows.alias("windows")).collect()}
    parts = -(-max(r.windows for r in sizes.values()) // most)
    copies = {label: min(parts, -(-PART_LEAST * parts // r.n)) for label, r in sizes.items()}
    first = F.xxhash64("codes")
    last = F.when(F.col("label") == 1, copies[1]).otherwise(copies[0]) - 1
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), last))).withColumn("part", F.pmod(F.pmod(first, F.lit(parts)) + F.col("copy"), F.lit(parts))).drop("copy")


def learned_round(rows: DataFrame, net: Network, rate: float) -> Network:
    """The mean of the networks that the parts of ``rows`` learn, each from all its windows and ``net``. Sums are of integers, so
    their order does not matter."""
    shapes = [net.table.shape, net.bias.shape, net.weights.shape, (1,)]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])

    def run(group: pa.Table) -> pa.Table:
        own = sorted(zip(group.column("label").to_pylist(), group.column("codes").to_pylist(), strict=True))
        windows = [slid(codes) for _, codes in own]
        y = np.repeat([float(label) for label, _ in own], [len(w) for w in windows])
        epochs = min(4, max(1, PART_WINDOWS // max((y == 0).sum(), (y == 1).sum())))
        after = descend(net, np.concatenate(windows), y, epochs, rate)
        flat = np.concatenate([after.table.ravel(), after.bias, after.weights, [after.intercept]])
        return pa.table({"at": pa.array(np.arange(len(flat)), pa.int32()), "value": pa.array(np.rint(flat * SCALE).astype(np.int64))})

    spread = rows.select("part", "label", "codes").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")  # few bytes, much work: not to be coalesced
    summed = spread.groupBy("part").applyInArrow(run, "at int, value long").groupBy("at").agg(F.sum("value").alias("total"), F.count("*").alias("n")).orderBy("at")
    with freed_shuffles(rows.sparkSession):
        flat = np.array([r.total / r.n / SCALE for r in summed.collect()])  # as many rows as the network has numbers
    table, bias, weights, intercept = (v.reshape(shape) for v, shape in zip(np.split(flat, ends[:-1]), shapes, strict=True))
    return Network(table, bias, weights, float(intercept[0]))


def held_bins(rows: DataFrame, net: Network) -> np.ndarray:
    """(label, bin, rows) of all rows, by the highest raw score of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(net.raw_candidates(batch.column("codes").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(bins, pa.int32())], ["label", "bin"])

    counts = rows.select("label", "codes").mapInArrow(run, "label int, bin int").groupBy("label", "bin").count()
    return np.array([tuple(r) for r in counts.orderBy("label", "bin").collect()], float).reshape(-1, 3)  # two rows a bin at most


def learn_network(candidates: DataFrame, recall: float) -> Network | None:
    """From all distinct findings of the rules and all distinct counterexamples. Those of one bare form are held out together,
    so none is learned from and measured on."""
    rows = with_held(staged(training_rows(candidates), "training"))
    if rows is None:
        return None
    net, dealt = starting_network(), in_parts(rows.where("not held"))
    for n in range(ROUNDS):
        net = learned_round(dealt, net, 0.01 / 2**n)
    y, bins, n = held_bins(rows.where("held"), net).T
    return with_threshold(net, bins.astype(int), y, n, recall)


def scan_secrets(docs: DataFrame, recall: float = 0.98, least: int = CANDIDATE_LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, findings) of every row; findings: array of (kind, start, end, score) in order, in code points, end
    exclusive. Kinds assign, access and hex are the rules'; model marks candidates that the network adds: of all runs of
    ``least`` key characters or more, each scored with the ``SIDE`` characters on both sides.

    The network learns from all distinct findings and counterexamples. Null and empty texts
    have no findings; null ids and repeated rows stay; extra columns are not read; without any rule finding or
    counterexample nothing is added and scores are null. A very long text is read whole by the one task that holds it; an
    empty table gives no rows.
    """
    candidates = staged(find_candidates(docs, least, id_col, text_col), "candidates")
    net = learn_network(candidates, recall)
    finding = "array<struct<kind:string,start:int,end:int,score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, start, end, base, windows = (batch.column(c).flatten() for c in ("kind", "start", "end", "base", "window"))
            row, keep = pc.list_parent_indices(batch.column("kind")).to_numpy(), base.to_numpy(zero_copy_only=False)
            scores = pa.nulls(len(kind), pa.float64())
            if net is not None:
                score = net.score_candidates(windows.to_pylist())
                scores, keep = pa.array(score), keep | (score >= net.threshold)
            spans = pa.StructArray.from_arrays([kind, start, end, scores], ["kind", "start", "end", "score"]).filter(pa.array(keep))
            ends = np.cumsum(np.bincount(row[keep], minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), spans)], ["doc_id", "findings"])

    return candidates.select("doc_id", "found.kind", "found.start", "found.end", "found.base", "found.window").mapInArrow(run, f"doc_id long, findings {finding}")


def redact(text: str, findings: list[tuple[int, int]]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by ``[SECRET]``."""
    out, at = [], 0
    for start, end in sorted(findings):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, recall: float = 0.98, least: int = CANDIDATE_LEAST, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the findings of ``scan_secrets`` replaced in the text; ``length_col``, if
    given, gets the new number of characters where the text changed. Null texts stay null."""
    net = learn_network(staged(find_candidates(docs, least, id_col, text_col), "candidates"), recall)

    def redacted(texts: list[str | None]) -> Iterator[str | None]:
        both = [all_spans(t or "", least) for t in texts]
        if net is None:
            both = [(base, []) for base, _ in both]
        scores = iter(net.score_candidates([window(t, *run) for t, (_, runs) in zip(texts, both, strict=True) for run in runs]).tolist() if net is not None else [])
        for text, (base, runs) in zip(texts, both, strict=True):
            spans = [(a, b) for a, _, b in base] + [run for run in runs if next(scores) >= net.threshold]
            yield redact(text, spans) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            new = [t for a, b in slices([t or "" for t in texts]) for t in redacted(texts[a:b])]
            columns = batch.columns
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length_col:
                k = batch.schema.get_field_index(length_col)
                lengths = [old if t == n else len(n) for old, t, n in zip(columns[k].to_pylist(), texts, new, strict=True)]
                columns[k] = pa.array(lengths, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
