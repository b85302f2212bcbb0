"""Conversation repair as shortest paths, found by an auction.

A conversation of n rows is a lattice: node (i, q) stands before row i with q for the roles given so far (nothing, s, u
or a last). Keeping, re-roling and deleting row i lead to i + 1, inserting stays at i, and the accepted states after the
last row lead to the sink. The auction holds a price for each node and a path: the path's end extends along the arc that
its price affords, and where none is affordable its price rises to the cheapest one and the path contracts by a node.
Origins are taken from the last row back, with prices that start at the least of the row after, and a path ends at the
first node whose own path is known; so an origin costs a bounded number of steps and a conversation of n rows O(n). Prices then are the distances to the sink; the arcs that meet
their price exactly are tight, and any walk along tight arcs is a cheapest repair. The walk that takes the least letter
at each node spells the ASCII-least audit.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_CHARS, staged
from .line_runs import BLANKS

# The published edit costs and the accepted order of roles.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
DONE = (START, ASSISTANT)
PLAIN_ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
SOUND, CUT, VOID = range(3)
"""A row's fault as the lattice sees it: none, truncated, or one that must be deleted."""
SALTS = 16


@dataclass
class Lattice:
    """Rows as one byte each: the fault, and the role's initial where it is one of s, u, a."""

    initials: bytes
    faults: bytes

    def __len__(self) -> int:
        return len(self.initials)

    def arcs(self, i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        """(letter, cost, row, state) of every arc out of (i, q), by letter; the sink is (n + 1, 0). Each letter has one."""
        if i == len(self):
            if q in DONE:
                yield "", 0, i + 1, 0
        else:
            yield "D", DELETE, i + 1, q
        for role in (USER, ASSISTANT):
            if role in NEXT[q].values():
                yield "I", INSERT, i, role
        if i < len(self) and self.faults[i] != VOID:
            extra = TRUNCATED if self.faults[i] == CUT else 0
            kept = NEXT[q].get(chr(self.initials[i]))
            if kept is not None:
                yield "K", KEEP + extra, i + 1, kept
            for role in (USER, ASSISTANT):
                if role in NEXT[q].values():
                    yield "R", REROLE + extra, i + 1, role


def auction(lattice: Lattice) -> array:
    """Converged prices: entry 4 i + q is the distance of node (i, q) to the sink."""
    n = len(lattice)
    prices = array("q", bytes(8 * 4 * (n + 2)))
    settled = bytearray(4 * (n + 2))
    settled[4 * (n + 1)] = 1
    for i in range(n, -1, -1):
        floor = min(prices[4 * i + 4 : 4 * i + 8]) if i < n else 0
        for q in range(4):
            prices[4 * i + q] = floor  # arcs cost nothing or more, so no price is above what an arc affords
        for q in range(4):
            path = [(i, q)]
            while not settled[4 * path[-1][0] + path[-1][1]]:
                row, state = path[-1]
                cost, onto = min((cost + prices[4 * r + s], (r, s)) for _, cost, r, s in lattice.arcs(row, state))
                if prices[4 * row + state] < cost:
                    prices[4 * row + state] = cost  # contract: the end is worth more than its price
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(onto)
            for row, state in path:
                settled[4 * row + state] = 1
    return prices


def least_trace(lattice: Lattice, prices: array) -> str:
    """Letters of the ASCII-least walk along tight arcs from the first node to the sink."""
    i, q, letters = 0, START, []
    while i <= len(lattice):
        letter, i, q = next((letter, r, s) for letter, cost, r, s in lattice.arcs(i, q) if prices[4 * i + q] == cost + prices[4 * r + s])
        letters.append(letter)
    return "".join(letters)


def repair(initials: bytes, faults: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest repair, of equal ones the ASCII-least."""
    lattice = Lattice(initials, faults)
    prices = auction(lattice)
    return prices[START], least_trace(lattice, prices)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows after damage by crc32 of ``conv_id:turn`` modulo 20. A dropped row stays as
    ``gone``, so that its conversation does; a null role, text or part of the checksum counts as one space."""
    word = lambda name: F.coalesce(rows[name].cast("string"), F.lit(" "))
    harm = (F.crc32(F.concat_ws(":", word("conv_id"), word("turn")).cast("binary")) % 20).alias("harm")
    given = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), harm)
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    damage = given.withColumn("copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return damage.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("harm") == 0).alias("gone"))


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at``, which ascends by turn (nulls first), role and text in each conversation; written to the shared
    folder. Ranges of (conversation, turn, role, start of the text) are sorted apart, so a long conversation is dealt over
    many tasks; equal rows are alike, whatever their order."""
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    start = rows.withColumn("text_start", F.left("text", F.lit(32)))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = start.repartitionByRange(tasks, *keys, "text_start").sortWithinPartitions(*keys, "text_start", "text")
    return staged(sorted_rows.drop("text_start").withColumn("at", F.monotonically_increasing_id()), "conversation-rows")


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, at, turn, initial, gone, fault) of rows in order, without their texts. fault is what holds first of blank,
    duplicate and truncated, or null. The first row of each conversation, role and text comes from an aggregation
    that merges copies before the shuffle; it is joined back with salted keys."""
    bare = F.btrim("text", F.lit(BLANKS))
    key = [F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit("row"), "role", "text").alias("k2")]
    narrow = rows.select(
        "conv_id", "at", "turn", "gone", F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("?").alias("initial"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open_end"), *key, F.pmod("at", F.lit(SALTS)).cast("int").alias("salt"),
    )
    first = narrow.where(~F.col("gone") & ~F.col("blank")).groupBy("conv_id", "k1", "k2").agg(F.min("at").alias("first"), F.count("*").alias("held")).where("held > 1")
    spread = first.select(F.col("conv_id").alias("own"), F.col("k1").alias("o1"), F.col("k2").alias("o2"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("own_salt"))
    joined = narrow.join(spread, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")) & (F.col("salt") == F.col("own_salt")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("open_end"), "truncated")
    return joined.select("conv_id", "at", "turn", "initial", "gone", fault.alias("fault"))


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "conv_id long, place long, role string, text string"


@lru_cache(1 << 16)
def known_repair(initials: bytes, faults: bytes) -> tuple[int, str]:
    """``repair``, remembered: short conversations repeat few patterns."""
    return repair(initials, faults)


def audited(rows: DataFrame) -> DataFrame:
    """A row of ``AUDITS`` for each conversation. A conversation streams through its task and is kept there as two bytes a row."""

    def record(conv: int | None, turns: list[int], initials: bytes, faults: list[str | None]) -> list:
        kinds = Counter(faults)
        marks = bytes(SOUND if f is None else CUT if f == "truncated" else VOID for f in faults)
        cost, audit = (known_repair if len(initials) < 64 else repair)(initials, marks)
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
        illegal = sum(initials[i : i + 2].decode() not in LEGAL_PAIRS for i in range(len(initials) - 1))
        return [conv, gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
        current, open_conv, out = None, False, []
        turns, initials, faults = [0, 0, 0], bytearray(), []
        for batch in batches:
            for conv, turn, initial, gone, fault in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "initial", "gone", "fault")), strict=True):
                if not open_conv or conv != current:
                    if open_conv:
                        out.append(record(current, turns, bytes(initials), faults))
                    current, open_conv = conv, True
                    turns, initials, faults = [0, 0, 0], bytearray(), []
                if gone:
                    continue
                initials += initial.encode()
                faults.append(fault)
                if turn is not None:  # least, greatest, number of different ones; turns ascend
                    turns = [turns[0], turn, turns[2] + (turn != turns[1])] if turns[2] else [turn, turn, 1]
            if len(out) >= 1 << 12:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if open_conv:
            out.append(record(current, turns, bytes(initials), faults))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, AUDITS)


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, str, str]]:
    """Repaired rows of audits and rows sorted by conversation and place, the audit first: its record with no role opens a
    conversation, then comes a (None, role, text) for each repaired row."""
    letters, state = iter(()), START

    def inserted() -> Iterator[tuple[None, str, str]]:
        """Rows put in before the next letter that is none of ``I``; keeps that letter."""
        nonlocal letters, state
        for letter in letters:
            if letter != "I":
                letters = chain(letter, letters)
                return
            state = ASSISTANT if state == USER else USER
            yield None, PLAIN_ROLES[state], ""

    for batch in batches:
        for audit, role, text, *record in zip(*(batch.column(n).to_pylist() for n in ("audit", "role", "text", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), strict=True):
            if audit is not None:
                yield from inserted()
                yield (*record, audit), "", ""
                letters, state = iter(audit), START
                continue
            yield from inserted()
            letter = next(letters)
            if letter == "K":
                state = NEXT[state][role[0]]
                yield None, role, text
            elif letter == "R":
                state = ASSISTANT if state == USER else USER
                yield None, PLAIN_ROLES[state], text
    yield from inserted()


def beside_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows, in one task and in order."""
    texts = rows.where(~F.col("gone")).select("conv_id", "at", "role", "text")
    return texts.unionByName(audits.withColumn("at", F.lit(-1).cast("long")), allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "at")


def damaged_audits(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Damaged rows in order, and the audits of their conversations."""
    rows = in_order(damaged(conversations))
    return rows, staged(audited(with_faults(rows)), "conversation-audits")


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): every row after repair, numbered from 0 in its conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, out, size = None, 0, [], 0
        for record, role, text in edited(batches):
            if record is not None:
                conv, place = record[0], 0
                continue
            out.append((conv, place, role, text))
            place, size = place + 1, size + len(text)
            if len(out) >= 1 << 12 or size >= SLICE_CHARS:
                yield rows_of(out)
                out, size = [], 0
        if out:
            yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        conv, place, role, text = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(place, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string())], ["conv_id", "place", "role", "text"])

    return beside_audits(rows, audits).mapInArrow(run, REPAIRED)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """A row of ``AUDITS`` for every conversation given, and repaired_sha256 of its repaired ``role:text`` lines.

    Null conversation ids are one conversation, null turns come first and ties go by role and text; repeated rows stand
    side by side, so all but one are duplicates. A conversation without rows after damage, or whose rows all go, has the
    hash of nothing. Very long texts and conversations stream: a task holds a batch of rows, and two bytes for each row of
    the conversation at hand while it is solved. A conversation's rows end in one task, since its hash is sequential.
    Extra columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split(" ")[0] for field in AUDITS.split(", ")]
        current, digest, lines, out = None, hashlib.sha256(), 0, []

        def closed() -> list:
            done = [(*current, digest.hexdigest())] if current is not None else []
            return done

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:7]), pa.array(columns[7], pa.string()), pa.array(columns[8], pa.string())], [*names, "repaired_sha256"])

        for record, role, text in edited(batches):
            if record is None:
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
                continue
            out += closed()
            current, digest, lines = record, hashlib.sha256(), 0
            if len(out) >= 1 << 12:
                yield rows_of(out)
                out = []
        if out := out + closed():
            yield rows_of(out)

    return beside_audits(*damaged_audits(conversations)).mapInArrow(run, AUDITS + ", repaired_sha256 string")
