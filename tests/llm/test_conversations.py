"""Conversation repair against a search over all edits and against a plain run of the whole contract."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

from tidegauge.llm import conversations as cv
from tidegauge.llm import registry

SF = "/root/testdata/sf0.01"
DDL = "conv_id long, turn long, role string, text string"


def all_edits(initials, faults, most_inserts=2):
    """Cheapest cost and its least audit, by trying every edit of every row and every insertion."""
    best = None
    inserts = ["".join(p) for k in range(most_inserts + 1) for p in product("ua", repeat=k)]
    options = [[("D", "", 4)] + ([] if f == cv.VOID else [("K", r, 3 * (f == cv.CUT)), ("R", "u", 3 + 3 * (f == cv.CUT)), ("R", "a", 3 + 3 * (f == cv.CUT))]) for r, f in zip(initials, faults, strict=True)]
    for rows in product(*options):
        for put in product(inserts, repeat=len(rows) + 1):
            roles = put[0] + "".join(r + p for (_, r, _), p in zip(rows, put[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", roles):
                cost = sum(c for *_, c in rows) + 3 * sum(map(len, put))
                audit = "I" * len(put[0]) + "".join(letter + "I" * len(p) for (letter, *_), p in zip(rows, put[1:], strict=True))
                best = min(best or (cost, audit), (cost, audit))
    return best


def by_forward_search(initials, faults):
    """Least (cost, audit) of each state, row by row."""
    most = (10**9, "~")

    def inserted(at):
        at = list(at)
        for _ in range(3):
            for q, q2 in ((0, 2), (1, 2), (3, 2), (2, 3)):
                at[q2] = min(at[q2], (at[q][0] + 3, at[q][1] + "I"))
        return at

    at = inserted([(0, ""), most, most, most])
    for r, f in zip(initials, faults, strict=True):
        new = [(c + 4, a + "D") for c, a in at]
        if f != cv.VOID:
            more = 3 * (f == cv.CUT)
            for q, role, q2 in ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)):
                c, a = at[q]
                if role == r:
                    new[q2] = min(new[q2], (c + more, a + "K"))
                if role != "s":
                    new[q2] = min(new[q2], (c + 3 + more, a + "R"))
        at = inserted(new)
    return min(at[0], at[3])


def contract(rows):
    """The query's rows, in plain Python."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        harm = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        own = convs[conv]
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        own += [] if harm == 0 else [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds = set(), []
        for _, role, text in own:
            ends = re.findall("[^\x20\x09-\x0d]", text)
            kinds.append("blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        initials = [r[1][:1] for r in own]
        cost, audit = by_forward_search(initials, [cv.SOUND if k is None else cv.CUT if k == "truncated" else cv.VOID for k in kinds])
        lines, state, i = [], "", 0
        for letter in audit:
            role, text = ("a" if state == "u" else "u", "") if letter == "I" else (own[i][1], own[i][2])
            i += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if state == "u" else "user"
            state = role[0]
            lines.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_repair_equals_a_search_over_all_edits():
    for n in range(3):
        for initials in product("sua?", repeat=n):
            for faults in product((cv.SOUND, cv.CUT, cv.VOID), repeat=n):
                assert cv.repair("".join(initials).encode(), bytes(faults)) == all_edits(initials, faults), (initials, faults)


def test_repair_equals_forward_search_on_long_conversations():
    r = random.Random(2)
    for n in (3, 5, 9, 20, 60, 300):
        for _ in range(40):
            initials, faults = [r.choice("suuaaa?") for _ in range(n)], [r.choice((0, 0, 0, 1, 2)) for _ in range(n)]
            assert cv.repair("".join(initials).encode(), bytes(faults)) == by_forward_search(initials, faults)


def test_prices_are_dual_feasible_and_every_node_has_a_tight_arc():
    r = random.Random(3)
    lattice = cv.Lattice(bytes(r.choice(b"sua?") for _ in range(50)), bytes(r.choice((0, 0, 1, 2)) for _ in range(50)))
    prices = cv.auction(lattice)
    for i in range(51):
        for q in range(4):
            slack = [cost + prices[4 * row + s] - prices[4 * i + q] for _, cost, row, s in lattice.arcs(i, q)]
            assert min(slack) == 0


def answers(found):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}


def test_query_equals_plain_run(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answers(registry.op12_conversation_repair(spark, SF).collect()) == contract(rows)


def odd_rows():
    r = random.Random(4)
    texts = ["Fine.", "Fine. \n", "no end", " \t", "", "what?", "日本。", "a!b", None, "\x1c"]
    roles = ["user", "assistant", "system", "tool", "", None, "u", "Üser"]
    rows = [(c, r.choice([None, *range(8)]), r.choice(roles), r.choice(texts)) for c in [*range(60), None] for _ in range(r.randint(1, 9))]
    rows += [(99, 1, "user", "Same.")] * 7 + [(98, None, None, None)] * 5
    rows += [(97, t, ("user", "assistant")[t % 2], f"{t} " + "long " * (9000 if t == 8 else 1) + ".") for t in range(700)]
    return rows


def test_odd_rows_and_repaired_texts(spark):
    frame = spark.createDataFrame([(*x, 1, "c", True) for x in odd_rows()], DDL + ", cost int, audit string, gone boolean").repartition(5)
    want = contract(odd_rows())
    assert answers(cv.repair_conversations(frame).collect()) == want
    lines = defaultdict(list)
    for x in sorted(cv.repaired_rows(*cv.damaged_audits(frame)).collect(), key=lambda x: x.place):
        lines[x.conv_id].append(f"{x.role}:{x.text}")
    for conv, found in want.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == found[-1]
    assert cv.repair_conversations(frame.limit(0)).count() == 0


def test_a_conversation_without_rows_after_damage_is_kept(spark):
    conv = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = answers(cv.repair_conversations(spark.createDataFrame([(conv, 0, "user", "Hi.")], DDL)).collect())
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
