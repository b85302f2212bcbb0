"""Line dedup against brute force, and the runs themselves."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import line_runs, registry
from tidegauge.llm.line_runs import LineRuns, common_lines, drop_common_lines, line_keys

from .test_llm import ODD, SF, odd_rows, texts_by_id


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(texts, min_docs, min_chars=1):
    held = Counter(k for t in texts for k in {key(line) for line in (t or "").split("\n")} if len(k) >= max(min_chars, 1))
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[key(x)] < min_docs]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def some_texts(seed, n):
    r = random.Random(seed)
    parts = ["License MIT", " license mit\r", "ÀB", "àb", "x", "", " \t", "\x1c", " x", "Ünï A", "a" * 30, "\x0bX", "İ"]
    return [None if r.random() < 0.05 else "\n".join(r.choice(parts) if r.random() < 0.8 else f"own {r.randint(0, 400)}" for _ in range(r.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("batches, min_docs, min_chars", [(1, 2, 1), (3, 10, 1), (4, 60, 2), (5, 1, 1)])
def test_lines_equal_brute_force(spark, batches, min_docs, min_chars):
    texts = some_texts(batches, 150)
    docs = spark.createDataFrame([(i % 40 if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = [(r.text, r.n_lines, r.n_dropped) for r in drop_common_lines(docs, min_docs, min_chars, batches).collect()]
    assert Counter(got) == Counter(brute(texts, min_docs, min_chars))


def test_keys_strip_blanks_and_lower_ascii_alone(spark):
    text = "\n".join([" A\x0b", "\x0c\rß É", " A ", "", "\x1cB"])
    assert spark.createDataFrame([(text,)], "text string").select(line_keys(F.col("text"))).first()[0] == [key(x) for x in text.split("\n")]


def test_query_equals_brute_force(spark):
    texts = texts_by_id(spark)
    want = {d: (n, gone, hashlib.sha256(text.encode()).hexdigest()) for d, (text, n, gone) in zip(texts, brute(texts.values(), 10), strict=True)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in registry.op11_line_dedup(spark, SF).collect()} == want


def test_odd_rows(spark):
    odd = spark.createDataFrame(odd_rows(), ODD)
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in drop_common_lines(odd, min_docs=2, batches=2).collect())
    assert got == Counter((row[0], *rest) for row, rest in zip(odd_rows(), brute([r[1] for r in odd_rows()], 2), strict=True))
    assert drop_common_lines(spark.createDataFrame([], ODD), batches=2).count() == 0


def test_runs_are_merged_without_a_shuffle_and_stand_in_few_levels(spark):
    runs = LineRuns(spark, 3)
    seen = Counter()
    for batch in range(6):
        rows = [(h % 50, h % 7) for h in range(batch, 200, batch + 1)]
        seen.update(rows)
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long"))
    assert [name is not None for name in runs.levels] == [False, True, True]
    plan = runs.merged(*runs.runs())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    with line_runs.merging(spark):
        assert "Sort [" not in runs.merged(*runs.runs())._jdf.queryExecution().executedPlan().toString()
    assert {(r.h1, r.h2) for r in runs.common().collect()} == {k for k, n in seen.items() if n >= 3}
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_a_common_line_leaves_later_batches(spark):
    runs = LineRuns(spark, 2)
    runs.add(spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "h1 long, h2 long"))
    assert [tuple(r) for r in runs.fresh(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "h1 long, h2 long")).orderBy("h1").collect()] == [(2, 2, 1), (3, 3, 1)]
    runs.close()


def test_no_lines_at_all(spark):
    rows = spark.createDataFrame([(0, ""), (1, " \n ")], "row_no long, text string")
    assert common_lines(rows, 1, 1, 2).count() == 0
