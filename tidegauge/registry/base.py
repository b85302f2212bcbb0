"""Pairs each registered query with the SQL that checks it.

``Query.spec`` lists the output columns once for both sides: ``name`` passes through, ``name:n`` is a
BIGINT, ``name:f`` a DOUBLE rounded to six decimals, ``name:d`` a DATE, ``name:t`` text, ``name:b`` BOOLEAN.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CTES: dict[str, str] = {}
REGISTRY: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def _parts(spec: str) -> list[tuple[str, str]]:
    return [(p.split(":") + [""])[:2] for p in spec.split()]


def project(df: DataFrame, spec: str) -> DataFrame:
    kinds = {"n": "bigint", "d": "date", "t": "string", "b": "boolean"}
    out = []
    for name, kind in _parts(spec):
        c = F.col(name)
        if kind == "f":
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind:
            c = c.cast(kinds[kind])
        out.append(c.alias(name))
    return df.select(*out)


def project_sql(source: str, spec: str) -> str:
    kinds = {"n": "BIGINT", "d": "DATE", "t": "VARCHAR", "b": "BOOLEAN"}
    out = []
    for name, kind in _parts(spec):
        if kind == "f":
            out.append(f"round(CAST({name} AS DOUBLE), 6) + 0.0E0 AS {name}")
        elif kind:
            out.append(f"CAST({name} AS {kinds[kind]}) AS {name}")
        else:
            out.append(name)
    return f"SELECT {', '.join(out)} FROM {source}"


def cte(name: str, body: str) -> str:
    if name in CTES:
        raise ValueError(f"duplicate common table {name}")
    CTES[name] = body.strip()
    return name


def with_ctes(select: str) -> str:
    """Prefix ``select`` with the common tables it needs, in definition order."""
    needed: set[str] = set()
    pending = [select]
    while pending:
        words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", pending.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            pending.append(CTES[name])
    names = [n for n in CTES if n in needed]
    if not names:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in names) + f"\n{select}"


def with_ctes_instead(select: str, instead: dict[str, str]) -> str:
    """As ``with_ctes``, with other bodies for some common tables. Those may read tables that were defined later, so each
    table comes after the tables it reads: names that follow FROM, JOIN, or a comma with an alias of their own."""
    bodies = CTES | instead
    names: dict[str, None] = {}
    begun: set[str] = set()

    def visit(text: str) -> None:
        for a, b in re.findall(r"(?:FROM|JOIN)\s+(\w+)|,\s*(\w+)\s+[a-z]\w*\b", text):
            name = a or b
            if name in bodies and name not in begun:
                begun.add(name)
                visit(bodies[name])
                names[name] = None

    visit(select)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS (\n{bodies[n]}\n)" for n in names) + f"\n{select}"


def register(name: str, build: Callable[[SparkSession, str], DataFrame], spec: str, source: str | None, instead: dict[str, str] | None = None) -> None:
    """``source`` is the FROM clause of the check (a common table, optionally with WHERE), or None; ``instead`` as in ``with_ctes_instead``."""
    if name in REGISTRY:
        raise ValueError(f"duplicate query {name}")
    select = None if source is None else project_sql(source, spec)
    sql = None if select is None else with_ctes_instead(select, instead) if instead else with_ctes(select)
    REGISTRY[name] = Query(lambda spark, sf_dir: project(build(spark, sf_dir), spec), sql)


cte("tick", """
SELECT r.r_name AS market, l.l_suppkey AS sk, CAST(date_trunc('week', o.o_orderdate) AS date) AS trade_date,
  10.0E0 + l.l_quantity AS px, l.l_quantity AS qty, CAST(round(l.l_extendedprice * 100) AS bigint) AS cents,
  row(o.o_orderdate, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice) AS ord
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
""")
cte("raw_bars", """
SELECT market, sk, trade_date, arg_min(px, ord) AS open, max(px) AS high, min(px) AS low, arg_max(px, ord) AS close,
  sum(qty) AS volume, CAST(sum(cents) AS double) / 100.0E0 AS amount_rmb
FROM tick GROUP BY market, sk, trade_date
""")
cte("bars", """
SELECT market, CAST(sk AS varchar) AS ts_code, sk, trade_date, open, high, low, close,
  CASE WHEN sk % 13 <> 0 THEN lag(close) OVER (PARTITION BY market, sk ORDER BY trade_date) END AS pre_close,
  volume, amount_rmb, CAST(NULL AS double) AS pct_chg,
  CASE WHEN sk % 23 = 0 THEN '*ST ' || sk ELSE 'S' || sk END AS name,
  CASE WHEN sk % 17 = 0 THEN 1 ELSE 0 END AS is_st,
  min(trade_date) OVER (PARTITION BY market, sk) AS list_date,
  CASE WHEN sk % 10 = 0 THEN DATE '2000-06-30' END AS delist_date,
  CAST(NULL AS int) AS universe_count, CAST(1 AS bigint) AS row_seq
FROM raw_bars
""")
cte("panel_rev", "SELECT * FROM bars UNION ALL SELECT * REPLACE (open AS close, CAST(0 AS bigint) AS row_seq) FROM bars WHERE sk % 4 = 0")
cte("limits", """
SELECT market, ts_code, sk, trade_date, close / pre_close - 1 >= 1.0E0 AS is_limit_up, close / pre_close - 1 <= -0.5E0 AS is_limit_down,
  'price_move' AS limit_method, CASE WHEN sk % 2 = 0 THEN 'pool_a' ELSE '' END AS limit_up_source,
  CASE WHEN sk % 3 = 0 THEN 'pool_b' END AS limit_down_source,
  CASE WHEN close / pre_close - 1 >= 1.0E0 THEN 'REAL_ROWS' END AS limit_up_status,
  CASE WHEN close / pre_close - 1 <= -0.5E0 AND sk % 5 <> 0 THEN 'REAL_ROWS' WHEN close / pre_close - 1 <= -0.5E0 THEN 'APPROX_LIST' END AS limit_down_status,
  sk AS row_seq
FROM bars WHERE pre_close > 0 AND (close / pre_close - 1 >= 1.0E0 OR close / pre_close - 1 <= -0.5E0)
""")
cte("index_bars", """
SELECT market, 'IDX' || (sk % 2) AS benchmark, trade_date, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close
FROM raw_bars GROUP BY market, 'IDX' || (sk % 2), trade_date
""")
