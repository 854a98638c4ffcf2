"""Registration of queries with their DuckDB counterparts, and the SQL of shared input tables."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: SQL of the ranked lists that ``rankloom.sources.ltr`` makes from the star-schema tables.
LTR = """
edges AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem),
ltr AS (SELECT l_suppkey AS qid, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS doc_id,
  CAST(CASE WHEN mx = mn THEN 3 ELSE least(floor(4.0::DOUBLE * (l_extendedprice - mn) / (mx - mn)), 3) END AS DOUBLE) AS y, l_extendedprice AS price,
  l_quantity AS f0, l_discount AS f1, l_tax AS f2, CAST(l_linenumber AS DOUBLE) AS f3, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS f4 FROM lineitem, edges)
"""
EV = """
ev AS (SELECT user_id AS qid, event_id AS doc_id, CASE event_type WHEN 'purchase' THEN 3.0::DOUBLE WHEN 'signup' THEN 2.0 WHEN 'click' THEN 1.0 ELSE 0.0 END AS y, value AS f0, CAST(hour(ts) AS DOUBLE) AS f1 FROM events)
"""
EMB = """
emb AS (SELECT vec_id % 20 AS qid, vec_id AS doc_id, CAST(label AS DOUBLE) AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
"""


def sql_dice(*columns: str, salt: str) -> str:
    return f"md5(concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)}, '{salt}'))"


def query(name: str, sql: str | None = None):
    """Register a query; without SQL a test compares it with brute force."""

    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
