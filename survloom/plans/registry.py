"""The registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from survloom import settings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The survival frame in SQL, for the oracles.
FRAME = """
ship AS (
  SELECT o_orderkey AS k,
         min(CASE WHEN CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE)
                  THEN CAST(l_shipdate AS DATE) END) AS first_ship
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
frame AS (
  SELECT o_orderkey AS ID,
         CASE WHEN first_ship IS NULL THEN 0 ELSE 1 END AS efs,
         CAST(date_diff('day', CAST(o_orderdate AS DATE),
                        coalesce(first_ship, DATE '2001-12-31')) AS DOUBLE) AS efs_time,
         c_mktsegment AS stratum, o_custkey AS customer, o_orderpriority AS priority,
         o_orderstatus AS status, o_totalprice AS price, c_acctbal AS balance,
         round(o_totalprice / 1000, 0) AS pred,
         CASE WHEN o_orderkey % 10 = 9 THEN 'TEST' ELSE 'TRAIN' END AS dataset
  FROM orders LEFT JOIN ship ON k = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle, which may use the ``frame`` of FRAME."""

    def add(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # Frames kept by the query before are of no use to this one.
            settings.release()
            return build(spark, folder)

        run.__name__ = build.__name__
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql if sql.lstrip().startswith("WITH") else f"WITH {FRAME}\n{sql}"
        return build

    return add


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison with another engine; -0.0 becomes 0.0."""
    return F.round(F.col(value) if isinstance(value, str) else value, digits) + F.lit(0.0)


def sql_rounded(value: str, digits: int = 6) -> str:
    return f"(round({value}, {digits}) + 0.0)"


def sql_folds(source: str, n_splits: int, seed: int | str, *, extra: str = "", part: str = "") -> str:
    """SELECT of ``source`` with its fold number, by shuffled position and fold sizes."""
    window = f"PARTITION BY {part}" if part else ""
    order = f"ORDER BY md5(concat(ID, ':', {seed})), ID"
    return f"""
SELECT * EXCLUDE (place, total),
       CAST(CASE WHEN place < (total // {n_splits} + 1) * (total % {n_splits})
                 THEN place // (total // {n_splits} + 1)
                 ELSE (total % {n_splits})
                      + (place - (total // {n_splits} + 1) * (total % {n_splits}))
                        // greatest(total // {n_splits}, 1) END AS INTEGER) AS fold
FROM (SELECT *, row_number() OVER ({window} {order}) - 1 AS place,
             count(*) OVER ({window}) AS total {extra}
      FROM {source})"""


def sql_rank(value: str, part: str = "") -> str:
    """Average rank of ``value``; null values must be filtered before."""
    by = f"PARTITION BY {part}" if part else ""
    peers = f"PARTITION BY {part + ',' if part else ''} {value}"
    return f"(rank() OVER ({by} ORDER BY {value}) + (count(*) OVER ({peers}) - 1) / 2.0)"
