"""Registration of queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, views: str = "", sql: str | None = None):
    """Adds a function of the tables as a query; `views` are those that the SQL uses."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(tuple(views.split()), sql)
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles to a number of digits at which summation order no longer shows, without negative zeros; all doubles if none are named."""
    chosen = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in chosen})


def gram_sql(source: str, by: list[str], y: str, terms: dict[str, str], weight: str = "1e0", where: str = "", prefix: str = "") -> str:
    """SQL of a weighted least-squares fit: sums of products, then elimination, one step a common table expression -> columns by, n, m_<term>."""
    names, m = list(terms), len(terms)
    keys = ", ".join(by)
    exprs = [*terms.values(), y]
    # The products: a_i_j for the matrix, a_i_m for the right side.
    sums = [f"sum(({weight})*({exprs[i]})*({exprs[j]})) AS a_{i}_{j}" for i in range(m) for j in range(i, m + 1)]
    steps = [f"{prefix}g0 AS (SELECT {keys + ', ' if by else ''}count(*) AS n, {', '.join(sums)} FROM {source} {where} {'GROUP BY ' + keys if by else ''})"]
    full = [f"a_{min(i, j)}_{max(i, j)} AS b_{i}_{j}" if j < m else f"a_{i}_{m} AS b_{i}_{m}" for i in range(m) for j in range(m + 1)]
    steps.append(f"{prefix}e0 AS MATERIALIZED (SELECT {keys + ', ' if by else ''}n, {', '.join(full)} FROM {prefix}g0)")
    for k in range(m):
        columns = []
        for i in range(m):
            for j in range(m + 1):
                columns.append(f"b_{k}_{j}/b_{k}_{k} AS b_{i}_{j}" if i == k else f"b_{i}_{j}-b_{i}_{k}*b_{k}_{j}/b_{k}_{k} AS b_{i}_{j}")
        steps.append(f"{prefix}e{k + 1} AS MATERIALIZED (SELECT {keys + ', ' if by else ''}n, {', '.join(columns)} FROM {prefix}e{k})")
    steps.append(f"{prefix}fitted AS (SELECT {keys + ', ' if by else ''}n, {', '.join(f'b_{i}_{m} AS m_{t}' for i, t in enumerate(names))} FROM {prefix}e{m})")
    return ", ".join(steps)
