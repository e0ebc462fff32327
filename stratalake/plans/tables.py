"""Tables of the registered queries: pixels, pairs and maps derived from the star-schema test data.

One text a view serves Spark and DuckDB; `{name}` stands for a base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

YM = "year({0})*100+month({0})"
DEC = "(year({0})+(month({0})-1)/12e0)"

VIEWS: dict[str, str] = {
    # Pixel time series with sentinels for missing values.
    "obs": """SELECT l_partkey AS pixel, CAST(l_shipdate AS DATE) AS d, year(l_shipdate)*10000+month(l_shipdate)*100+day(l_shipdate) AS idate,
        year(l_shipdate)+dayofyear(l_shipdate)/365.1e0 AS dec, CASE WHEN l_orderkey % 97 = 0 THEN 9990e0 ELSE l_extendedprice/997e0 END AS disp, l_quantity AS sigma
        FROM {lineitem}""",
    # One value a pixel and month.
    "cube": f"""SELECT l_partkey AS pixel, CAST(floor(l_partkey/40) AS BIGINT) AS line, l_partkey % 40 AS col, {YM.format('l_shipdate')} AS date, min({DEC.format('l_shipdate')}) AS dec,
        avg(l_extendedprice)/997e0 AS disp, avg(l_quantity)/9.97e0 + 1e-1 AS sigma FROM {{lineitem}} WHERE l_orderkey % 97 <> 0
        GROUP BY l_partkey, {YM.format('l_shipdate')}""",
    "grid": """SELECT l_suppkey AS line, l_partkey % 100 AS col, avg(l_extendedprice)/997e0 AS value, avg(l_quantity) AS rms, count(*) AS n FROM {lineitem}
        GROUP BY l_suppkey, l_partkey % 100""",
    "grid2": """SELECT l_suppkey AS line, l_partkey % 100 AS col, avg(l_discount)*997e-2 AS value FROM {lineitem} WHERE l_orderkey % 5 <> 0 GROUP BY l_suppkey, l_partkey % 100""",
    "dem": "SELECT p_partkey AS pixel, p_retailprice AS elev, p_size AS slope FROM {part}",
    "dem_grid": "SELECT CAST(floor(p_partkey/40) AS BIGINT) AS line, p_partkey % 40 AS col, p_retailprice + p_size*p_size AS value, p_size AS slope FROM {part}",
    "nodes": f"""SELECT {YM.format('l_shipdate')} AS date, min({DEC.format('l_shipdate')}) AS dec, min({DEC.format('l_shipdate')}) - 1995e0 AS bt,
        avg(l_quantity)*99.7e0 - 2500e0 AS bperp FROM {{lineitem}} GROUP BY {YM.format('l_shipdate')}""",
    "pairs": f"""SELECT {YM.format('o_orderdate')} AS date1, {YM.format('l_shipdate')} AS date2, avg(l_extendedprice)/997e0 AS phase, avg(l_discount)*0.9973137e0+1e-2 AS rms, count(*) AS n
        FROM {{orders}} JOIN {{lineitem}} ON o_orderkey=l_orderkey WHERE {YM.format('l_shipdate')} > {YM.format('o_orderdate')} GROUP BY 1,2""",
    # Cells of a few pairs, some of them empty.
    "px": f"""SELECT year(o_orderdate)*100+month(o_orderdate) AS date1, {YM.format('l_shipdate')} AS date2, l_suppkey % 20 AS line, l_partkey % 20 AS col,
        CASE WHEN min(l_orderkey) % 11 = 0 THEN 0e0 ELSE avg(l_extendedprice)/9973e0 - 3e0 END AS phase, avg(l_quantity) AS amp, avg(l_discount)*7.97e0 + 1e-1 AS coh,
        avg(p_retailprice) AS elev, avg(p_size) AS slope, avg(l_tax) AS model
        FROM {{orders}} JOIN {{lineitem}} ON o_orderkey=l_orderkey JOIN {{part}} ON l_partkey=p_partkey
        WHERE {YM.format('l_shipdate')} > {YM.format('o_orderdate')} GROUP BY 1,2,3,4""",
    "dates_px": """SELECT l_returnflag AS frame, year(l_shipdate) AS date, l_suppkey AS line, l_partkey % 50 AS col, avg(l_extendedprice)/997e0 AS value, avg(l_tax)*997e-2 AS model,
        avg(p_retailprice)/997e0 AS elev, avg(l_quantity) AS rms FROM {lineitem} JOIN {part} ON l_partkey=p_partkey GROUP BY 1,2,3,4""",
    "stations": """SELECT s_suppkey AS station, s_suppkey AS line, CAST(s_nationkey AS BIGINT) AS col, s_acctbal/997e0 AS ve, s_nationkey*1e-1 AS vn, (s_suppkey % 7)*1e-1 AS vu,
        1e-1+(s_suppkey % 3)*1e-1 AS se, 2e-1 AS sn, 3e-1 AS su FROM {supplier}""",
    "frames": """SELECT l_partkey AS pixel, l_returnflag AS frame, avg(l_extendedprice)/997e0 AS los, avg(l_quantity) AS sigma,
        CASE l_returnflag WHEN 'A' THEN 34e0 WHEN 'N' THEN 39e0 ELSE 44e0 END AS look, CASE l_returnflag WHEN 'A' THEN -168e0 WHEN 'N' THEN -12e0 ELSE -10e0 END AS heading
        FROM {lineitem} GROUP BY l_partkey, l_returnflag""",
    "series": """SELECT user_id AS pixel, CAST(ts AS DATE) AS d, avg(value) AS v, count(*) AS n FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "points": """SELECT c_custkey AS point, (c_custkey % 50)*1e-1 + c_acctbal/1e6 AS lon, (c_custkey % 30)*1e-1 + c_nationkey/1e3 AS lat, c_acctbal/997e0 AS value,
        (c_nationkey+1)/3e1 AS coh FROM {customer}""",
    "coefs": """SELECT l_partkey AS pixel, avg(l_extendedprice)/997e0 AS reference, avg(l_discount)*997e-2 AS linear, avg(l_tax)*997e-2 AS seasonal_sin, avg(l_quantity)/9.97e0 AS seasonal_cos,
        stddev_pop(l_discount)*1e1+1e-2 AS s_sin, stddev_pop(l_tax)*1e1+1e-2 AS s_cos FROM {lineitem} GROUP BY l_partkey""",
    "vectors": "SELECT vec_id AS pixel, embedding AS disp FROM {embeddings}",
}


class Tables:
    """The views over one directory, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        text = VIEWS[name]
        used = {b: self.base(b) for b in BASE if "{" + b + "}" in text}
        return self.spark.sql(text, **used)


def oracle(views: tuple[str, ...], sql: str) -> str:
    """DuckDB text: the views as common table expressions, then the query."""
    named = {b: b for b in BASE}
    sql = re.sub(r"(?<=[\s,(])round\(", "0e0+round(", sql)  # no negative zeros
    parts = [f"{v} AS ({VIEWS[v].format(**named)})" for v in views]
    if sql.lstrip().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join([*parts, sql.lstrip()[15:]])}"
    return (f"WITH {', '.join(parts)} {sql}" if not sql.lstrip().upper().startswith("WITH ") else f"WITH {', '.join(parts)}, {sql.lstrip()[5:]}") if parts else sql
