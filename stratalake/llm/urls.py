"""URL rules by a sort-merge range join; DataFrame functions only.

The host's labels, reversed and each followed by a dot, and then the path make
a canonical key (`net.example./en/`): everything a rule governs on its host has
the rule's key as a prefix, an interval of the sorted keys.  A sweep over the
sorted keys keeps the stack of the rules that are open at each place.  It runs
twice: over host keys, which gives the governing rule hosts of each url
(subdomains included), then, for each of these, over host-and-path keys.

The sweep is cut into key ranges; a rule goes to every range that it meets.
Keys carry the row behind them, so that no key is shared by many rows and a hot
host or url spreads over ranges.

Defined results: a null url, or one without `://`, has empty host and path and
no rule; equal urls are judged once and joined back, so repeated rows each get
the verdict; of rules for the same host and path the greatest verdict string
holds; without rules every url gets the default verdict; an empty table gives
an empty one; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import checkpoint, hot_keys, join_skewed, partitions, pick

#: Keys sampled by hash to place the borders of ranges; they steer the balance only, never a result.
BORDER_KEYS = 1024
#: Rules are broadcast up to so many, of under 300 bytes each; beyond that what a rule governs is salted.
BROADCAST_RULES, SALT = 20_000, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """`m.example.net` as `net.example.m.`."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _borders(points: DataFrame, count: int) -> list[bytes]:
    sampled = points.select("key").orderBy(F.xxhash64("key"), "key").limit(max(BORDER_KEYS, 4 * count)).collect()
    keys = sorted(bytes(r["key"]) for r in sampled)
    return sorted({keys[i * len(keys) // count] for i in range(1, count)}) if keys else []


def _range(key: Column, borders: list[bytes]) -> Column:
    """How many borders are not above the key; looked up in two steps, as in a tree of two levels."""
    if not borders:
        return F.lit(0)
    width = max(1, round(len(borders) ** 0.5))
    groups = [borders[i : i + width] for i in range(0, len(borders), width)]
    not_above = lambda keys: F.size(F.filter(keys, lambda b: b <= key))
    heads = not_above(F.array([F.lit(g[0]) for g in groups]))
    tails = F.array([F.array([F.lit(b) for b in g]) for g in groups])
    return F.when(heads == 0, 0).otherwise((heads - 1) * width + not_above(F.element_at(tails, F.greatest(heads, F.lit(1)))))


def sweep(points: DataFrame, rules: DataFrame, max_depth: int, ranges: int) -> DataFrame:
    """points (key binary, ...) with `stack`, the prefixes among rules (prefix binary) open at the key, outermost first.

    Rules are distinct; max_depth bounds how many of them nest.
    """
    borders = _borders(points, ranges)
    payload = [c for c in points.columns if c != "key"]
    after = F.concat(F.col("prefix"), F.lit(b"\xff"))  # no UTF-8 text has this byte: the end of the interval
    spread = rules.select("prefix", F.explode(F.sequence(_range(F.col("prefix"), borders), _range(after, borders))).alias("part"))
    empty = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in payload]
    # At one key, what ends comes first, then what begins, then the points.
    opens = spread.select("part", F.col("prefix").alias("key"), F.lit(1).alias("kind"), "prefix", *empty)
    closes = spread.select("part", F.concat(F.col("prefix"), F.lit(b"\xff")).alias("key"), F.lit(0).alias("kind"), "prefix", *empty)
    held = points.select(_range(F.col("key"), borders).alias("part"), "key", F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("prefix"), *payload)
    events = opens.unionAll(closes).unionAll(held)
    order = Window.partitionBy("part").orderBy("key", "kind", F.length("prefix")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("kind") == 1, 1).when(F.col("kind") == 0, -1).otherwise(0)
    # Only opens and points are looked at, so a depth is that of the rule just opened.
    swept = events.withColumn("depth", F.sum(step).over(order))
    slots = [F.last(F.when((F.col("kind") == 1) & (F.col("depth") == d), F.col("prefix")), ignorenulls=True).over(order) for d in range(1, max_depth + 1)]
    stack = F.filter(F.array(*slots), lambda p, i: i < F.col("depth")) if slots else F.array().cast("array<binary>")
    return swept.withColumn("stack", F.slice(F.array(*slots), 1, F.col("depth")) if slots else stack).where("kind = 2").select("key", "stack", *payload)


def _depth(prefixes: DataFrame) -> int:
    """Bound for how deep prefixes nest: the most rules on one chain is at most the number of distinct prefix lengths."""
    return prefixes.select(F.length("prefix")).distinct().count()


def _of_rules(found: DataFrame, rules: DataFrame, on: list[str]) -> DataFrame:
    """found with its rules beside it; one rule may govern a large part of all rows."""
    if rules.count() <= BROADCAST_RULES:
        return found.join(F.broadcast(rules), on)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALT)).cast("int"))
    return salted.join(rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [*on, "salt"]).drop("salt")


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a page: page_id, host, path, rule (host and path of the one that holds, or null) and verdict.

    rules: (host, path, verdict).  A rule holds for its host and all subdomains
    where the url's path starts with the rule's; of those the one with the
    longest host and path together holds, and among equally long ones that with
    the longer host.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null")
    rules = checkpoint(rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("host_key", reversed_host(F.col("host"))))
    ranges = partitions(spark)

    seen = pick(pages, page_id=id_col, url=url_col).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    place = F.struct("host", "path").alias("place")
    counted = checkpoint(seen.where("host <> ''").groupBy(place).agg(F.count("*").alias("n")))
    distinct = counted.select("place.*")

    hosts = rules.select(F.col("host_key").cast("binary").alias("prefix")).distinct()
    by_host = distinct.select(F.concat(reversed_host(F.col("host")), "path").cast("binary").alias("key"), "host", "path")
    governed = sweep(by_host, hosts, _depth(hosts), ranges).select("host", "path", F.explode("stack").alias("host_key"))

    paths = rules.select(F.concat("host_key", "path").cast("binary").alias("prefix")).distinct()
    by_path = checkpoint(governed.select(F.concat(F.col("host_key"), F.col("path").cast("binary"), F.lit(b"\x00"), F.col("host").cast("binary")).alias("key"), "host", "path", "host_key"))
    found = sweep(by_path, paths, _depth(paths), ranges).select("host", "path", "host_key", F.explode("stack").alias("prefix"))
    # What is open at a key may belong to a rule host above or to a longer host; only rules of this host count.
    by_prefix = rules.select(F.col("host_key").cast("binary").alias("host_key"), F.concat("host_key", "path").cast("binary").alias("prefix"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    found = _of_rules(found, by_prefix, ["host_key", "prefix"]).where(F.startswith("path", "rule_path"))
    best = found.groupBy("host", "path").agg(F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("best"))
    judged = checkpoint(best.select(place, "best.rule", "best.verdict"))
    told = join_skewed(seen.where("host <> ''").withColumn("place", place), judged, "place", hot_keys(counted, "place", "n"), "left")
    hostless = seen.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    columns = ["page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")]
    return told.select(*columns).unionAll(hostless.select(*columns))
