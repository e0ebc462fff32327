"""Sharding by a k-d tree with distributed weighted medians.

Documents of equal text are one group and stay together.  The tree splits the
groups along the metadata dimension that is widest in a node, at the weighted
median of the bytes (for an odd number of leaves, at the matching share), until
every leaf holds its share.  A node's cut is found by four rounds of histograms
of 1024 bins over a 40-bit code, the value along the node's dimension first and
a hash of the text behind it, so ties are cut too; all nodes of a level go
through the rounds together, and no node's groups meet in one task.

A dimension of strings counts by the ranks of its distinct values in byte order,
over the whole string.  Ranks are numbered in ranges of values, within each and
behind what the ranges before it hold, so no task sees all values.

Defined results: a null text counts as the empty one; a null value of a
dimension lies below all others; repeated rows are placed with their group and
each get a slot; a group larger than a shard stays whole, which the others make
up for as far as they can; an empty table gives an empty one; other input
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from .cluster import checkpoint, hot_keys, join_skewed, partitions, pick

BITS, ROUND = 20, 10
#: Tables with a row a node are broadcast up to so many shards (and nodes); each row is under 100 bytes.
BROADCAST_NODES = 20_000
#: Parts of a shard within which slots are numbered.
SLOT_PARTS = 1024


def as_number(column: Column) -> Column:
    """A dimension's value, or its rank, as a double; null lies below all others."""
    return F.coalesce(column.cast("double"), F.lit(-1.0))


def value_ranks(rows: DataFrame, column: str) -> DataFrame:
    """(value, rank) of the distinct strings of a column, ranks from 0 in byte order."""
    values = rows.select(F.col(column).alias("value")).where("value is not null").distinct()
    ranged = checkpoint(values.repartitionByRange(partitions(rows.sparkSession), "value").withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))  # one row a range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("range").orderBy("value"))
    return checkpoint(ranged.withColumn("own", own).join(F.broadcast(offsets), "range").select("value", (F.col("own") - 1 + F.col("offset")).alias("rank")))


def _cut(coded: DataFrame, by_node) -> DataFrame:
    """coded: node, leaves, weight, total, code -> for each node the cut: codes up to `last` go left."""
    share = F.col("total") * F.floor(F.col("leaves") / 2) / F.col("leaves")
    state = coded.select("node", share.alias("share")).distinct().withColumn("base", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))
    for shift in range(2 * BITS - ROUND, -1, -ROUND):
        inside = coded.select("node", "weight", "code").join(by_node(state), "node").where(F.shiftright("code", shift + ROUND) == F.col("base"))
        bins = inside.groupBy("node", "share", "base", "before", F.shiftright("code", shift).alias("cell")).agg(F.sum("weight").alias("weight"))
        upto = F.sum("weight").over(Window.partitionBy("node").orderBy("cell")) + F.col("before")
        found = bins.select("node", "share", "cell", "weight", upto.alias("upto")).where("upto >= share")
        state = checkpoint(found.groupBy("node", "share").agg(F.min(F.struct("cell", (F.col("upto") - F.col("weight")).alias("before"), "upto")).alias("first")).select("node", "share", F.col("first.cell").alias("base"), F.col("first.before").alias("before"), F.col("first.upto").alias("upto")))
        if shift:
            state = state.drop("upto")
    return state.select("node", F.when(F.col("upto") - F.col("share") <= F.col("share") - F.col("before"), F.col("base")).otherwise(F.col("base") - 1).alias("last"))


def place_groups(groups: DataFrame, dimensions: Sequence[str], shards: int) -> DataFrame:
    """groups: key, weight, tie (0 to 2**BITS - 1) and numeric dimensions -> key, shard."""
    whole = groups.agg(*[x for d in dimensions for x in (F.min(d).alias(f"lo_{d}"), F.max(d).alias(f"hi_{d}"))]).first()
    spans = {d: (whole[f"hi_{d}"] or 0.0) - (whole[f"lo_{d}"] or 0.0) for d in dimensions}
    groups = groups.withColumn("node", F.lit(0)).withColumn("leaves", F.lit(shards))
    by_node = F.broadcast if shards <= BROADCAST_NODES else lambda df: df
    most = shards
    while most > 1:
        ranges = [x for d in dimensions for x in (F.min(d).alias(f"lo_{d}"), F.max(d).alias(f"hi_{d}"))]
        nodes = groups.where("leaves > 1").groupBy("node").agg(F.sum("weight").alias("total"), *ranges)
        widths = [((F.col(f"hi_{d}") - F.col(f"lo_{d}")) / F.lit(spans[d]) if spans[d] else F.lit(0.0)) for d in dimensions]
        widest = F.array_position(F.array(*widths), F.array_max(F.array(*widths)))
        pick_of = lambda name: F.element_at(F.array(*[F.col(f"{name}_{d}") for d in dimensions]), F.col("axis").cast("int"))
        nodes = nodes.withColumn("axis", widest).select("node", "total", "axis", pick_of("lo").alias("lo"), pick_of("hi").alias("hi"))
        nodes = checkpoint(nodes)
        value = F.element_at(F.array(*dimensions), F.col("axis").cast("int"))
        scaled = F.when(F.col("hi") > F.col("lo"), F.floor((value - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float((1 << BITS) - 1)))).otherwise(0).cast("long")
        coded = groups.where("leaves > 1").join(by_node(nodes), "node").withColumn("code", F.shiftleft(scaled, BITS) + F.col("tie"))
        cut = _cut(coded, by_node)
        left = F.floor(F.col("leaves") / 2).cast("int")
        split = coded.join(by_node(cut), "node")
        goes_left = F.col("code") <= F.col("last")
        split = split.select("key", "weight", "tie", *dimensions, F.when(goes_left, F.col("node")).otherwise(F.col("node") + left).alias("node"), F.when(goes_left, left).otherwise(F.col("leaves") - left).alias("leaves"))
        groups = checkpoint(groups.where("leaves = 1").select(*split.columns).union(split))
        most -= most // 2
    return groups.select("key", F.col("node").alias("shard"))


def shard_documents(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: Sequence[str] = ("source", "lang", "n_chars"),
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row a document: doc_id, size (bytes of the text plus 1), text_crc32, shard, slot (numbered without gaps in the shard).

    Give the number of shards, or target_bytes for a shard.  Dimensions that
    the table lacks are left out; a group's value is the least of its rows.
    """
    dimensions = [d for d in dimensions if d in docs.columns]
    kinds = {d: docs.schema[d].dataType for d in dimensions}
    narrow = pick(docs, doc_id=id_col, text=text_col, **{f"d{i}": d for i, d in enumerate(dimensions)})
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [f"d{i}" for i in range(len(dimensions))] + ["bytes"]
    spelled = [f"d{i}" for i, d in enumerate(dimensions) if isinstance(kinds[d], t.StringType)]
    ranks = {d: value_ranks(narrow, d) for d in spelled}
    narrow = checkpoint(
        narrow.select(
            "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("key"),
            *[(F.col(d) if d in ranks else as_number(F.col(d))).alias(d) for d in names[:-1]], F.octet_length(text).cast("double").alias("bytes"),
        )
    )
    for d, ranked in ranks.items():
        ranked = F.broadcast(ranked) if ranked.count() <= BROADCAST_NODES else ranked
        narrow = narrow.join(ranked, F.col(d) == F.col("value"), "left").withColumn(d, as_number(F.col("rank"))).drop("value", "rank")
    if ranks:
        narrow = checkpoint(narrow)
    groups = narrow.groupBy("key").agg(F.sum("size").alias("weight"), F.count("*").alias("n"), *[F.min(d).alias(d) for d in names])
    groups = checkpoint(groups.withColumn("tie", F.pmod(F.xxhash64("key"), F.lit(1 << BITS)).cast("long")))
    if shards is None:
        if not target_bytes:
            raise ValueError("give shards or target_bytes")
        shards = max(1, -(-(groups.agg(F.sum("weight")).first()[0] or 0) // target_bytes))
    placed = place_groups(groups, names, shards)
    part = F.pmod(F.xxhash64("doc_id", "key"), F.lit(SLOT_PARTS)).cast("int")
    held = checkpoint(join_skewed(narrow, placed, "key", hot_keys(groups, "key", "n")).withColumn("part", part))
    counts = held.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key"))
    numbered = held.withColumn("own", own).join(offsets, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("own") - 1 + F.col("offset")).alias("slot"))
