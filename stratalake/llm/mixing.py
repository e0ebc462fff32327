"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

1. Sources share a budget of words by weight; none takes more than `cap` times
   its own words, and what that leaves over is shared again by weight.
2. In a source, the expected copies of a document are proportional to its
   weight, `cap` at most, and chosen so that the expected words are the target.
3. The whole part of the expected copies is certain.  For the rest, an
   inclusion probability p, documents are ranked by their random odds divided
   by their inclusion odds, u/(1-u) / (p/(1-p)), and taken in that order up to
   the size that brings the source nearest to its target.

The cut is found with two histograms of 4096 bins and an exact order only
within one bin of the second, so no source's rows are sorted in one task.

Defined results: a null or empty text has size 0 and takes no words; the null
source is a source of its own, the last one; null ids draw as one id; repeated
rows share their draw and so their fate, as do exact ties; an empty table gives
an empty one; other input columns are ignored.  Draws depend on id and seed
only, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import checkpoint, pick

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096
#: Tables of up to so many rows, of under 100 bytes each, are broadcast after a count.
BROADCAST_ROWS = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_weight(size: Column) -> Column:
    """1 to 4: documents of more words are sampled at higher rates, so that fragments are the first to go."""
    return F.when(size < 10, 1).when(size < 100, 2).when(size < 1000, 3).otherwise(4)


def uniform(id_col: Column, seed: str) -> Column:
    """A draw in (0, 1) from 52 bits of the md5 of seed and id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def source_targets(sources: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """source_key, source, source_size -> with target. One row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array([F.lit(w) for w in weights])
    weighed = sources.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    before = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    limit = F.col("source_size") * cap
    ranked = weighed.select(
        "*",
        F.sum("source_size").over(everywhere).alias("total"),
        F.sum("w").over(everywhere).alias("all_w"),
        F.coalesce(F.sum(limit).over(before), F.lit(0)).alias("full_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    ).withColumn("full", limit * (F.col("all_w") - F.col("w_before")) <= F.col("w") * (F.col("total") - F.col("full_before")))
    full = F.sum(F.when(F.col("full"), limit).otherwise(0)).over(everywhere)
    full_w = F.sum(F.when(F.col("full"), F.col("w")).otherwise(0)).over(everywhere)
    ranked = ranked.select("*", (F.col("total") - full).alias("left"), (F.col("all_w") - full_w).alias("left_w"))
    target = F.when(F.col("full"), limit.cast("double")).otherwise(F.col("w").cast("double") * F.col("left") / F.col("left_w"))
    return ranked.select("source_key", "source_size", target.alias("target"))


def _expected_copies(levels: DataFrame, cap: int) -> DataFrame:
    """(source_key, level, level_size, source_size, target) -> with copies, the expected copies of each document."""
    whole = Window.partitionBy("source_key")
    before = whole.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    w, limit = F.col("level") * F.col("level_size"), F.col("level_size") * cap
    ranked = levels.select(
        "*",
        F.sum(w).over(whole).alias("all_w"),
        F.coalesce(F.sum(limit).over(before), F.lit(0)).alias("full_before"),
        F.coalesce(F.sum(w).over(before), F.lit(0)).alias("w_before"),
    ).withColumn("full", (F.col("all_w") > F.col("w_before")) & (F.lit(cap) * (F.col("all_w") - F.col("w_before")) <= F.col("level") * (F.col("target") - F.col("full_before"))))
    full = F.sum(F.when(F.col("full"), limit).otherwise(0)).over(whole)
    full_w = F.sum(F.when(F.col("full"), w).otherwise(0)).over(whole)
    ranked = ranked.select("*", full.alias("full_size"), (F.col("all_w") - full_w).alias("left_w"))
    rate = F.when(F.col("full"), F.lit(float(cap))).when(F.col("left_w") > 0, F.col("level") * (F.col("target") - F.col("full_size")) / F.col("left_w")).otherwise(0.0)
    return ranked.withColumn("copies", F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), rate)))


def _cut(ranked: DataFrame, key: str) -> DataFrame:
    """(source_key, key, size, start, rest) -> per source the first `key` with which the running size passes `rest`, and the size before it."""
    sums = ranked.groupBy("source_key", key, "start", "rest").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source_key").orderBy(key)) + F.col("start")
    return (
        sums.select("source_key", F.col(key).alias("cut"), "size", "rest", upto.alias("upto"))
        .where("upto > rest")
        .groupBy("source_key")
        .agg(F.min(F.struct("cut", (F.col("upto") - F.col("size")).alias("start"))).alias("first"))
        .select("source_key", "first.*")
    )


class Mix:
    """What a mix decides: the certain copies of each source's documents and how far down their order the rest goes."""

    def __init__(self, narrow: DataFrame, weights: Sequence[int], cap: int):
        """narrow: source_key, source, size, level, u."""
        levels = checkpoint(narrow.groupBy("source_key", "source", "level").agg(F.sum("size").alias("level_size")))
        targets = source_targets(levels.groupBy("source_key", "source").agg(F.sum("level_size").alias("source_size")), weights, cap)
        plan = _expected_copies(levels.drop("source").join(targets, "source_key"), cap).select(
            "source_key", "level", "source_size", "target", "level_size", F.floor("copies").alias("whole"), (F.col("copies") - F.floor("copies")).alias("p")
        )
        certain = F.sum(F.col("whole") * F.col("level_size")).over(Window.partitionBy("source_key"))
        self.plan = _small(checkpoint(plan.withColumn("rest", F.col("target") - certain).drop("level_size")))

        eligible = self._ranked(narrow).where("p > 0").select("source_key", "v", "bin", "fine", "size", "rest")
        self.coarse = _small(checkpoint(_cut(eligible.withColumn("start", F.lit(0).cast("long")), "bin").withColumnRenamed("cut", "cut_bin")))
        within = eligible.join(self.coarse, "source_key").where("bin = cut_bin")
        self.fine = _small(checkpoint(_cut(within, "fine").withColumnRenamed("cut", "cut_fine")))
        last = within.drop("start").join(self.fine, "source_key").where("fine = cut_fine")
        last = last.groupBy("source_key", "v", "start", "rest").agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("source_key").orderBy("v")) + F.col("start")
        last = last.select("source_key", "v", "size", "rest", upto.alias("upto")).where("2 * upto - size <= 2 * rest")
        self.edge = _small(checkpoint(last.groupBy("source_key").agg(F.max("v").alias("last_v"))))

    def _ranked(self, rows: DataFrame) -> DataFrame:
        u, p = F.col("u"), F.col("p")
        odds = (u / (1 - u)) / (p / (1 - p))
        ranked = rows.join(self.plan, ["source_key", "level"]).withColumn("v", F.when(p > 0, odds / (1 + odds)))
        scaled = F.col("v") * BINS
        return ranked.withColumn("bin", F.floor(scaled)).withColumn("fine", F.floor((scaled - F.floor(scaled)) * BINS))

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows (source_key, level, u and more) with source_size, target and copies."""
        chosen = self._ranked(rows)
        for table in (self.coarse.drop("start"), self.fine.drop("start"), self.edge):
            chosen = chosen.join(table, "source_key", "left")
        bin_, fine = F.col("bin"), F.col("fine")
        in_fine = (fine < F.col("cut_fine")) | ((fine == F.col("cut_fine")) & (F.col("v") <= F.col("last_v")))
        taken = F.col("cut_bin").isNull() | (bin_ < F.col("cut_bin")) | ((bin_ == F.col("cut_bin")) & in_fine)
        copies = F.col("whole") + F.coalesce((F.col("p") > 0) & taken, F.lit(False)).cast("long")
        return chosen.withColumn("copies", copies).drop("whole", "p", "rest", "v", "bin", "fine", "cut_bin", "cut_fine", "last_v")


def _narrow(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    source, text = docs[f"`{source_col}`"], docs[f"`{text_col}`"]
    key = F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), source.alias("source"), key.alias("source_key"), words(text).alias("size"), *more)
    return rows.select("*", length_weight(F.col("size")).alias("level"), uniform(F.col("doc_id"), seed).alias("u"))


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix-1",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies (those the mix takes) and taken (their words).

    `weights` go to the sources in code point order, null last, repeating.
    """
    narrow = checkpoint(_narrow(docs, seed, id_col, text_col, source_col))
    mixed = Mix(narrow, weights, cap).apply(narrow)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix-1",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of `docs`, with all their columns, as often as the mix takes them; decided row by row, so no row is shuffled with its text."""
    narrow = checkpoint(_narrow(docs, seed, id_col, text_col, source_col))
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    mixed = Mix(narrow, weights, cap).apply(_narrow(docs, seed, id_col, text_col, source_col, row))
    return mixed.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
