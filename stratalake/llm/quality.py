"""Quality rules judged per document and per host.

Every document is measured once (`text_measures`), rules turn the measures into
failures, failures are summed by host, each host's failure rates are shrunk with
a beta prior fitted to all hosts (`beta_prior`: the variance between hosts,
without that of sampling), and the host's verdict is joined back to its
documents, where it decides which rules count (`Rules`).

Defined results: a null or empty text has no words and fails `min_words`; a null
host is a host of its own; repeated rows are judged each on its own; an empty
table gives an empty one; other input columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .cluster import arrow, checkpoint, free_name, pick

SYMBOLS = T.table(b"#*$%&|<>")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules read besides the measures that are returned.
INNER = ("n_lines",)
WINDOW = 3


def _repeated(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys with their rows: which occur twice or more in their row, and which of those aren't the first."""
    keys = T.mix(keys + rows.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    ordered = keys[order]
    same[1:-1] = ordered[1:] == ordered[:-1]
    often, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    often[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return often, later


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of the texts in one buffer."""
    space = T.SPACES[data]
    starts, ends = T.runs(~space, offsets)
    bounds = T.row_bounds(starts, offsets)
    n_words = np.diff(bounds)
    point = ~space & ((data & 0xC0) != 0x80)
    points = T.sum_by_row(point, offsets)
    symbols = T.sum_by_row(SYMBOLS[data], offsets)

    line_starts, line_ends = T.runs(data != 10, offsets)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_bounds = T.row_bounds(line_starts, offsets)
    _, later = _repeated(T.word_fingerprints(data, line_starts, line_ends), T.row_of(line_bounds))

    rows = T.row_of(bounds)
    windows = T.chain(T.word_fingerprints(data, starts, ends), WINDOW)
    inside = rows[: len(windows)] == rows[WINDOW - 1 :] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    often, _ = _repeated(windows[at], rows[at])
    covered = np.zeros(len(starts), bool)
    for k in range(WINDOW):
        covered[at[often] + k] = True
    return {
        "n_words": n_words,
        "word_chars": points,
        "n_symbols": symbols,
        "n_dup_lines": T.sum_by_row(later, line_bounds),
        "n_repeat_words": T.sum_by_row(covered, bounds),
        "n_lines": np.diff(line_bounds),
    }


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in T.slices(batches, "text"):
        found = measure(data, offsets)
        keep = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index(name)) for name in keep] + [pa.array(found[name].astype(np.int64)) for name in MEASURES + INNER],
            names=keep + [*MEASURES, *INNER],
        )


def text_measures(docs: DataFrame) -> DataFrame:
    """MEASURES and INNER instead of the column `text`; the other columns stay."""
    keep = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.transform(arrow, _measure_batches, f"{keep}, " + ", ".join(f"{name} long" for name in MEASURES + INNER))


@dataclass(frozen=True)
class Rules:
    """Limits of the rules.

    `short` and `repeats` are the base rules: whatever fails them goes.
    `symbols` and `lines` are signs only, which prose about code or tables can
    show too, so the host tells what they mean.  By the shrunk rate of its
    documents that fail any rule a host is

    * rejected, above `host_limit`: all its documents go;
    * watched, above `watch_limit`: its documents that fail any rule go;
    * trusted otherwise: only what fails the base rules goes.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_percent: int = 100
    max_dup_percent: int = 30
    host_limit: float = 0.5
    watch_limit: float = 0.05

    def failures(self) -> dict[str, Column]:
        words = F.col("n_words")
        return {
            "short": words < self.min_words,
            "repeats": 100 * F.col("n_repeat_words") > self.max_repeat_percent * words,
            "symbols": 100 * F.col("n_symbols") > self.max_symbols_percent * words,
            "lines": 100 * F.col("n_dup_lines") > self.max_dup_percent * F.col("n_lines"),
        }

    def base(self) -> Column:
        found = self.failures()
        return found["short"] | found["repeats"]

    def any(self) -> Column:
        return functools.reduce(Column.__or__, self.failures().values())

    def failed_of(self, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """`base` and `any` of measures in arrays."""
        base = (m["n_words"] < self.min_words) | (100 * m["n_repeat_words"] > self.max_repeat_percent * m["n_words"])
        signs = (100 * m["n_symbols"] > self.max_symbols_percent * m["n_words"]) | (100 * m["n_dup_lines"] > self.max_dup_percent * m["n_lines"])
        return base, base | signs

    def verdict(self) -> Column:
        """Of a row of `host_rates`."""
        return F.when(F.col("rate_any") > self.host_limit, REJECTED).when(F.col("rate_any") > self.watch_limit, WATCHED).otherwise(TRUSTED)


TRUSTED, WATCHED, REJECTED = "trusted", "watched", "rejected"
#: Documents that a prior weighs as much as, at least and at most; the most is what hosts get that differ by chance alone.
PRIOR_WEIGHT = (2.0, 1000.0)


def beta_prior(hosts: int, rows: float, bad: float, squares: float, ratios: float) -> tuple[float, float]:
    """Parameters of the beta distribution of the hosts' rates, by moments, without the noise of sampling.

    rows, bad and squares sum the hosts' documents, failures and squared numbers
    of documents; ratios sums failures squared by documents.  What the rates'
    weighted squares exceed those of equal hosts by is the hosts' own variance.
    """
    if not hosts or not rows:
        return 1.0, 1.0
    mean = min(max(bad / rows, 1e-6), 1 - 1e-6)
    spread = ratios - bad * bad / rows
    room = rows - squares / rows
    own = (spread - (hosts - 1) * mean * (1 - mean)) / room if room > 0 else 0.0
    weight = mean * (1 - mean) / own - 1 if own > 0 else PRIOR_WEIGHT[1]
    weight = min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    return mean * weight, (1 - mean) * weight


def host_key(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def host_rates(measured: DataFrame, rules: Rules) -> DataFrame:
    """One row a host: key, rows, for each rule, and for `any` of them, failures_<rule> and the shrunk rate_<rule>, and the host's verdict."""
    found = rules.failures() | {"any": rules.any()}
    hosts = checkpoint(
        measured.groupBy("host_key").agg(
            F.count("*").alias("n_rows"), *[F.sum(failed.cast("long")).alias(f"failures_{name}") for name, failed in found.items()]
        )
    )
    rows = F.col("n_rows").cast("double")
    sums = hosts.agg(
        F.count("*").alias("hosts"), F.sum(rows).alias("rows"), F.sum(rows * rows).alias("squares"),
        *[x for n in found for x in (F.sum(F.col(f"failures_{n}").cast("double")).alias(f"bad_{n}"), F.sum(F.col(f"failures_{n}").cast("double") ** 2 / rows).alias(f"ratios_{n}"))],
    ).first()
    for n in found:
        a, b = beta_prior(sums["hosts"], sums["rows"] or 0.0, sums[f"bad_{n}"] or 0.0, sums["squares"] or 0.0, sums[f"ratios_{n}"] or 0.0)
        hosts = hosts.withColumn(f"rate_{n}", (F.col(f"failures_{n}") + F.lit(a)) / (F.col("n_rows") + F.lit(a + b)))
    return hosts.withColumn("host_verdict", rules.verdict())


#: Hosts are broadcast up to so many, of under 300 bytes each; beyond that a host's rows are salted.
BROADCAST_HOSTS = 20_000
SALT = 64


def _with_hosts(rows: DataFrame, hosts: DataFrame, key: Column, how: str) -> DataFrame:
    """rows joined with hosts on the host's key, the first column of hosts, which goes; a host's rows are dealt to SALT tasks where hosts are too many to broadcast."""
    own = hosts.columns[0]
    if hosts.count() <= BROADCAST_HOSTS:
        return rows.join(F.broadcast(hosts), key == F.col(own), how).drop(own)
    salt, other = free_name(rows, "salt"), free_name(rows, "host_salt")
    spread = hosts.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn(salt, F.floor(F.rand(11) * SALT).cast("int"))
    return salted.join(spread, (key == F.col(own)) & (F.col(salt) == F.col(other)), how).drop(own, salt, other)


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row a document: id, host, MEASURES, base_failed, kept, host_rate (the shrunk rate of failing documents) and host_verdict."""
    narrow = pick(docs, doc_id=id_col, host=host_col, text=text_col)
    measured = checkpoint(text_measures(narrow).withColumn("host_key", host_key(F.col("host"))))
    hosts = checkpoint(host_rates(measured, rules).select(F.col("host_key").alias("judged_host"), F.col("rate_any").alias("host_rate"), "host_verdict"))
    judged = _with_hosts(measured, hosts, F.col("host_key"), "inner")
    gone = rules.base() | (F.col("host_verdict") == REJECTED) | ((F.col("host_verdict") == WATCHED) & rules.any())
    return judged.select("doc_id", "host", *MEASURES, rules.base().alias("base_failed"), (~gone).alias("kept"), "host_rate", "host_verdict")


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of `docs`, with all their columns, that `judge` keeps; judged row by row, so no row is shuffled with its text.

    A null text fails `short`; a null host is a host of its own; every row is
    judged by itself, repeated or not; an empty table stays empty.
    """
    names = docs.columns
    narrow = pick(docs, host=host_col, text=text_col)
    measured = text_measures(narrow).withColumn("host_key", host_key(F.col("host")))
    verdict, text, own = (free_name(docs, n) for n in ("host_verdict", "judged_text", "judged_host"))
    hosts = checkpoint(host_rates(measured, rules).select(F.col("host_key").alias(own), F.col("host_verdict").alias(verdict)))
    told = _with_hosts(docs.withColumn(text, docs[f"`{text_col}`"]), hosts.where(F.col(verdict) != TRUSTED), host_key(docs[f"`{host_col}`"]), "left")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in T.slices(batches, text):
            base, failed = rules.failed_of(measure(data, offsets))
            told = batch.column(batch.schema.get_field_index(verdict)).to_pylist()
            rejected, watched = np.array([v == REJECTED for v in told], bool), np.array([v == WATCHED for v in told], bool)
            kept = batch.filter(pa.array(~(base | rejected | watched & failed)))
            yield kept.select(list(range(len(names))))

    return told.select(*[told[f"`{n}`"] for n in names], verdict, text).transform(arrow, passing, docs.schema)
