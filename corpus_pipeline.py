"""A corpus pipeline from the operators of stratalake.llm.

STAGES lists the stages in order; each takes (spark, docs, sf_dir) and returns
the rows for the next one, with the columns of documents, but for the last,
which returns token ids.  Defined results are those of the operators: a null or
empty text is rejected by the first stage and passes the others as the empty
text; rows without an id are never merged or cut as copies of each other; of
ties the smallest id counts; repeated rows are kept or go together, but for the
join, of which one row an id stays as often as it is there; empty tables stay
empty; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm import bpe, jaccard, mixing, quality, queries, repeats
from stratalake.llm.cluster import checkpoint


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject, by themselves or with their host, go."""
    return quality.keep_good(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at a similarity of 0.8 or more, directly or over others, one stays."""
    return jaccard.keep_one(docs, size=5, percent=80)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier in the corpus are cut out."""
    return repeats.cut_repeats(docs, length=100)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixing.take_mix(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    coded = bpe.encode_texts(docs, queries.vocabulary_path(queries.BPE_FILE), keep=("source", "lang"), as_array=True)
    return coded.select("doc_id", "source", "lang", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("suffix-array dedup", repeated_spans),
    ("mixing sources to target weights", source_mixing),
    ("BPE encoding and decoding", bpe_round_trip),
]
#: SQL can't express the joins over shingles and the encoding; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is checkpointed before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
