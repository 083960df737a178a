"""Prefix suggestions: frequencies of segments and the best of each prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.model import SuggestConfig

MOST_BYTES = 45


def segments(docs: DataFrame, text_col: str, ordinal: str) -> DataFrame:
    """segment, seen: each distinct segment of each value, with (document, place in the value)."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(ordinal).cast("long").alias("doc"), F.posexplode(F.array_distinct(T.terms(F.col(text_col)))).alias("place", "segment"))
    return rows.select("segment", F.struct("doc", "place").alias("seen"))


def frequencies(found: DataFrame) -> DataFrame:
    """segment, freq, last_seen; long segments are left out."""
    return found.filter(F.octet_length("segment") <= MOST_BYTES).groupBy("segment").agg(F.count(F.lit(1)).alias("freq"), F.max("seen").alias("last_seen"))


def merge_frequencies(*parts: DataFrame) -> DataFrame:
    """Frequencies of several parts of a collection together."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("segment").agg(F.sum("freq").alias("freq"), F.max("last_seen").alias("last_seen"))


def best(freq: DataFrame, config: SuggestConfig = SuggestConfig()) -> DataFrame:
    """prefix, rank, segment, freq: the most frequent segments of each prefix.

    Ties: of segments seen once the latest comes first, of others the one that reached its frequency first.
    """
    once = F.col("freq") == 1
    order = W.partitionBy("prefix").orderBy(F.desc("freq"), F.when(once, F.col("last_seen")).desc_nulls_last(), F.col("last_seen"), "segment")
    rows = freq.withColumn("prefix", F.explode(T.edge_ngrams(F.col("segment"), config.min_gram, config.max_gram)))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.entries).select("prefix", "rank", "segment", "freq")


def lookup(top: DataFrame, prefix: str) -> DataFrame:
    """Suggestions for a prefix, best first."""
    return top.filter(F.col("prefix") == prefix).orderBy("rank").select("rank", "segment", "freq")
