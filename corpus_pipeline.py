"""A corpus pipeline of five operators: rules, line runs, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of its
predecessor.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import linedup, neardup, packing, rules, secrets
from lexmill.llm.common import NO_ID, cut, drop_cut, held, table

#: Similarity of near-duplicates, in per cent.
NEAR = 80


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as its texts have it now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return rules.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are deleted; documents of which nothing stays go."""
    return counted(linedup.strip_repeats(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest id, null before all others.

    Rows are told apart by id and text, as null ids, or one id of several texts, don't tell documents apart.  Rows repeated
    with one id and text, blank ones too, are one document, of which one row stays.
    """
    found = neardup.groups(docs, percent=NEAR)
    kept = found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("th").alias("_th"), "first").filter((F.col("first.id") == F.col("_id")) & (F.col("first.th") == F.col("_th"))).select("_id", "_th").distinct()
    rows = held(docs, _own="doc_id", _text="text").select("_row", F.coalesce("_own", F.lit(NO_ID)).alias("_id"), F.xxhash64(F.coalesce("_text", F.lit(""))).alias("_th"))
    return rows.join(cut(kept).hint("merge"), ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select("_row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and places."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", pack)]

#: SQL can't express a tokenizer, so tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        drop_cut(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
