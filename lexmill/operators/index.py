"""Inverted index as DataFrames: postings, term statistics, phonetic codes, dictionary scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import cut
from lexmill.functions import text as T

POSTING = ["field", "term", "seq_id", "elem", "tf", "doc_len", "offsets"]


def postings(docs: DataFrame, id_col: str, text_col: str, field: str | None = None) -> DataFrame:
    """All postings of a string column: field, term, seq_id, elem, tf, doc_len, offsets (sorted byte positions)."""
    found = cut.postings(docs, id_col, text_col)
    return found.select(F.lit(field or text_col).alias("field"), "term", F.col(id_col).alias("seq_id"), F.lit(0).alias("elem"), "tf", "doc_len", "offsets")


def nested_postings(docs: DataFrame, id_col: str, elements: Column, field: str) -> DataFrame:
    """Postings of an array of strings: one posting a term and element, offsets from 0 in each element."""
    rows = docs.select(F.col(id_col).alias("_id"), F.posexplode(elements).alias("elem", "_text")).withColumn("_key", F.struct("_id", "elem"))
    found = cut.postings(rows, "_key", "_text")
    return found.select(F.lit(field).alias("field"), "term", F.col("_key._id").alias("seq_id"), F.col("_key.elem").alias("elem"), "tf", "doc_len", "offsets")


def first_elements(found: DataFrame) -> DataFrame:
    """One posting a term and document: the first element's."""
    return found.groupBy("field", "term", "seq_id").agg(F.min_by(F.struct("elem", "tf", "doc_len", "offsets"), "elem").alias("p")).select("field", "term", "seq_id", "p.*").select(*POSTING)


def term_stats(found: DataFrame) -> DataFrame:
    """field, term, df (postings, elements apart), sum_len and avg_doc_len (over the term's own postings)."""
    return found.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("doc_len").alias("sum_len"), F.avg("doc_len").alias("avg_doc_len"))


def stats_of_texts(docs: DataFrame, text_col: str, field: str | None = None) -> DataFrame:
    """The same for all terms of a column, without their places: distinct terms of each row are counted map-side."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.octet_length(text_col).cast("long").alias("doc_len"), F.explode(F.array_distinct(T.terms(F.col(text_col)))).alias("term"))
    return term_stats(rows.withColumn("field", F.lit(field or text_col)))


def merge_stats(*parts: DataFrame) -> DataFrame:
    """Statistics of several parts of a collection together: df and sum_len add up."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("sum_len").alias("sum_len")).filter("df > 0")
    return merged.withColumn("avg_doc_len", F.col("sum_len") / F.col("df"))


def phonetic(stats: DataFrame, code=T.folded) -> DataFrame:
    """field, code, term of the terms that start outside ASCII."""
    return stats.filter(T.starts_outside_ascii(F.col("term"))).select("field", code(F.col("term")).alias("code"), "term").distinct()


def remove(found: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings without those of the documents in ``gone(seq_id)``."""
    return found.join(gone.select("seq_id"), "seq_id", "left_anti").select(*found.columns)


def lookup(found: DataFrame, field: str, term: str) -> DataFrame:
    return found.filter((F.col("field") == field) & (F.col("term") == term))


def with_prefix(stats: DataFrame, field: str, prefix: str) -> DataFrame:
    """Dictionary terms below a prefix, in byte order."""
    return stats.filter((F.col("field") == field) & F.col("term").startswith(prefix)).orderBy("term")


def dictionary_size(stats: DataFrame) -> DataFrame:
    """Terms of each field."""
    return stats.groupBy("field").agg(F.count(F.lit(1)).alias("terms"))
