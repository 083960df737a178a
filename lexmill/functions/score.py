"""Scores of hits as scalar expressions."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


class Scorer(Protocol):
    """Score of one term in one document."""

    def __call__(self, tf: Column, df: Column, doc_len: Column, avg_doc_len: Column, n_docs: int) -> Column: ...


def bm25(tf: Column, df: Column, doc_len: Column, avg_doc_len: Column, n_docs: int) -> Column:
    relevance = (K1 * tf) / (tf + K1 * (1 - B + B * doc_len / avg_doc_len))
    weight = F.ln(F.greatest(F.lit(n_docs) - df, F.lit(0)) + 0.5) / F.greatest(df + 0.5, F.lit(20.0))
    return weight * relevance


def tfidf(tf: Column, df: Column, doc_len: Column, avg_doc_len: Column, n_docs: int) -> Column:
    return (1 + F.ln(tf)) * F.ln(F.greatest(F.floor(F.lit(n_docs) / df), F.lit(1)))


SCORERS: dict[str, Scorer] = {"bm25": bm25, "tfidf": tfidf}


def phrase_factor(count: Column, query_terms: Column) -> Column:
    """Grows with the places where the whole query stands together."""
    return 1 + F.log1p(count * query_terms)


def cost_factor(cost: Column) -> Column:
    """Shrinks by 16 with every step of edit distance of a term."""
    return F.pow(F.lit(2.0), 4 * (4 - cost))


def total_cost_factor(costs: Column, n: Column) -> Column:
    """Shrinks with the edit distance of all terms together."""
    return (4 * n - costs) / (4.0 * n)
