"""All registered engine queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexmill.plans import documents, facade, tables

EVERY = documents.QUERIES | tables.QUERIES | facade.QUERIES


def queries() -> dict:
    return {name: run for name, (run, _) in EVERY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in EVERY.items()}
