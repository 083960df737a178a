"""Collections made of the given tables, once for each session and folder, for queries that read a stored index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.api import Engine

DOCUMENTS = {
    "name": "documents",
    "schema": {"$fields": {"text": {"type": "string", "index": True}, "lang": {"type": "string"}, "source": {"type": "string"}, "n_chars": {"type": "integer", "sort_field": True}}},
}
PARTS = {
    "name": "parts",
    "schema": {
        "$fields": {
            "p_name": {"type": "string", "index": True, "suggest": True},
            "p_type": {"type": "string", "index": True},
            "p_size": {"type": "integer", "sort_field": True},
            "p_retailprice": {"type": "float", "sort_field": True},
        }
    },
    "auto_suggestion": {"entry_num": 5, "min_gram": 2, "max_gram": 15},
}
#: name -> (collection, table, id column)
COLLECTIONS = {"documents": (DOCUMENTS, "documents", "doc_id"), "parts": (PARTS, "part", "p_partkey")}

_built: dict[tuple[str, str, str], Engine] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or, where it is unset as in tests, one in the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lexmill"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """_ordinal and _raw: the rows of the collection's table as JSON documents; a null string is empty."""
    request, table, id_col = COLLECTIONS[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    members = [F.coalesce(c, F.lit("")).alias(c) if f["type"] == "string" else F.col(c) for c, f in request["schema"]["$fields"].items()]
    return rows.select(F.col(id_col).alias("_ordinal"), F.to_json(F.struct(F.col(id_col).alias("id"), *members)).alias("_raw"))


def empty(spark: SparkSession, *names: str) -> Engine:
    """An engine of its own folder with empty collections."""
    engine = Engine(spark, f"{scratch(spark)}/engine-{uuid.uuid4().hex}")
    for name in names:
        engine.create_collection(COLLECTIONS[name][0])
    return engine


def built(spark: SparkSession, sf_dir: str, name: str) -> Engine:
    """An engine that holds the whole table as a collection; made once, as long as the session lives."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        engine = empty(spark, name)
        engine.add_documents(name, raw(spark, sf_dir, name))
        _built[key] = engine
    return _built[key]
