"""Incremental ingestion: a stream of documents becomes merged term statistics and engine collections, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import index


def ingest(engine, name: str, stream: DataFrame, checkpoint: str) -> None:
    """Add a stream of ``_raw`` documents to a collection; the batch id names the segment, so that a replay replaces it.

    Documents that fail validation or whose id is taken are appended to the collection's rejects.
    """
    from lexmill.operators import schema

    _, root = engine._meta(name)

    def add(batch: DataFrame, batch_id: int) -> None:
        if engine.holds(name, f"stream-{batch_id}"):
            return
        rows = schema.validated(batch.select("_raw"), root).join(engine.documents(name).select("doc_id", F.lit(True).alias("_taken")), "doc_id", "left")
        good = rows.filter((F.size("_errors") == 0) & F.col("_taken").isNull()).dropDuplicates(["doc_id"])
        rows.filter((F.size("_errors") > 0) | F.col("_taken").isNotNull()).select("_raw", "_errors").write.mode("overwrite").parquet(f"{engine.store.root}/{name}/rejects/{batch_id}")
        engine.add_documents(name, good.select("_raw", F.col("doc_id").alias("_ordinal")), tag=f"stream-{batch_id}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stats_from_stream(spark: SparkSession, stream: DataFrame, text_col: str, target: str) -> DataFrame:
    """Term statistics of a stream of texts: each batch leaves its additive part under its own id, and the parts are merged."""

    def part(batch: DataFrame, batch_id: int) -> None:
        index.stats_of_texts(batch, text_col).write.mode("overwrite").parquet(f"{target}/parts/batch={batch_id}")

    stream.writeStream.foreachBatch(part).option("checkpointLocation", f"{target}/progress").trigger(availableNow=True).start().awaitTermination()
    return index.merge_stats(spark.read.parquet(f"{target}/parts").select("field", "term", "df", "sum_len"))
