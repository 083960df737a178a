"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or, where it is unset as in tests, one in the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lexmill"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmill-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexmill_path = path
    return out


def drop_cut(*tables: DataFrame | None) -> None:
    """Delete tables made by ``cut`` that no plan reads any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_lexmill_path", None)
        if path:
            spark = df.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Keys that hold more than this part of all rows are fewer than its inverse.
HOT_PART = 1 / 256
#: Stands for a null id in joins and orders: before all others.
NO_ID = -(1 << 63)


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """``many`` joined to ``few``, which has one row a key and, as ``count``, how many rows of ``many`` have the key (left out of the result).

    Keys of more than HOT_PART of the counted rows, 256 at most, are broadcast, so that no task gets all rows of such a
    key; the others are merged.  Both are tables that were cut.
    """
    total = few.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > total * HOT_PART
    warm = few.filter(~hot).drop(count)
    if few.filter(hot).isEmpty():
        return many.join(warm.hint("merge"), keys)
    few_hot = few.filter(hot).drop(count)
    rest = many.join(F.broadcast(few_hot.select(*keys)), keys, "left_anti")  # at most 256 rows
    return many.join(F.broadcast(few_hot), keys).unionByName(rest.join(warm.hint("merge"), keys))  # at most 256 rows


def held(docs: DataFrame, **named: str) -> DataFrame:
    """Each row in a struct ``_row``, so that no name of its columns can clash, and the named columns beside it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(F.col(f"`{c}`").alias(k) for k, c in named.items()))


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, id and text; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def per_text(texts: DataFrame, work: Callable[[], Callable[[list], list]], fields: list[tuple[str, pa.DataType]], schema: str, binary: bool = False, chunk: int = 1 << 24, after: Callable[[], None] | None = None) -> DataFrame:
    """Map-only Arrow pass over (doc_id, text): ``work()`` makes, once a task, a function from a list of texts to one list a field.

    Texts are handed over in slices of at most ``chunk`` bytes (or one text), so that a batch of long texts stays small in memory.
    ``after()`` runs as the task ends, also by a failure: workers stay alive, so what they hold on to is let go there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = work()
        target = pa.schema([("doc_id", pa.int64()), *fields])
        try:
            for batch in batches:
                for part in slices(batch, chunk):
                    column = part.column(1)
                    values = (column.cast(pa.binary()) if binary else column).to_pylist()
                    out = apply(values)
                    arrays = [part.column(0), *(pa.array(x, type=t) for x, (_, t) in zip(out, fields, strict=True))]
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)
        finally:
            if after:
                after()

    return texts.mapInArrow(run, "doc_id long, " + schema)


def slices(batch: pa.RecordBatch, chunk: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``chunk`` bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    size = max(1, batch.nbytes // n)
    step = max(1, min(n, chunk // size))
    for at in range(0, n, step):
        yield batch.slice(at, min(step, n - at))
