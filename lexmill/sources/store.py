"""Collections on any file system that Spark knows: segments of Parquet tables, and numbered versions that list them.

A change writes a segment, a folder of its own, and then publishes a version: a small file of the next number that
names all segments.  The file comes into place whole, by one rename, and an older one is never touched, so readers see
one full version or the next.  Of two writers that start from one version the second is refused.  A write that is
repeated under the same tag replaces its own folder, which makes retries safe.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lexmill.errors import Conflict, Internal, NotFound

EMPTY: dict[str, Any] = {"number": 0, "segments": [], "removals": [], "next_seq_id": 0, "doc_num": 0}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p, jvm

    def exists(self, path: str) -> bool:
        fs, p, _ = self._fs(path)
        return fs.exists(p)

    def put(self, path: str, value: dict[str, Any]) -> None:
        """Write a small JSON file that is not there yet: beside its place first, and then renamed."""
        fs, p, jvm = self._fs(path)
        draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
        out.close()
        if fs.exists(p):
            fs.delete(draft, False)
            raise Conflict(f"{path} is there already")
        if not fs.rename(draft, p):
            taken = fs.exists(p)
            fs.delete(draft, False)
            raise Conflict(f"{path} is there already") if taken else Internal(f"could not write {path}")

    def get(self, path: str) -> dict[str, Any]:
        fs, p, jvm = self._fs(path)
        if not fs.exists(p):
            raise NotFound(f"no {path}")
        source = fs.open(p)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def remove(self, path: str) -> None:
        fs, p, _ = self._fs(path)
        fs.delete(p, True)

    def files(self, path: str) -> list[str]:
        """Names below a folder, in order; none where there is no folder."""
        fs, p, _ = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def names(self) -> list[str]:
        """Collections, in order of name."""
        return [n for n in self.files(self.root) if self.exists(f"{self.root}/{n}/meta.json")]

    # A collection's meta data and versions.
    def create(self, name: str, meta: dict[str, Any]) -> None:
        if self.exists(f"{self.root}/{name}/meta.json"):
            raise Conflict(f"collection {name} exists")
        numbers = [self.meta(n)["id"] for n in self.names()]
        self.put(f"{self.root}/{name}/meta.json", {**meta, "id": max(numbers, default=-1) + 1, "created at": time.ctime()})

    def meta(self, name: str) -> dict[str, Any]:
        return self.get(f"{self.root}/{name}/meta.json")

    def drop(self, name: str) -> None:
        self.meta(name)
        self.remove(f"{self.root}/{name}")

    def current(self, name: str) -> dict[str, Any]:
        """The version of the highest number."""
        numbers = [f for f in self.files(f"{self.root}/{name}/versions") if f.endswith(".json")]
        return self.get(f"{self.root}/{name}/versions/{numbers[-1]}") if numbers else dict(EMPTY)

    def publish(self, name: str, base: dict[str, Any], **changes: Any) -> None:
        """Make the version after ``base``; a Conflict where another writer made one since."""
        number = base["number"] + 1
        self.put(f"{self.root}/{name}/versions/{number:012d}.json", {**base, **changes, "number": number})

    # Tables of segments.
    def folder(self, name: str, tag: str) -> str:
        return f"{self.root}/{name}/segments/{tag}"

    def write(self, name: str, tag: str, kind: str, df: DataFrame, *order: str) -> DataFrame:
        """Write a table of a segment, sorted for pruned reads, and read it back."""
        path = f"{self.folder(name, tag)}/{kind}"
        (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, kind: str, schema: Any, tags: list[str]) -> DataFrame:
        """A table of all the segments that have it."""
        paths = [p for t in tags if self.exists(p := f"{self.folder(name, t)}/{kind}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
