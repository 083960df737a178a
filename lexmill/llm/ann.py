"""Approximate nearest neighbours by a permutation index.

A vector is represented by its PREFIX nearest of PIVOTS pivots, in order, and
posted under each with its place.  The index is split by vector into blocks of
about BLOCK, each with inverted files of its own; queries visit the blocks.
There, each of a query's pivots adds its postings' part of Spearman's footrule
(absent pivots count as place PREFIX), and the best share of the block by
footrule is ranked again by the exact distance on the original vectors.

Defined cases: null and zero vectors and those with null or non-finite
components take no part; a query's candidates are the vectors of its own
dimension, as distances between others are not defined (blocks of a dimension
other than the commonest take their pivots from among their own vectors); rows
repeated under one id are one vector; a query's own id is no candidate; ties go
to the smaller id; with fewer candidates than ``k`` all are returned.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.llm.common import cut, table

K = 10
#: The pivots are a sample of at most this many vectors, by hash of id.
PIVOTS = 256
BLOCK, QUERY_BLOCK = 4096, 2048
#: Share of a block, and least number, that is ranked by exact distance.
SHARE, LEAST = 0.08, 256


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


class Block:
    """Inverted files of one block of vectors, in order of id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.pivots = ids[order], vectors[order], pivots
        self.prefix = max(1, len(pivots) // 2)
        nearest = self.permutation(self.vectors)
        flat = nearest.ravel()
        place = np.argsort(flat, kind="stable")
        bounds = np.searchsorted(flat[place], np.arange(len(pivots) + 1))
        self.postings = [((place[a:b] // self.prefix).astype(np.int32), (place[a:b] % self.prefix).astype(np.int32)) for a, b in zip(bounds[:-1], bounds[1:])]

    def permutation(self, vectors: np.ndarray) -> np.ndarray:
        """Pivots nearest to each vector, nearest first."""
        d = (self.pivots**2).sum(1)[None] - 2 * vectors @ self.pivots.T
        return np.argsort(d, axis=1, kind="stable")[:, : self.prefix]

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int = K) -> list[tuple[int, int, float]]:
        """(query, vec_id, distance) of the nearest found in this block."""
        n, out = self.ids.size, []
        count = min(n, max(LEAST, math.ceil(SHARE * n)))
        for own, query, pivots in zip(ids.tolist(), vectors, self.permutation(vectors)):
            # The footrule is prefix x (prefix + 1) less twice this sum over the pivots that both have.
            near = np.zeros(n, np.int32)
            for place, p in enumerate(pivots.tolist()):
                rows, places = self.postings[p]
                near[rows] += self.prefix - np.maximum(places, place)
            near[self.ids == own] = -1
            best = np.argsort(-near, kind="stable")[:count]
            best = best[near[best] >= 0]
            distance = np.sqrt(((self.vectors[best] - query) ** 2).sum(1))
            for r in np.lexsort((self.ids[best], distance))[:k].tolist():
                out.append((own, int(self.ids[best[r]]), float(distance[r])))
        return out


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of ``vectors`` found for each of ``queries``."""
    import pandas as pd

    every = cut(usable(vectors, id_col, vector_col))
    asked = cut(usable(queries, id_col, vector_col))
    sizes = every.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return every.sparkSession.createDataFrame([], schema)
    pivots = np.array([r["v"] for r in every.filter(F.size("v") == sizes["size"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()])
    blocks, lots = max(1, math.ceil(sizes["count"] / BLOCK)), max(1, math.ceil(asked.count() / QUERY_BLOCK))
    every, asked = every.withColumn("size", F.size("v")), asked.withColumn("size", F.size("v"))
    posted = every.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    sent = asked.withColumn("lot", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(lots)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def look(index: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(index) and len(query):
            own = np.stack(index["v"].to_numpy()).astype(float)
            rows = Block(index["vec_id"].to_numpy(), own, pivots if own.shape[1] == pivots.shape[1] else own[:PIVOTS]).search(query["vec_id"].to_numpy(), np.stack(query["v"].to_numpy()).astype(float), k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = posted.groupBy("size", "block", "lot").cogroup(sent.groupBy("size", "block", "lot")).applyInPandas(look, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))
