"""The engine's façade: collections, documents, search and suggestions, one method for each route of a search server.

A collection is a list of segments, each with its documents and the tables derived from them.  Adding documents writes a
segment and touches no other; removing them writes a segment of what to leave out and of negative counts.  Statistics
and suggestions are sums over the segments; ``rebuild`` merges all segments into one.
"""

from __future__ import annotations

import itertools
import json
import uuid
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.errors import Conflict, InvalidFormat, NotAuthorized, NotFound
from lexmill.functions import cut
from lexmill.functions import score as S
from lexmill.functions import segment
from lexmill.functions import text as T
from lexmill.model import TOP_K, CollectionMeta, Query, SuggestConfig
from lexmill.operators import index, schema, search, suggest
from lexmill.sources.store import Store

DOCUMENTS = "seq_id long, doc_id long, _raw string"
POSTINGS = "field string, term string, seq_id long, elem int, tf long, doc_len long, offsets array<long>"
STATS = "field string, term string, df long, sum_len long"
PHONETIC = "field string, code string, term string"
FREQ = "segment string, freq long, last_seen struct<doc:long,place:int>"
#: Documents that are looked up by a list of their numbers.
MOST_LOOKED_UP = 1000
#: Removed documents whose numbers are broadcast, so that tables keep their order without them.
MOST_LEFT_OUT = 1 << 22
#: Segments after which an addition merges them all.
MOST_SEGMENTS = 64


class Engine:
    """``tokenizers`` names further tokenizers: objects with ``tokens(docs, id_col, text_col)`` and ``query_terms(text)``.

    ``sounds`` maps characters to what they sound like; without it, letters with marks sound like those without.
    """

    def __init__(self, spark: SparkSession, root: str, tokenizers: dict[str, Any] | None = None, sounds: dict[str, str] | None = None):
        self.spark, self.store, self.tokenizers, self.sounds = spark, Store(spark, root), tokenizers or {}, sounds

    # Collections.
    def create_collection(self, request: str | dict) -> None:
        meta = CollectionMeta.parse(request)
        root = schema.parse(meta.schema)
        if schema.suggested(root) and meta.suggest is None:
            raise InvalidFormat("a suggest field needs auto_suggestion")
        self.store.create(meta.name, meta.raw)

    def drop_collection(self, name: str) -> None:
        self.store.drop(name)

    def describe(self, name: str) -> dict[str, Any]:
        return {**self.store.meta(name), "doc num": self.store.current(name)["doc_num"]}

    def list_collections(self) -> DataFrame:
        rows = [(n, self.store.meta(n)["created at"], self.store.current(n)["doc_num"]) for n in self.store.names()]
        return self.spark.createDataFrame(rows, "name string, created_at string, doc_num long")

    def _meta(self, name: str) -> tuple[CollectionMeta, schema.FieldInfo]:
        raw = self.store.meta(name)
        meta = CollectionMeta.parse({k: v for k, v in raw.items() if k not in ("id", "created at")})
        return meta, schema.parse(meta.schema)

    # Tables of one version.
    def _living(self, name: str, state: dict[str, Any], kind: str, table_schema: Any) -> DataFrame:
        """Rows of all segments but those of removed documents."""
        rows = self.store.read(name, kind, table_schema, state["segments"])
        if state["removals"]:
            rows = index.remove(rows, self._removed(name, state))
        return rows

    def _removed(self, name: str, state: dict[str, Any]) -> DataFrame:
        """Numbers of removed documents; broadcast while they are few, so that no table is moved for them."""
        gone = self.store.read(name, "removed", "seq_id long, doc_id long", state["removals"]).select("seq_id")
        return F.broadcast(gone) if few_left_out(state) else gone

    def documents(self, name: str, state: dict[str, Any] | None = None) -> DataFrame:
        """seq_id, doc_id, _raw of all documents."""
        self.store.meta(name)
        return self._living(name, state or self.store.current(name), "documents", DOCUMENTS)

    def scan(self, name: str) -> DataFrame:
        """All documents in order of sequence numbers."""
        return self.documents(name).orderBy("seq_id")

    def postings(self, name: str, state: dict[str, Any] | None = None) -> DataFrame:
        return self._living(name, state or self.store.current(name), "postings", POSTINGS)

    def term_stats(self, name: str, state: dict[str, Any] | None = None) -> DataFrame:
        """field, term, df, sum_len, avg_doc_len: the segments' counts summed, those of removals being negative."""
        state = state or self.store.current(name)
        return index.merge_stats(self.store.read(name, "term_stats", STATS, [*state["segments"], *state["removals"]]))

    def dictionary(self, name: str) -> DataFrame:
        """All terms of each field in byte order, with the codes by which they are found by sound."""
        codes = self.store.read(name, "phonetic", PHONETIC, self.store.current(name)["segments"]).distinct()
        return self.term_stats(name).join(codes, ["field", "term"], "left").select("field", "term", "df", "code").orderBy("field", "term")

    def suggest_freq(self, name: str) -> DataFrame:
        """segment, freq, last_seen; a removal takes its counts off but leaves the time of the last use."""
        state = self.store.current(name)
        return suggest.merge_frequencies(self.store.read(name, "suggest_freq", FREQ, [*state["segments"], *state["removals"]])).filter("freq > 0")

    # Documents.
    def add_documents(self, name: str, documents: str | list[str] | DataFrame, on_error: str = "fail", tag: str | None = None) -> int:
        """Add one document, ``{"docs": [...]}``, chunks of either, or a DataFrame with ``_raw`` (and ``_ordinal``).

        With ``on_error="fail"`` a bad or duplicate document leaves the collection as it was; with ``"prefix"`` the
        documents before the first such one are added and the error is raised then.
        """
        meta, root = self._meta(name)
        batch = self._batch(documents)
        state = self.store.current(name)
        tag = tag or f"v{uuid.uuid4().hex}"
        # Read and judged once; from here on only what each step needs is moved.
        checked = self.store.write(name, tag, "checked", schema.validated(batch, root).select("_ordinal", "doc_id", "_raw", "_errors"))
        taken = checked.filter("doc_id is not null").select("_ordinal", "doc_id").join(self.documents(name, state).select("doc_id", F.lit(True).alias("_taken")), "doc_id", "left")
        again = W.partitionBy("doc_id").orderBy("_ordinal")
        clash = taken.withColumn("_nth", F.row_number().over(again)).filter("_taken or _nth > 1").select("_ordinal", F.array().cast("array<string>").alias("_errors"), F.lit(True).alias("_conflict"), "doc_id")
        bad = checked.filter(F.size("_errors") > 0).select("_ordinal", "_errors", F.lit(False).alias("_conflict"), "doc_id")
        first = bad.unionByName(clash).orderBy("_ordinal", "_conflict").first()
        if first is not None and on_error != "prefix":
            self.store.remove(self.store.folder(name, tag))
            raise self._fault(first)
        good = checked.filter(F.col("_ordinal") < first["_ordinal"]) if first is not None else checked
        rows = numbered(good.select("_ordinal", "doc_id", "_raw"), "_ordinal", "doc_id", state["next_seq_id"])
        # The numbered rows are in order already, or in runs of it.
        self._segment(name, meta, root, rows.select("seq_id", "doc_id", "_raw"), tag, ordered=True)
        self.store.remove(f"{self.store.folder(name, tag)}/checked")
        count = self.store.read(name, "documents", DOCUMENTS, [tag]).count()
        if count:
            self.store.publish(name, state, segments=[*state["segments"], tag], next_seq_id=state["next_seq_id"] + count, doc_num=state["doc_num"] + count)
            if len(state["segments"]) + 1 >= MOST_SEGMENTS:
                self.rebuild(name)
        if first is not None:
            raise self._fault(first)
        return count

    def _batch(self, documents: str | list[str] | DataFrame) -> DataFrame:
        if isinstance(documents, DataFrame):
            return documents if "_ordinal" in documents.columns else documents.withColumn("_ordinal", F.monotonically_increasing_id())
        text = documents if isinstance(documents, str) else "".join(documents)
        try:
            body = json.loads(text)
        except ValueError as e:
            raise InvalidFormat(f"bad JSON: {e}") from None
        if not isinstance(body, dict):
            raise InvalidFormat("the root must be an object")
        docs = body["docs"] if "docs" in body else [body]
        if not isinstance(docs, list):
            raise InvalidFormat("docs must be an array")
        return self.spark.createDataFrame([(k, json.dumps(d, ensure_ascii=False)) for k, d in enumerate(docs)], "_ordinal long, _raw string")

    @staticmethod
    def _fault(row) -> Exception:
        return Conflict(f"document {row['doc_id']} exists") if row["_conflict"] and not row["_errors"] else InvalidFormat(f"document {row['_ordinal']}: {', '.join(row['_errors'])}")

    def get_document(self, name: str, number: int, seq: bool = False) -> dict[str, Any]:
        row = self.documents(name).filter(F.col("seq_id" if seq else "doc_id") == number).select("_raw").first()
        if row is None:
            raise NotFound(f"no document {number}")
        return json.loads(row["_raw"])

    def contains(self, name: str, doc_id: int) -> bool:
        return not self.documents(name).filter(F.col("doc_id") == doc_id).isEmpty()

    def members(self, name: str, paths: dict[str, str]) -> DataFrame:
        """doc_id and, for each column, what stands at a JSON path in the documents, as text."""
        return self.documents(name).select("doc_id", *(F.get_json_object("_raw", p).alias(c) for c, p in paths.items()))

    def remove_documents(self, name: str, ids: list[int] | DataFrame, tag: str | None = None) -> None:
        """Remove documents by id, a list or a table of doc_id; a NotFound where one isn't there leaves all."""
        self.store.meta(name)
        tag = tag or f"r{uuid.uuid4().hex}"
        state = self.store.current(name)
        gone = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "doc_id long")
        gone = gone.select("doc_id").distinct()
        removed = self.store.write(name, tag, "removed", self.documents(name, state).join(gone, "doc_id", "left_semi").select("seq_id", "doc_id"), "seq_id")
        count = removed.count()
        if count < gone.count():
            self.store.remove(self.store.folder(name, tag))
            raise NotFound("no such document")
        if not count:
            return
        own = removed.select("seq_id")
        own = F.broadcast(own) if count <= MOST_LEFT_OUT else own
        minus = self.postings(name, state).join(own, "seq_id", "left_semi")
        minus = index.term_stats(minus).select("field", "term", (-F.col("df")).alias("df"), (-F.col("sum_len")).alias("sum_len"))
        self.store.write(name, tag, "term_stats", minus, "field", "term")
        meta, root = self._meta(name)
        if meta.suggest and schema.suggested(root):
            texts = schema.parsed(self.documents(name, state).join(own, "seq_id", "left_semi"), root)
            freq = suggest.frequencies(self._segments(texts, root)).select("segment", (-F.col("freq")).alias("freq"), F.lit(None).cast("struct<doc:long,place:int>").alias("last_seen"))
            self.store.write(name, tag, "suggest_freq", freq, "segment")
        self.store.publish(name, state, removals=[*state["removals"], tag], doc_num=state["doc_num"] - count)

    def holds(self, name: str, tag: str) -> bool:
        """Whether a segment of this tag was added, be it merged with others since."""
        state = self.store.current(name)
        return tag in state["segments"] or tag in state.get("merged", [])

    def rebuild(self, name: str, tag: str | None = None) -> None:
        """Merge all segments into one, with its tables derived anew from the documents."""
        meta, root = self._meta(name)
        state, tag = self.store.current(name), tag or f"v{uuid.uuid4().hex}"
        if len(state["segments"]) == 1 and few_left_out(state):
            # One segment's tables are in order, and stay so when rows are left out.
            self._segment(name, meta, root, self.documents(name, state), tag, ordered=True, postings=self.postings(name, state), stats=self.term_stats(name, state))
        else:
            self._segment(name, meta, root, self.documents(name, state), tag)
        self.store.publish(name, state, segments=[tag], removals=[], merged=[*state.get("merged", []), *state["segments"]])

    # Derived tables: a function of a segment's documents.
    def _tokens(self, meta: CollectionMeta):
        return self.tokenizers.get(meta.tokenizer)

    def _code(self):
        return T.folded if self.sounds is None else lambda term: segment.romanized(term, self.sounds)

    def _segment(self, name: str, meta: CollectionMeta, root: schema.FieldInfo, docs: DataFrame, tag: str, ordered: bool = False, postings: DataFrame | None = None, stats: DataFrame | None = None) -> None:
        """Write a segment; ``postings``, in order, and ``stats`` are those of the documents where they are known."""
        docs = schema.parsed(self.store.write(name, tag, "documents", docs, *(() if ordered else ("seq_id",))), root)
        indexed = schema.indexed(root)
        if indexed:
            if postings is None:
                postings = self._postings(name, tag, docs, root, [f.path for f in indexed], meta)
            postings = self.store.write(name, tag, "postings", postings)
            self.store.remove(f"{self.store.folder(name, tag)}/unsorted")
            stats = self.store.write(name, tag, "term_stats", (index.term_stats(postings) if stats is None else stats).select("field", "term", "df", "sum_len"), "field", "term")
            self.store.write(name, tag, "phonetic", index.phonetic(stats, self._code()), "field", "code")
        numbers = schema.numeric(root)
        if numbers:
            self.store.write(name, tag, "numbers", docs.select("seq_id", *(schema.number(F.col("doc"), root, f.path).cast("double").alias(f.path) for f in numbers)), "seq_id")
        if meta.suggest and schema.suggested(root):
            self.store.write(name, tag, "suggest_freq", suggest.frequencies(self._segments(docs, root)), "segment")

    def _segments(self, docs: DataFrame, root: schema.FieldInfo) -> DataFrame:
        parts = [docs.select("seq_id", F.explode(schema.values(F.col("doc"), root, f.path)).alias("text")) for f in schema.suggested(root)]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return suggest.segments(rows, "text", "seq_id")

    def _postings(self, name: str, tag: str, docs: DataFrame, root: schema.FieldInfo, paths: list[str], meta: CollectionMeta) -> DataFrame:
        """Postings of all these fields, sorted by field and term.

        A term's postings of a slice of texts are moved and sorted as one row.  The range sort reads its input twice, to
        draw borders and to deal, which cuts the texts up again but writes nothing.
        """
        own = self._tokens(meta)
        rows = {path: docs.select("seq_id", F.posexplode(schema.values(F.col("doc"), root, path)).alias("elem", "text")).select(F.struct("seq_id", "elem").alias("_key"), "text") for path in paths}
        if own is None:
            packed = reduce(DataFrame.unionByName, (cut.packed(r, "_key", "text").withColumn("field", F.lit(path)) for path, r in rows.items()))
            order = ("field", "term", "first")
            return cut.unpacked(packed.repartitionByRange(*order).sortWithinPartitions(*order))
        grouped = lambda r: own.tokens(r, "_key", "text").groupBy("term", "_key").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"), F.sort_array(F.collect_list("offset")).alias("offsets"))
        found = reduce(DataFrame.unionByName, (grouped(r).select(F.lit(path).alias("field"), "term", "_key.seq_id", F.col("_key.elem").alias("elem"), "tf", "doc_len", "offsets") for path, r in rows.items()))
        # Written as they come first: a tokenizer's work is not done twice.
        order = ("field", "term", "seq_id")
        return self.store.write(name, tag, "unsorted", found).repartitionByRange(*order).sortWithinPartitions(*order)

    # Queries.
    def search(self, name: str, request: str | dict, scorer: str = "bm25", k: int = TOP_K, exhaustive: bool = False, fuzzy: bool = True, relax: bool = True) -> DataFrame:
        """rank, seq_id, score, bm25, doc_id, _raw of the best documents."""
        query = Query.parse(request)
        meta, root = self._meta(name)
        known = schema.fields(root)
        texts = {f.path for f in schema.indexed(root)}
        numbers = {f.path for f in schema.numeric(root)}
        for f in query.fields:
            if f not in texts:
                raise InvalidFormat(f"{f} is not an indexed string field" if f in known else f"unknown field {f}")
        for s in query.sort:
            if s.field not in numbers:
                raise InvalidFormat(f"{s.field} is no number" if s.field in known else f"unknown field {s.field}")
        state = self.store.current(name)
        if scorer not in S.SCORERS:
            raise InvalidFormat(f"unknown scorer {scorer}")
        schema_ = "rank int, seq_id long, score double, bm25 double, doc_id long, _raw string"
        if not state["doc_num"] or not query.fields:
            return self.spark.createDataFrame([], schema_)
        postings = self.postings(name, state)
        wanted = lambda terms: index.first_elements(postings.filter(F.col("field").isin(*query.fields) & F.col("term").isin(*terms)))
        docs = self.documents(name, state)
        sort_columns = None
        if query.sort:
            every = ", ".join(f"`{f.path}` double" for f in schema.numeric(root))
            sort_columns = self._living(name, state, "numbers", f"seq_id long, {every}").select("seq_id", *(f"`{s.field}`" for s in query.sort))
        own = self._tokens(meta)
        sound = (lambda t: "".join(self.sounds.get(c, c) for c in t)) if self.sounds is not None else None
        stats = self.term_stats(name, state)
        top = search.search(
            wanted, stats, state["doc_num"], query, sort_columns, S.SCORERS[scorer], fuzzy, exhaustive, relax, k, own.query_terms if own else T.query_terms, self._code(), sound
        )
        # The top rows are few; looked up by number, the documents are neither moved nor read whole.
        rows = top.select("rank", "seq_id", "score", "bm25").collect()  # at most k rows
        if len(rows) <= MOST_LOOKED_UP:
            docs = docs.filter(F.col("seq_id").isin([r["seq_id"] for r in rows]))
            top = F.broadcast(self.spark.createDataFrame(rows, "rank int, seq_id long, score double, bm25 double"))
        return docs.join(top, "seq_id").orderBy("rank").select("rank", "seq_id", "score", "bm25", "doc_id", "_raw")

    def search_json(self, name: str, request: str | dict, **options: Any) -> str:
        import time

        began = time.perf_counter()
        rows = self.search(name, request, **options).collect()  # at most k rows
        hits = [{**json.loads(r["_raw"]), "seq id": r["seq_id"]} for r in rows]
        return json.dumps({"found": len(rows), "took secs": round(time.perf_counter() - began, 6), "hits": hits, "scores": [r["score"] for r in rows]}, ensure_ascii=False)

    def suggest(self, name: str, prefix: str) -> DataFrame:
        meta, root = self._meta(name)
        if meta.suggest is None:
            raise NotAuthorized(f"{name} has no auto suggestion")
        if not schema.suggested(root):
            return self.spark.createDataFrame([], "rank int, segment string, freq long")
        # Only segments that begin so are read and summed.
        return suggest.lookup(suggest.best(self.suggest_freq(name).filter(F.col("segment").startswith(prefix)), meta.suggest), prefix)


#: Bytes of documents that a task sorts, and the most tasks among which they are dealt.
PART_BYTES, MOST_PARTS = 1 << 26, 1024
#: Runs of documents in order, up to which they are numbered in their place.
MOST_RUNS = 4096


def few_left_out(state: dict[str, Any]) -> bool:
    """Whether the removed documents, of which no more can be than numbers without a document, are few enough to be broadcast."""
    return state["next_seq_id"] - state["doc_num"] <= MOST_LEFT_OUT


def part_of(value: Column, borders: list[int]) -> Column:
    """How many of the borders lie at or below a value, by halving."""
    if not borders:
        return F.lit(0)

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < borders[middle], within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(borders))


def numbered(rows: DataFrame, order: str, tie: str, base: int) -> DataFrame:
    """``rows`` of a table, read from its files, with seq_id from ``base`` on in the order of a column, then of another, both together of distinct values.

    Rows that stand in a few ascending runs, which share no stretch of the order, are numbered in their place.  Others are
    dealt by borders that are fixed beforehand, so that their numbers follow from exact counts of the parts, and are moved
    and sorted once.  Only a row a run, or borders and counts, come to the driver.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    by_place = W.partitionBy("_file").orderBy("_at")
    begins = F.coalesce(F.lag(order).over(by_place) >= F.col(order), F.lit(True)) | F.col(order).isNull()
    runs = rows.select(order, *place).withColumn("_new", begins.cast("int")).withColumn("_run", F.sum("_new").over(by_place))
    runs = runs.groupBy("_file", "_run").agg(F.min("_at").alias("begin"), F.max("_at").alias("end"), F.min(order).alias("low"), F.max(order).alias("high"), F.count(F.lit(1)).alias("n"))
    found = runs.limit(MOST_RUNS + 1).collect()
    found.sort(key=lambda r: (r["low"] is not None, r["low"]))
    whole = len(found) <= MOST_RUNS and all(r["low"] is not None and r["end"] - r["begin"] + 1 == r["n"] for r in found)
    starts, at = [], base
    if whole and all(a["high"] < b["low"] for a, b in itertools.pairwise(found)):
        of_file: dict[str, list[tuple[int, int]]] = {}
        for r in found:
            of_file.setdefault(r["_file"], []).append((r["begin"], at - r["begin"]))
            at += r["n"]
        table = rows.sparkSession.createDataFrame([(f, sorted(x)) for f, x in of_file.items()], "_file string, _runs array<struct<begin:long,shift:long>>")
        own = F.element_at(F.filter("_runs", lambda r: r["begin"] <= F.col("_at")), -1)
        return rows.select(*rows.columns, *place).join(F.broadcast(table), "_file").withColumn("seq_id", F.col("_at") + own["shift"]).drop("_file", "_at", "_runs")  # a row a file
    size = rows.agg(F.sum(F.octet_length("_raw"))).first()[0] or 0
    n = min(MOST_PARTS, size // PART_BYTES + 1)
    borders = sorted({min(int(b), (1 << 63) - 1) for b in rows.approxQuantile(order, [k / n for k in range(1, n)], 0.1 / n)}) if n > 1 else []
    part = part_of(F.col(order), borders)
    counts = {r["_part"]: r["n"] for r in rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for k in range(len(borders) + 1):
        starts.append(at)
        at += counts.get(k, 0)
    parts = rows.repartitionById(len(starts), part).sortWithinPartitions(order, tie).withColumn("_mono", F.monotonically_increasing_id())
    start = F.get(F.array(*map(F.lit, starts)).cast("array<bigint>"), F.shiftright("_mono", 33).cast("int"))
    return parts.withColumn("seq_id", start + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mono")


__all__ = ["Engine", "SuggestConfig"]
