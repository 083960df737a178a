"""Queries through the engine's façade: collections, documents, changes, requests, configuration, segmentation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.api import Engine
from lexmill.config import Config
from lexmill.errors import EngineError
from lexmill.functions.segment import Model, Segmenter
from lexmill.model import Query
from lexmill.operators import schema
from lexmill.plans.documents import AVG, TOKENS, bm25_sql, ranked_sql, shown
from lexmill.plans.library import DOCUMENTS, built, empty, raw, scratch

_shrunk: dict[tuple[str, str], Engine] = {}


def grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a collection to which documents came in three additions, each a segment of its own."""
    engine, rows = empty(spark, "documents"), raw(spark, sf_dir, "documents")
    for k in range(3):
        engine.add_documents("documents", rows.filter(F.col("_ordinal") % 3 == k))
    return engine.term_stats("documents").select("term", "df", F.round("avg_doc_len", 6).alias("avg_doc_len"))


def shrunk(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine from whose collection the documents of one source were removed."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _shrunk:
        engine = empty(spark, "documents")
        engine.add_documents("documents", raw(spark, sf_dir, "documents"))
        engine.remove_documents("documents", spark.read.parquet(f"{sf_dir}/documents.parquet").filter("source = 'src0'").select("doc_id"))
        _shrunk[key] = engine
    return _shrunk[key]


def remove_docs_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shrunk(spark, sf_dir).term_stats("documents").select("term", "df", F.round("avg_doc_len", 6).alias("avg_doc_len"))


def engine_search_after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(shrunk(spark, sf_dir).search("documents", {"query": "thing", "query by": ["text"]}, fuzzy=False, relax=False))


def removed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of one word that are left after the removal."""
    engine = shrunk(spark, sf_dir)
    return engine.postings("documents").filter("term = 'and'").join(engine.documents("documents").select("seq_id", "doc_id"), "seq_id").select("doc_id", "tf", "doc_len")


def rebuilt_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in order of sequence numbers after the segments were merged; numbers stay."""
    engine = shrunk(spark, sf_dir)
    if len(engine.store.current("documents")["removals"]):
        engine.rebuild("documents")
    return engine.scan("documents").select("seq_id", "doc_id")


def add_batch_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents are there; all documents come: those before the first that is taken are added."""
    engine, rows = empty(spark, "documents"), raw(spark, sf_dir, "documents")
    engine.add_documents("documents", rows.filter(F.get_json_object("_raw", "$.lang") == "en"))
    try:
        engine.add_documents("documents", rows, on_error="prefix")
    except EngineError:
        pass
    return engine.documents("documents").select("doc_id")


def _document(spark: SparkSession, sf_dir: str, number: int, seq: bool) -> DataFrame:
    found = built(spark, sf_dir, "documents").get_document("documents", number, seq)
    return spark.createDataFrame([(found["id"], found["text"], found["lang"])], "doc_id long, text string, lang string")


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = built(spark, sf_dir, "documents")
    return spark.createDataFrame([(i, engine.contains("documents", i)) for i in (7, 4_000_000_000)], "doc_id long, there boolean")


def collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collection with documents, one without, one that was dropped."""
    engine = empty(spark, "documents", "parts")
    engine.create_collection({"name": "gone", "schema": {"$fields": {}}})
    engine.add_documents("parts", raw(spark, sf_dir, "parts"))
    engine.drop_collection("gone")
    return engine.list_collections().select("name", "doc_num")


def doc_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "parts").documents("parts").select("doc_id", F.col("_raw").alias("raw"))


def json_path_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "parts").members("parts", {"name": "$.p_name", "size": "$.p_size", "missing": "$.none.first"})


def json_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document whose text comes in pieces, cut within a word and a number, equals the one in one piece."""
    engine = Engine(spark, f"{empty(spark).store.root}-chunks")
    engine.create_collection({"name": "c", "schema": {"$fields": {"t": {"type": "string", "index": True}}}})
    engine.add_documents("c", ['{"id": 4', '1, "t": "two pi', 'eces"}'])
    engine.add_documents("c", '{"id": 42, "t": "two pieces"}')
    return engine.members("c", {"t": "$.t"})


def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to a request as JSON: what was found, in order."""
    answer = json.loads(built(spark, sf_dir, "parts").search_json("parts", {"query": "small ring", "query by": ["p_name"], "sort by": ["p_size:asc", "p_retailprice:desc"]}, fuzzy=False, relax=False))
    rows = [(k + 1, h["id"], h["seq id"], answer["found"]) for k, h in enumerate(answer["hits"])]
    return spark.createDataFrame(rows, "rank long, p_partkey long, seq_id long, found long")


#: case, what goes wrong, its status
FAULTS = (
    ("collection is taken", "Conflict", 409),
    ("document is taken", "Conflict", 409),
    ("field is not text", "InvalidFormat", 400),
    ("name is bad", "InvalidFormat", 400),
    ("no such collection", "NotFound", 404),
    ("no such document", "NotFound", 404),
    ("request is no JSON", "InvalidFormat", 400),
    ("suggestions are off", "NotAuthorized", 500),
)


def engine_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = built(spark, sf_dir, "documents")
    cases = {
        "collection is taken": lambda: engine.create_collection(DOCUMENTS),
        "document is taken": lambda: engine.add_documents("documents", '{"id": 7, "text": "", "lang": "", "source": "", "n_chars": 0}'),
        "field is not text": lambda: engine.search("documents", {"query": "a", "query by": ["n_chars"]}),
        "name is bad": lambda: engine.create_collection({"name": "a b", "schema": {}}),
        "no such collection": lambda: engine.describe("none"),
        "no such document": lambda: engine.get_document("documents", 4_000_000_000),
        "request is no JSON": lambda: engine.search("documents", "{"),
        "suggestions are off": lambda: engine.suggest("documents", "th"),
    }
    rows = []
    for case, run in cases.items():
        try:
            run()
            rows.append((case, "none", 200))
        except EngineError as e:
            rows.append((case, type(e).__name__, e.status))
    return spark.createDataFrame(rows, "case string, error string, status int")


SETTINGS = ('{"server": {"port": "8080", "hosts": ["a", "b"], "tls": {"on": "yes"}}}', '<server port="8080"><hosts>a</hosts><hosts>b</hosts><tls on="yes"/></server>')


def config_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of one meaning in JSON and XML, read from files."""
    rows = []
    for kind, body in zip(("json", "xml"), SETTINGS, strict=True):
        path = f"{scratch(spark)}/settings-{kind}"
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        rows += [(kind, p, str(v)) for p, v in Config.read(spark, path).flat().items()]
    return spark.createDataFrame(rows, "kind string, path string, value string")


def query_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query.parse('{"query": "red soup", "query by": ["title", "body"], "boost": [5, 1], "sort by": ["rank:asc", "price:descend"]}')
    rows = [("field", f, b) for f, b in zip(q.fields, q.boosts, strict=True)] + [("sort", s.field, 1.0 if s.ascending else -1.0) for s in q.sort]
    return spark.createDataFrame(rows, "part string, name string, value double")


def schema_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and kinds of a schema of nested parts."""
    body = {"$fields": {"title": {"type": "string", "index": True}, "crew": {"type": "array", "$items": {"type": "object", "$fields": {"role": {"type": "string"}, "years": {"type": "integer"}}}}, "hull": {"type": "object", "$fields": {"length": {"type": "float"}}}}}
    root = schema.parse(body)
    return spark.createDataFrame([(p, f.kind, f in schema.indexed(root)) for p, f in schema.fields(root).items()], "path string, kind string, indexed boolean")


#: A tiny invented model: letters of the first row begin words, those of the second end them.
TINY = Model(
    {"B": -0.5, "E": -9.0, "M": -9.0, "S": -1.0},
    {"B": {"E": -0.3, "M": -1.4}, "E": {"B": -0.7, "S": -0.7}, "M": {"E": -0.3, "M": -1.4}, "S": {"B": -0.7, "S": -0.7}},
    {"B": {c: -1.0 for c in "东西"}, "E": {c: -1.0 for c in "南北"}, "M": {}, "S": {c: -1.0 for c in "上下"}},
)


def segmenter() -> Segmenter:
    return Segmenter({"清水": 40, "清水河": 20, "木船": 30, "在": 90}, user_words=["石桥"], stop_words=["在"], model=TINY)


def segment_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary words and their parts, a user's word, words that only the model cuts, Latin words; stop words are left out."""
    rows = spark.createDataFrame([(1, "木船在清水河"), (2, "石桥，东南西北上 boat7")], "doc_id long, text string")
    return segmenter().tokens(rows, "doc_id", "text").select("doc_id", "term", F.col("offset").cast("long").alias("place"))


def sound_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word is found by one that sounds alike."""
    sounds = {"木": "mu", "母": "mu", "船": "chuan", "传": "chuan"}
    engine = Engine(spark, f"{empty(spark).store.root}-sounds", {"words": Segmenter({"木船": 5, "母传": 5, "小河": 5})}, sounds)
    engine.create_collection({"name": "s", "tokenizer": "words", "schema": {"$fields": {"t": {"type": "string", "index": True}}}})
    engine.add_documents("s", json.dumps({"docs": [{"id": 1, "t": "木船"}, {"id": 2, "t": "小河"}]}))
    return engine.search("s", {"query": "母传", "query by": ["t"]}).select("rank", "doc_id")


def values(columns: str, *rows: tuple) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)}) AS v({columns})"


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


WITHOUT = f"WITH documents AS (SELECT * FROM main.documents WHERE source <> 'src0' OR source IS NULL), {TOKENS}"
FLAT = (("server.port", "8080"), ("server.hosts.0", "a"), ("server.hosts.1", "b"), ("server.tls.on", "yes"))

QUERIES = {
    "engine_add": (grown, f"WITH {TOKENS} SELECT term, df, {AVG} FROM stats"),
    "remove_docs_reindex": (remove_docs_reindex, f"{WITHOUT} SELECT term, df, {AVG} FROM stats"),
    "engine_remove": (removed_postings, f"{WITHOUT} SELECT doc_id, tf, doc_len FROM post WHERE term = 'and'"),
    "engine_search": (engine_search_after_removal, f"{WITHOUT} {ranked_sql(f'SELECT doc_id, 65536 * {bm25_sql()} * (1 + ln(1 + tf)) AS s FROM post JOIN stats USING (term), corpus WHERE term = {text('thing')}')}"),
    "engine_scan": (rebuilt_scan, "SELECT seq_id, doc_id FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS seq_id FROM documents) WHERE source <> 'src0' OR source IS NULL"),
    "add_batch_conflicts": (add_batch_conflicts, "SELECT doc_id FROM documents WHERE lang = 'en' OR doc_id < (SELECT min(doc_id) FROM documents WHERE lang = 'en')"),
    "get_by_id": (lambda spark, sf_dir: _document(spark, sf_dir, 7, False), "SELECT doc_id, text, lang FROM documents WHERE doc_id = 7"),
    "get_by_seq": (lambda spark, sf_dir: _document(spark, sf_dir, 11, True), "SELECT doc_id, text, lang FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS seq_id FROM documents) WHERE seq_id = 11"),
    "engine_contains": (contains, "SELECT CAST(i AS BIGINT) AS doc_id, i IN (SELECT doc_id FROM documents) AS there FROM (VALUES (7), (4000000000)) AS v(i)"),
    "collection_summary": (collection_summary, "SELECT 'documents' AS name, CAST(0 AS BIGINT) AS doc_num UNION ALL SELECT 'parts', count(*) FROM part"),
    "doc_to_json": (doc_to_json, "SELECT p_partkey AS doc_id, CAST(to_json({'id': p_partkey, 'p_name': p_name, 'p_type': p_type, 'p_size': p_size, 'p_retailprice': p_retailprice}) AS VARCHAR) AS raw FROM part"),
    "json_path_access": (json_path_access, "SELECT p_partkey AS doc_id, p_name AS name, CAST(p_size AS VARCHAR) AS size, CAST(NULL AS VARCHAR) AS missing FROM part"),
    "json_chunks": (json_chunks, values("doc_id, t", ("CAST(41 AS BIGINT)", "'two pieces'"), ("42", "'two pieces'"))),
    "search_json": (
        search_json,
        "WITH h AS (SELECT row_number() OVER (ORDER BY p_size, p_retailprice DESC, p_partkey) AS rank, p_partkey, seq_id FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS seq_id FROM part) WHERE list_contains(string_split_regex(p_name, '[ .|,:;&]'), 'small') AND list_contains(string_split_regex(p_name, '[ .|,:;&]'), 'ring')), t AS (SELECT * FROM h WHERE rank <= 50) SELECT rank, p_partkey, seq_id, (SELECT count(*) FROM t) AS found FROM t",
    ),
    "engine_errors": (engine_errors, values('"case", error, status', *((text(c), text(e), str(n)) for c, e, n in FAULTS))),
    "config_flat": (config_flat, values("kind, path, value", *((text(k), text(p), text(v)) for k in ("json", "xml") for p, v in FLAT))),
    "query_parse": (query_parse, values("part, name, value", ("'field'", "'title'", "5::double"), ("'field'", "'body'", "1"), ("'sort'", "'rank'", "1"), ("'sort'", "'price'", "-1"))),
    "schema_paths": (
        schema_paths,
        values("path, kind, indexed", *((text(p), text(k), i) for p, k, i in (("title", "string", "true"), ("crew", "array", "false"), ("crew.$items", "object", "false"), ("crew.$items.role", "string", "false"), ("crew.$items.years", "integer", "false"), ("hull", "object", "false"), ("hull.length", "float", "false")))),
    ),
    "segment_terms": (
        segment_terms,
        values("doc_id, term, place", *((f"CAST({d} AS BIGINT)", text(t), f"CAST({p} AS BIGINT)") for d, t, p in ((1, "木船", 0), (1, "清水", 3), (1, "清水河", 3), (2, "石桥", 0), (2, "东南", 3), (2, "西北", 5), (2, "上", 7), (2, "boat7", 9)))),
    ),
    "sound_search": (sound_search, values("rank, doc_id", ("1", "CAST(1 AS BIGINT)"))),
}
