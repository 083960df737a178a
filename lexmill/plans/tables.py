"""Queries over the other tables: suggestions, nested arrays, validation, changes, summaries, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import index, schema, suggest
from lexmill.plans.documents import AVG, TOKENS, bm25_sql, docs, ranked_sql, shown
from lexmill.plans.library import built, scratch
from lexmill.streaming.ingest import stats_from_stream

def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def search_multifield_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of two fields counts, not their sum."""
    request = {"query": "small SMALL", "query by": ["p_name", "p_type"], "boost": [2, 1]}
    return shown(built(spark, sf_dir, "parts").search("parts", request, fuzzy=False, exhaustive=True), "p_partkey")


def search_sort_asc_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = {"query": "small ring", "query by": ["p_name"], "sort by": ["p_size:asc", "p_retailprice:desc"]}
    return shown(built(spark, sf_dir, "parts").search("parts", request, fuzzy=False, relax=False), "p_partkey")


def edge_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", F.explode(T.edge_ngrams(F.col("p_name"), 2, 15)).alias("prefix"))


def _freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "parts").suggest_freq("parts")


def suggest_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that used a segment last is named by its sequence number."""
    return _freq(spark, sf_dir).select("segment", "freq", F.col("last_seen.doc").alias("last_doc"), F.col("last_seen.place").alias("last_place"))


def suggest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.best(_freq(spark, sf_dir))


def suggest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "parts").suggest("parts", "re")


def nested_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", "role"))).alias("turns"))
    found = index.nested_postings(talks, "conv_id", F.transform("turns", lambda t: t["text"]), "turns.$items.text")
    return found.select("field", "term", F.col("seq_id").alias("conv_id"), "elem", "tf", "doc_len", F.element_at("offsets", 1).alias("first_at"), F.element_at("offsets", -1).alias("last_at"))


def nested_first_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several elements with a term, the first one's counts stand for the document."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", "role"))).alias("turns"))
    found = index.first_elements(index.nested_postings(talks, "conv_id", F.transform("turns", lambda t: t["text"]), "turns.$items.text"))
    return found.select("term", F.col("seq_id").alias("conv_id"), "elem", "tf", "doc_len")


PROPS = {"$fields": {"k": {"type": "integer"}}}
FLOATS = {"$fields": {"k": {"type": "float"}}}
EVENT = {"$fields": {"event_id": {"type": "integer"}, "event_type": {"type": "string"}, "value": {"type": "float"}, "props": {"type": "string"}}}


def validate_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    ok = lambda s: F.size(schema.errors(F.col("props"), schema.parse(s))) == 0
    return rows.select("event_id", ok(PROPS).alias("as_integer"), ok(FLOATS).alias("as_float"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON against a schema: how many hold, and which fields fail."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.to_json(F.struct("event_id", "event_type", "value", "props")).alias("raw"))
    return raw.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size(schema.errors(F.col("raw"), schema.parse(EVENT))) == 0, 1)).alias("n_valid"))


def stream_ingest_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of files; the statistics of its batches, merged."""
    path = f"{sf_dir}/documents.parque[t]"
    stream = spark.readStream.schema(docs(spark, sf_dir).schema).parquet(path)
    merged = stats_from_stream(spark, stream, "text", f"{scratch(spark)}/stream-{uuid.uuid4().hex}")
    return merged.select("term", "df", F.round("avg_doc_len", 6).alias("avg_doc_len"))


SEGMENTS = """r AS (SELECT p_partkey, unnest(string_split_regex(p_name, '[ .|,:;&]')) AS segment, generate_subscripts(string_split_regex(p_name, '[ .|,:;&]'), 1) AS pos FROM part),
f AS (SELECT p_partkey, segment, min(pos) AS pos FROM r WHERE segment <> '' GROUP BY 1, 2),
g AS (SELECT p_partkey, segment, row_number() OVER (PARTITION BY p_partkey ORDER BY pos) - 1 AS place FROM f),
freq AS (SELECT segment, count(*) AS freq, max(seq_id) AS last_doc, CAST(arg_max(place, seq_id) AS INTEGER) AS last_place FROM g JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS seq_id FROM part) USING (p_partkey) WHERE strlen(segment) <= 45 GROUP BY 1),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY prefix ORDER BY freq DESC, CASE WHEN freq = 1 THEN -last_doc ELSE last_doc END, CASE WHEN freq = 1 THEN -last_place ELSE last_place END, segment) AS INTEGER) AS rank
  FROM (SELECT *, left(segment, unnest(range(least(2, length(segment)), least(length(segment), 14) + 1))) AS prefix FROM freq)),
topk AS (SELECT prefix, rank, segment, freq FROM best WHERE rank <= 5)"""

TURNS = """e AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text, role) - 1 AS elem FROM conversations),
p AS (SELECT conv_id, elem, strlen(text) AS doc_len, string_split_regex(text, '[ .|,:;&]') AS a FROM e WHERE text IS NOT NULL),
u AS (SELECT conv_id, elem, doc_len, unnest(a) AS term, generate_subscripts(a, 1) AS pos FROM p),
tok AS (SELECT conv_id, elem, doc_len, term, CAST(coalesce(sum(strlen(term) + 1) OVER (PARTITION BY conv_id, elem ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_at FROM u),
post AS (SELECT term, conv_id, CAST(elem AS INTEGER) AS elem, count(*) AS tf, any_value(doc_len) AS doc_len, min(byte_at) AS first_at, max(byte_at) AS last_at FROM tok WHERE term <> '' GROUP BY 1, 2, 3)"""



def one_word(field: str, word: str, boost: int) -> str:
    """Hits of one word in a field whose values hold it once at most."""
    held = f"list_contains(string_split_regex({field}, '[ .|,:;&]'), '{word}')"
    stats = f"(SELECT count(*) AS df, avg(strlen({field})) AS avg_doc_len FROM part WHERE {held})"
    return f"SELECT p_partkey AS doc_id, {boost} * 65536 * {bm25_sql('1', 'df', f'strlen({field})', 'avg_doc_len', '(SELECT count(*) FROM part)')} * (1 + ln(2::double)) AS s FROM part, {stats} WHERE {held}"


MULTIFIELD = f"SELECT * FROM ({ranked_sql('SELECT doc_id, max(s) AS s FROM (' + one_word('p_name', 'small', 2) + ' UNION ALL ' + one_word('p_type', 'SMALL', 1) + ') GROUP BY doc_id', 'p_partkey')})"

QUERIES = {
    "search_multifield_max": (search_multifield_max, MULTIFIELD),
    "search_sort_asc_desc": (search_sort_asc_desc, "SELECT CAST(row_number() OVER (ORDER BY p_size, p_retailprice DESC, p_partkey) AS INTEGER) AS rank, p_partkey, CAST(-p_size AS DOUBLE) AS score FROM part WHERE list_contains(string_split_regex(p_name, '[ .|,:;&]'), 'small') AND list_contains(string_split_regex(p_name, '[ .|,:;&]'), 'ring') ORDER BY rank LIMIT 50"),
    "edge_ngrams": (edge_ngrams, "SELECT p_partkey, left(p_name, unnest(range(least(2, length(p_name)), least(length(p_name), 14) + 1))) AS prefix FROM part"),
    "suggest_freq": (suggest_freq, f"WITH {SEGMENTS} SELECT segment, freq, last_doc, last_place FROM freq"),
    "suggest_topk": (suggest_topk, f"WITH {SEGMENTS} SELECT * FROM topk"),
    "suggest_lookup": (suggest_lookup, f"WITH {SEGMENTS} SELECT rank, segment, freq FROM topk WHERE prefix = 're'"),
    "nested_index": (nested_index, f"WITH {TURNS} SELECT 'turns.$items.text' AS field, * FROM post"),
    "nested_first_elements": (nested_first_elements, f"WITH {TURNS} SELECT term, conv_id, min(elem) AS elem, arg_min(tf, elem) AS tf, arg_min(doc_len, elem) AS doc_len FROM post GROUP BY 1, 2"),
    "validate_props_json": (validate_props_json, "SELECT event_id, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND CAST(props->>'$.k' AS BIGINT) BETWEEN -2147483648 AND 2147483647 AS as_integer, json_type(props, '$.k') = 'DOUBLE' AS as_float, CAST(props->>'$.k' AS BIGINT) AS k FROM events"),
    "validate_rows": (validate_rows, "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id <= 2147483647 AND value IS NOT NULL AND props IS NOT NULL) AS n_valid FROM events GROUP BY 1"),
    "stream_ingest_postings": (stream_ingest_postings, f"WITH {TOKENS} SELECT term, df, {AVG} FROM stats"),
}
