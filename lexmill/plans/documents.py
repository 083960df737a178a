"""Queries over texts: tokens, postings, statistics, search, fuzzy matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import index, search
from lexmill.plans.library import built, empty, raw

STOP = ("the", "of", "and", "in", "to", "le", "la", "de", "der", "die", "das")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shown(found: DataFrame, id_name: str = "doc_id") -> DataFrame:
    return found.select("rank", F.col("doc_id").alias(id_name), F.round("score", 6).alias("score"))


def of_text(text: str, fuzzy: bool = False, relax: bool = False, **options):
    """A search over the stored index."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(built(spark, sf_dir, "documents").search("documents", {"query": text, "query by": ["text"]}, fuzzy=fuzzy, relax=relax, **options))

    return run


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "documents").term_stats("documents")


def stored_postings(spark: SparkSession, sf_dir: str, *terms: str) -> DataFrame:
    """Postings of some terms; ids are dense from 0, but are taken from the documents all the same."""
    engine = built(spark, sf_dir, "documents")
    found = engine.postings("documents").filter(F.col("term").isin(*terms))
    return found.join(engine.documents("documents").select("seq_id", "doc_id"), "seq_id")


def tokenize_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tokens(docs(spark, sf_dir), "doc_id", "text").select("doc_id", "term", F.col("offset").alias("byte_at"), "doc_len")


def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.postings(docs(spark, sf_dir), "doc_id", "text")
    return found.select("term", F.col("seq_id").alias("doc_id"), "tf", "doc_len", F.element_at("offsets", 1).alias("first_at"), F.element_at("offsets", -1).alias("last_at"))


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection with all its tables, from nothing."""
    engine = empty(spark, "documents")
    engine.add_documents("documents", raw(spark, sf_dir, "documents"))
    return engine.list_collections().select("name", "doc_num")


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).select("term", "df", F.round("avg_doc_len", 6).alias("avg_doc_len"))


def dictionary_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.dictionary_size(stats(spark, sf_dir))


def dictionary_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.with_prefix(stats(spark, sf_dir), "text", "thi").select("term", "df")


def dictionary_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "documents").dictionary("documents")


def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lookup(stored_postings(spark, sf_dir, "thing"), "text", "thing").select("doc_id", "tf", "doc_len", F.element_at("offsets", 1).alias("first_at"), F.element_at("offsets", -1).alias("last_at"))


def corpus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(built(spark, sf_dir, "documents").describe("documents")["doc num"],)], "n long")


def phrase(slop: int):
    """Documents with both words, and how often the second follows within ``slop`` bytes of its place."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = stored_postings(spark, sf_dir, "thing", "and")
        pairs = found.groupBy("doc_id").agg(F.max(F.when(F.col("term") == "thing", F.col("offsets"))).alias("a"), F.max(F.when(F.col("term") == "and", F.col("offsets"))).alias("b")).filter("a is not null and b is not null")
        slots = F.array(F.struct(F.col("a").alias("offsets"), F.lit(0).cast("long").alias("q")), F.struct(F.col("b").alias("offsets"), F.lit(6).cast("long").alias("q")))
        return pairs.select("doc_id", search.phrase_count(slots, F.lit(slop)).cast("long").alias("phrases"))

    return run


def fuzzy(token: str, d: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stats(spark, sf_dir).filter(search.near(F.col("term"), token, True) & search.distance_is(F.col("term"), token, d)).select("term", "df")

    return run


def fuzzy_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).select("term", search.allowed(F.col("term")).alias("most"))


def phonetic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = built(spark, sf_dir, "documents").dictionary("documents").filter("code is not null")
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


def homophones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).filter(search.distance_is(F.col("term"), "être", 1)).select("term", "df")


def stop_words_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.terms(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.filter(words, lambda t: ~F.array_contains(T.stop_list(STOP), t))).cast("long").alias("n_kept"))


def numeric_sort_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = {"query": "thing", "query by": ["text"], "sort by": ["n_chars:desc"]}
    return shown(built(spark, sf_dir, "documents").search("documents", request, fuzzy=False, relax=False))


def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark passages as queries, with the documents that hold all words of each."""
    engine = built(spark, sf_dir, "documents")
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    hits = search.batch(engine.postings("documents"), engine.term_stats("documents"), engine.describe("documents")["doc num"], queries, "text", k=10)
    return hits.join(engine.documents("documents").select("seq_id", "doc_id"), "seq_id").select("query_id", "rank", "doc_id", F.round("bm25", 6).alias("bm25"))


TOKENS = """p AS (SELECT doc_id, strlen(text) AS doc_len, string_split_regex(text, '[ .|,:;&]') AS a FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, doc_len, unnest(a) AS term, generate_subscripts(a, 1) AS pos FROM p),
tok AS (SELECT * FROM (SELECT doc_id, doc_len, term, CAST(coalesce(sum(strlen(term) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_at FROM u) WHERE term <> ''),
post AS (SELECT term, doc_id, count(*) AS tf, any_value(doc_len) AS doc_len, min(byte_at) AS first_at, max(byte_at) AS last_at, list(byte_at ORDER BY byte_at) AS ats FROM tok GROUP BY term, doc_id),
stats AS (SELECT term, count(*) AS df, avg(doc_len) AS avg_doc_len FROM post GROUP BY term),
corpus AS (SELECT count(*) AS n FROM documents)"""


def bm25_sql(tf: str = "tf", df: str = "df", length: str = "doc_len", avg: str = "avg_doc_len", n: str = "n") -> str:
    return f"ln(greatest({n} - {df}, 0) + 0.5::double) / greatest({df} + 0.5::double, 20) * (1.2::double * {tf}) / ({tf} + 1.2::double * (1 - 0.75::double + 0.75::double * {length} / {avg}))"


def ranked_sql(hits: str, id_name: str = "doc_id") -> str:
    """Best 50 of ``hits(doc_id, s)``."""
    return f"SELECT CAST(row_number() OVER (ORDER BY s DESC, doc_id) AS INTEGER) AS rank, doc_id AS {id_name}, round(s, 6) AS score FROM ({hits}) ORDER BY s DESC, doc_id LIMIT 50"


def word_sql(term: str, part: str) -> str:
    return f"WITH {TOKENS} {ranked_sql(f'SELECT doc_id, 65536 * {part} * (1 + ln(1 + tf)) AS s FROM post JOIN stats USING (term), corpus WHERE term = {term!r}')}"


def pair_hits(a: str, b: str, q: int, slop: int, m: int = 2) -> str:
    """Hits of two words in this order in the query, the first one rarer or equal; q: bytes from the first to the second."""
    count = f"len(list_filter(x.ats, lambda p: len(list_filter(y.ats, lambda o: o - {q} BETWEEN p AND p + {slop})) > 0))"
    return f"SELECT x.doc_id, 65536 * (1 + ln(1 + {m} * {count})) * ({bm25_sql('x.tf', 'sx.df', 'x.doc_len', 'sx.avg_doc_len')} + {bm25_sql('y.tf', 'sy.df', 'y.doc_len', 'sy.avg_doc_len')}) AS s FROM post x JOIN post y ON x.doc_id = y.doc_id AND x.term = {a!r} AND y.term = {b!r} JOIN stats sx ON sx.term = x.term JOIN stats sy ON sy.term = y.term, corpus"


def phrase_sql(slop: int) -> str:
    return f"WITH {TOKENS} SELECT x.doc_id, CAST(len(list_filter(x.ats, lambda p: len(list_filter(y.ats, lambda o: o - 6 BETWEEN p AND p + {slop})) > 0)) AS BIGINT) AS phrases FROM post x JOIN post y ON x.doc_id = y.doc_id AND x.term = 'thing' AND y.term = 'and'"


def fuzzy_sql(token: str, d: int) -> str:
    return f"WITH {TOKENS} SELECT term, df FROM stats WHERE left(term, 1) = left('{token}', 1) AND levenshtein(term, '{token}') = {d}"


CODE = f"translate(term, '{T.MARKED}', '{T.PLAIN}')"

FUZZY_SEARCH = f"""WITH {TOKENS},
near AS (SELECT * FROM stats WHERE left(term, 1) = 't' AND levenshtein(term, 'there') = 1 ORDER BY df DESC, term LIMIT 10),
exact AS (SELECT count(*) AS c FROM post WHERE term = 'there')
{ranked_sql(f"SELECT doc_id, max(s) AS s FROM (SELECT doc_id, 65536 * {bm25_sql()} * (1 + ln(1 + tf)) AS s FROM post JOIN stats USING (term), corpus WHERE term = 'there' UNION ALL SELECT doc_id, 0.75::double * 4096 * {bm25_sql()} * (1 + ln(1 + tf)) AS s FROM post JOIN near USING (term), corpus, exact WHERE exact.c <= 50) GROUP BY doc_id")}"""

RELAX = f"""WITH {TOKENS},
wide AS (SELECT x.doc_id FROM post x JOIN post y ON x.doc_id = y.doc_id AND x.term = 'thing' AND y.term = 'and' JOIN post z ON z.doc_id = x.doc_id AND z.term = 'nicht'),
c AS (SELECT (SELECT count(*) FROM wide) AS c0, (SELECT count(*) FROM post x JOIN post y ON x.doc_id = y.doc_id AND x.term = 'thing' AND y.term = 'and') AS c1),
three AS (SELECT doc_id, sum({bm25_sql()}) AS part FROM post JOIN stats USING (term), corpus WHERE term IN ('thing', 'and', 'nicht') AND doc_id IN (FROM wide) GROUP BY doc_id),
ats AS (SELECT doc_id, max(CASE WHEN term = 'thing' THEN ats END) AS a, max(CASE WHEN term = 'and' THEN ats END) AS b, max(CASE WHEN term = 'nicht' THEN ats END) AS z FROM post WHERE term IN ('thing', 'and', 'nicht') GROUP BY doc_id),
l0 AS (SELECT three.doc_id, 65536 * part * (1 + ln(1 + 3 * len(list_filter(z, lambda p: len(list_filter(a, lambda o: o - p + 10 BETWEEN 0 AND 8)) > 0 AND len(list_filter(b, lambda o: o - p + 4 BETWEEN 0 AND 8)) > 0)))) AS s FROM three JOIN ats USING (doc_id)),
l1 AS ({pair_hits('thing', 'and', 6, 8)}),
l2 AS (SELECT doc_id, 65536 * {bm25_sql()} * (1 + ln(1 + tf)) AS s FROM post JOIN stats USING (term), corpus WHERE term = 'and')
{ranked_sql("SELECT doc_id, max(s) AS s FROM (FROM l0 UNION ALL SELECT l1.* FROM l1, c WHERE c0 <= 50 UNION ALL SELECT l2.* FROM l2, c WHERE c0 + c1 <= 50) GROUP BY doc_id")}"""

TFIDF = "(1 + ln(tf)) * ln(greatest(n // df, 1))"
AVG = "round(avg_doc_len, 6) AS avg_doc_len"

QUERIES = {
    "tokenize_offsets": (tokenize_offsets, f"WITH {TOKENS} SELECT doc_id, term, byte_at, doc_len FROM tok"),
    "postings_build": (postings_build, f"WITH {TOKENS} SELECT term, doc_id, tf, doc_len, first_at, last_at FROM post"),
    "index_build": (index_build, "SELECT 'documents' AS name, count(*) AS doc_num FROM documents"),
    "dictionary_dump": (dictionary_dump, f"WITH {TOKENS} SELECT 'text' AS field, term, df, CASE WHEN ascii(term) > 127 THEN {CODE} END AS code FROM stats"),
    "term_stats": (term_stats, f"WITH {TOKENS} SELECT term, df, {AVG} FROM stats"),
    "dictionary_size": (dictionary_size, f"WITH {TOKENS} SELECT 'text' AS field, count(*) AS terms FROM stats"),
    "dictionary_prefix": (dictionary_prefix, f"WITH {TOKENS} SELECT term, df FROM stats WHERE starts_with(term, 'thi')"),
    "term_lookup": (term_lookup, f"WITH {TOKENS} SELECT doc_id, tf, doc_len, first_at, last_at FROM post WHERE term = 'thing'"),
    "corpus_size": (corpus_size, "SELECT count(*) AS n FROM documents"),
    "search_word_bm25": (of_text("thing"), word_sql("thing", bm25_sql())),
    "search_word_tfidf": (of_text("thing", scorer="tfidf"), word_sql("thing", TFIDF)),
    "search_and": (of_text("thing and"), f"WITH {TOKENS} {ranked_sql(pair_hits('thing', 'and', 6, 8))}"),
    "search_phrase_exact": (phrase(0), phrase_sql(0)),
    "search_phrase_slop": (phrase(8), phrase_sql(8)),
    "fuzzy_d1": (fuzzy("ention", 1), fuzzy_sql("ention", 1)),
    "fuzzy_d2": (fuzzy("tioning", 2), fuzzy_sql("tioning", 2)),
    "fuzzy_allowed": (fuzzy_allowed, f"WITH {TOKENS} SELECT term, CASE WHEN strlen(term) <= 3 THEN 0 WHEN strlen(term) <= 6 THEN 1 ELSE 2 END AS most FROM stats"),
    "fuzzy_search": (of_text("there", fuzzy=True, relax=True), FUZZY_SEARCH),
    "relax_drop_token": (of_text("thing and nicht", relax=True), RELAX),
    "phonetic_groups": (phonetic_groups, f"WITH {TOKENS} SELECT {CODE} AS code, count(*) AS terms, min(term) AS first_term, max(term) AS last_term FROM stats WHERE ascii(term) > 127 GROUP BY 1"),
    "phonetic_homophones": (homophones, f"WITH {TOKENS} SELECT term, df FROM stats WHERE ascii(term) > 127 AND term <> 'être' AND {CODE} = 'etre'"),
    "stop_words_filter": (stop_words_filter, f"WITH {TOKENS} SELECT doc_id, count(tok.term) AS n_tokens, count(tok.term) FILTER (WHERE term NOT IN {STOP}) AS n_kept FROM documents LEFT JOIN tok USING (doc_id) GROUP BY doc_id"),
    "numeric_sort_lookup": (numeric_sort_lookup, f"WITH {TOKENS}, h AS (SELECT doc_id, n_chars, {bm25_sql()} AS b FROM post JOIN stats USING (term) JOIN documents USING (doc_id), corpus WHERE term = 'thing') SELECT CAST(row_number() OVER (ORDER BY n_chars DESC, b * (1 + ln(1 + (SELECT tf FROM post p WHERE p.doc_id = h.doc_id AND p.term = 'thing'))) DESC, doc_id) AS INTEGER) AS rank, doc_id, CAST(n_chars AS DOUBLE) AS score FROM h ORDER BY rank LIMIT 50"),
    "batch_search": (
        batch_search,
        f"WITH {TOKENS}, w AS (SELECT DISTINCT item_id AS query_id, unnest(string_split_regex(text, '[ .|,:;&]')) AS term FROM benchmark), v AS (SELECT * FROM w WHERE term <> ''), k AS (SELECT query_id, count(*) AS want FROM v GROUP BY 1), h AS (SELECT query_id, doc_id, sum({bm25_sql()}) AS s, count(*) AS got, any_value(want) AS want FROM v JOIN k USING (query_id) JOIN post USING (term) JOIN stats USING (term), corpus GROUP BY 1, 2) SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS INTEGER) AS rank, doc_id, round(s, 6) AS bm25 FROM h WHERE got = want) WHERE rank <= 10",
    ),
}
