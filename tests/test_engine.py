"""Collections end to end, suggestions, streaming, and registered queries against their SQL."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill import api
from lexmill.api import Engine
from lexmill.errors import Conflict, InvalidFormat, NotAuthorized, NotFound
from lexmill.functions import cut
from lexmill.functions import text as T
from lexmill.functions.segment import Segmenter
from lexmill.model import SuggestConfig
from lexmill.operators import index, search, suggest
from lexmill.streaming.ingest import ingest

DISH = {
    "name": "dishes",
    "schema": {
        "$fields": {
            "title": {"type": "string", "index": True, "suggest": True},
            "rank": {"type": "integer", "sort_field": True},
            "score": {"type": "float"},
            "parts": {"type": "array", "$items": {"type": "object", "$fields": {"name": {"type": "string", "index": True}}}},
        }
    },
    "auto_suggestion": {"entry_num": 5, "min_gram": 2, "max_gram": 15},
}


def dish(i, title, rank, *parts):
    return {"id": i, "title": title, "rank": rank, "score": rank + 0.5, "parts": [{"name": p} for p in parts], "extra": [i]}


DOCS = [dish(10, "red fish soup", 3, "red fish", "water"), dish(11, "fish pie", 1, "fish", "flour"), dish(12, "apple pie", 2, "apple", "flour"), dish(13, "red apple cake with fish", 2, "apple")]


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.create_collection(DISH)
    e.add_documents("dishes", json.dumps({"docs": DOCS}))
    return e


def test_collections(engine):
    with pytest.raises(Conflict):
        engine.create_collection(DISH)
    assert engine.describe("dishes")["doc num"] == 4
    assert [tuple(r)[::2] for r in engine.list_collections().collect()] == [("dishes", 4)]
    engine.drop_collection("dishes")
    with pytest.raises(NotFound):
        engine.describe("dishes")


def test_documents_are_added_found_and_removed(engine):
    assert engine.get_document("dishes", 11)["extra"] == [11]
    assert engine.get_document("dishes", 2, seq=True)["id"] == 12
    with pytest.raises(Conflict):
        engine.add_documents("dishes", json.dumps(DOCS[0]))
    with pytest.raises(InvalidFormat):
        engine.add_documents("dishes", json.dumps(dish(20, "x", 1) | {"score": 3}))
    with pytest.raises(InvalidFormat):
        engine.add_documents("dishes", json.dumps({"docs": [dish(21, "new one", 1), dish(22, "bad", 1) | {"rank": "x"}, dish(23, "late", 1)]}), on_error="prefix")
    assert engine.contains("dishes", 21) and not engine.contains("dishes", 23)
    engine.remove_documents("dishes", [21, 11])
    with pytest.raises(NotFound):
        engine.get_document("dishes", 11)
    with pytest.raises(NotFound):
        engine.remove_documents("dishes", [11])
    assert [r["doc_id"] for r in engine.search("dishes", {"query": "pie", "query by": ["title"]}).collect()] == [12]
    assert engine.add_documents("dishes", ["{\"id\": 30, \"title\": \"a b\",", " \"rank\": 1, \"score\": 1.0, \"parts\": []}"]) == 1
    assert engine.get_document("dishes", 5, seq=True)["id"] == 30


def test_search_fields_sort_and_errors(engine):
    found = engine.search("dishes", {"query": "fish", "query by": ["title", "parts.$items.name"], "boost": [5, 1]}).collect()
    assert {r["doc_id"] for r in found} == {10, 11, 13} and [r["rank"] for r in found] == [1, 2, 3]
    found = engine.search("dishes", {"query": "fish", "query by": ["title"], "sort by": ["rank:asc"]}).collect()
    assert [(r["doc_id"], r["score"]) for r in found] == [(11, -1.0), (13, -2.0), (10, -3.0)]
    out = json.loads(engine.search_json("dishes", {"query": "red fish", "query by": ["title"]}))
    assert out["found"] == len(out["hits"]) and out["hits"][0]["seq id"] == 0
    assert engine.search("dishes", {"query": " , ", "query by": ["title"]}).count() == 0
    for bad in ({"query": "a", "query by": ["rank"]}, {"query": "a", "query by": ["none"]}, {"query": "a", "query by": ["title"], "sort by": ["title:asc"]}):
        with pytest.raises(InvalidFormat):
            engine.search("dishes", bad)


def test_misspelt_words_are_found(engine):
    assert {r["doc_id"] for r in engine.search("dishes", {"query": "appla", "query by": ["title"]}).collect()} == {12, 13}


def test_suggestions_need_the_setting(engine):
    assert [r["segment"] for r in engine.suggest("dishes", "fi").collect()] == ["fish"]
    engine.create_collection({"name": "plain", "schema": {"$fields": {"t": {"type": "string", "index": True}}}})
    with pytest.raises(NotAuthorized):
        engine.suggest("plain", "fi")
    with pytest.raises(InvalidFormat):
        engine.create_collection({"name": "bad", "schema": {"$fields": {"t": {"type": "string", "index": True, "suggest": True}}}})


def test_suggestion_order(spark):
    log = "elk elm elf elk elf elk elder eland elbow".split()
    rows = spark.createDataFrame(list(enumerate(log)), "n long, q string")
    top = suggest.best(suggest.frequencies(suggest.segments(rows, "q", "n")), SuggestConfig(5, 2, 15))
    got = [r["segment"] for r in suggest.lookup(top, "el").collect()]
    assert got == ["elk", "elf", "elbow", "eland", "elder"]
    assert suggest.lookup(top, "e").count() == 0


def test_edge_ngrams(spark):
    df = spark.createDataFrame([("a",), ("",), ("abcd",), ("éèê",)], "t string")
    assert [r[0] for r in df.select(T.edge_ngrams(df["t"], 2, 4)).collect()] == [["a"], [""], ["ab", "abc"], ["éè", "éèê"]]


def test_tokens_keep_case_and_line_breaks(spark):
    df = spark.createDataFrame([(1, "Ab é,\nab|ab;"), (2, None), (3, "")], "i long, t string")
    got = sorted((r["term"], r["offset"]) for r in T.tokens(df, "i", "t").collect())
    assert got == [("\nab", 6), ("Ab", 0), ("ab", 10), ("é", 3)]
    few = index.postings(df, "i", "t").filter("term in ('ab', 'é')").collect()
    assert {(r["term"], tuple(r["offsets"])) for r in few} == {("ab", (10,)), ("é", (3,))}


ODD = ["", " ", "a", ".a", "a.", "a..é b", "\n", "x" * 70_000 + " y", None, "é,é;é", "a a|a&b:b"]


def moved(df):
    """The steps of a plan that move or sort rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [step for step in ("Exchange", "Sort") if step in plan]


def test_texts_are_cut_in_their_place(spark):
    """Tokens need no exchange and no sort, and stand where they did: odd texts, null and struct ids, more than one slice of texts."""
    df = spark.createDataFrame([(None if i == 7 else i, (i, i % 2), t) for i, t in enumerate(ODD * 70)], "i long, key struct<a:long,b:int>, t string").coalesce(1)
    assert moved(T.tokens(df, "i", "t")) == []
    want = sorted((i, p, at, len(t.encode())) for i, t in enumerate(ODD * 70) if t for p, ats in T.query_terms(t) for at in ats)
    got = T.tokens(df, "key", "t")
    assert got.columns == ["key", "term", "offset", "doc_len"] and got.schema["key"].dataType == df.schema["key"].dataType
    assert sorted((r["key"]["a"], *r[1:]) for r in got.collect()) == want
    assert {r["term"] for r in T.tokens(df, "i", "t").filter("i is null").collect()} == {"x" * 70_000, "y"}


def test_postings_are_found_within_their_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 70)], "i long, t string").coalesce(1)
    found = index.postings(df, "i", "t")
    assert moved(found) == []
    want = sorted((p, i, len(ats), len(t.encode()), tuple(ats)) for i, t in enumerate(ODD * 70) if t for p, ats in T.query_terms(t))
    assert sorted((r["term"], r["seq_id"], r["tf"], r["doc_len"], tuple(r["offsets"])) for r in found.collect()) == want


def test_statistics_of_parts_add_up(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    whole = index.stats_of_texts(docs, "text")
    merged = index.merge_stats(*(index.stats_of_texts(docs.filter(f"doc_id % 2 = {k}"), "text").drop("avg_doc_len") for k in (0, 1)))
    assert sorted(map(tuple, whole.select("term", "df", "sum_len").collect())) == sorted(map(tuple, merged.select("term", "df", "sum_len").collect()))


def test_batch_ties_of_sums_go_to_the_earlier_document(spark):
    """Documents of equal scores up to the last bits of the sums, in which the later one is ahead."""
    parts = {("a", 0): 0.1, ("b", 0): 0.2, ("c", 0): 0.3, ("a", 1): 0.30000000000000004, ("b", 1): 0.2, ("c", 1): 0.1 + 2e-16}
    found = spark.createDataFrame([("t", w, d, i + 1, 10) for i, (w, d) in enumerate(parts)], "field string, term string, seq_id long, tf long, doc_len long")
    stats = spark.createDataFrame([("t", w, 2, 10.0) for w in "abc"], "field string, term string, df long, avg_doc_len double")
    queries = spark.createDataFrame([(1, "a b c")], "query_id long, text string")
    values = list(parts.values())
    assert sum(values[3:]) > sum(values[:3])

    def scorer(tf, df, doc_len, avg_doc_len, n_docs):
        return F.element_at(F.array(*map(F.lit, values)), tf.cast("int"))

    got = search.batch(found, stats, 2, queries, "t", scorer).orderBy("rank").collect()
    assert [r["seq_id"] for r in got] == [0, 1]


def test_stream_equals_batch(spark, engine, tmp_path):
    for k, d in enumerate([*DOCS, DOCS[0], {"id": 99}]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(d))
    engine.create_collection(DISH | {"name": "live"})
    stream = spark.readStream.option("maxFilesPerTrigger", 2).text(str(tmp_path / "in")).withColumnRenamed("value", "_raw")
    ingest(engine, "live", stream, str(tmp_path / "progress"))
    ask = {"query": "fish", "query by": ["title"]}
    score = lambda c: {r["doc_id"]: round(r["bm25"], 9) for r in engine.search(c, ask).collect()}
    assert score("live") == score("dishes")
    engine.rebuild("live")
    assert score("live") == score("dishes")


def test_chinese_collection(spark, tmp_path):
    cut = Segmenter({"红烧": 50, "红烧肉": 20, "好吃": 30, "的": 200, "鱼": 40}, stop_words=["的"])
    e = Engine(spark, f"file://{tmp_path}/store", {"jieba": cut})
    e.create_collection({"name": "c", "tokenizer": "jieba", "schema": {"$fields": {"t": {"type": "string", "index": True}}}})
    e.add_documents("c", json.dumps({"docs": [{"id": 1, "t": "好吃的红烧肉"}, {"id": 2, "t": "红烧鱼"}]}))
    assert {r["doc_id"] for r in e.search("c", {"query": "红烧", "query by": ["t"]}).collect()} == {1, 2}


def test_additions_touch_no_other_segment(engine):
    """What was written stays as it is; statistics, search and suggestions follow from all segments, less what was removed."""
    store = engine.store
    before = store.current("dishes")
    files = lambda: {f for t in before["segments"] for k in store.files(store.folder("dishes", t)) for f in store.files(f"{store.folder('dishes', t)}/{k}")}
    old = files()
    engine.add_documents("dishes", json.dumps(dish(40, "fish fish stew", 5, "fish")))
    after = store.current("dishes")
    assert files() == old and after["segments"][:-1] == before["segments"] and after["number"] == before["number"] + 1
    stats = lambda: {(r["field"], r["term"]): (r["df"], r["sum_len"]) for r in engine.term_stats("dishes").collect()}
    summed = stats()
    assert summed["title", "fish"][0] == 4 and engine.suggest("dishes", "fi").first()["freq"] == 4
    engine.remove_documents("dishes", [40, 11])
    less = stats()
    assert less["title", "fish"][0] == 2 and ("title", "stew") not in less and engine.suggest("dishes", "st").count() == 0
    found = lambda: [(r["doc_id"], round(r["bm25"], 9)) for r in engine.search("dishes", {"query": "fish", "query by": ["title"]}).collect()]
    parted = found()
    engine.rebuild("dishes")
    assert found() == parted and stats() == less and len(store.current("dishes")["segments"]) == 1
    assert [(r["seq_id"], r["doc_id"]) for r in engine.scan("dishes").collect()] == [(0, 10), (2, 12), (3, 13)]
    engine.add_documents("dishes", json.dumps(dish(11, "fish pie", 1)))
    assert engine.get_document("dishes", 5, seq=True)["id"] == 11


def test_readers_keep_their_version_and_writers_do_not_overwrite(engine):
    """A version is one file that comes into place whole; an older one stays; the later of two writers is refused."""
    base = engine.store.current("dishes")
    seen = engine.documents("dishes", base)
    engine.add_documents("dishes", json.dumps(dish(50, "late", 1)))
    assert seen.count() == 4 and engine.documents("dishes").count() == 5 and engine.store.current("dishes")["doc_num"] == 5
    with pytest.raises(Conflict):
        engine.store.publish("dishes", base, doc_num=0)
    assert engine.store.current("dishes")["doc_num"] == 5
    # A draft that a writer left behind is no version.
    fs, p, _ = engine.store._fs(f"{engine.store.root}/dishes/versions/000000000009.json.x.draft")
    fs.create(p, False).close()
    assert engine.store.current("dishes")["doc_num"] == 5


@pytest.mark.parametrize("case", ["ordered", "runs", "shuffled", "negative"])
def test_documents_are_numbered_in_order_by_one_move_at_most(spark, tmp_path, monkeypatch, case):
    """Rows in runs of the order are numbered where they stand; others are moved once; the numbers are those of the order."""
    monkeypatch.setattr(api, "PART_BYTES", 64)
    keys = [5 * i - (700 if case == "negative" else 0) for i in range(300)]
    if case == "runs":
        keys = keys[200:] + keys[:90] + keys[90:200]
    elif case != "ordered":
        keys = keys[::7] + [k for i, k in enumerate(keys) if i % 7]
    path = f"{tmp_path}/rows"
    spark.createDataFrame([(k, i, f"row {k}") for i, k in enumerate(keys)], "_ordinal long, doc_id long, _raw string").repartition(3, F.col("_ordinal") >= 800).sortWithinPartitions("doc_id").write.parquet(path)
    found = api.numbered(spark.read.parquet(path), "_ordinal", "doc_id", 10)
    assert ("Exchange RoundRobin" in found._jdf.queryExecution().toString() or "REPARTITION" in found._jdf.queryExecution().toString()) == (case not in ("ordered", "runs"))
    assert sorted(tuple(r) for r in found.select("seq_id", "_ordinal", "_raw").collect()) == [(10 + i, k, f"row {k}") for i, k in enumerate(sorted(keys))]


def test_postings_are_packed_and_unpacked(spark):
    """Elements, numbers far apart and out of order, several rows of texts a slice: what is unpacked is what was packed."""
    rows = [(s, e, t) for s in (5, 1 << 40, 3, 0, 1 << 31) for e, t in enumerate(ODD * (3 if s == 3 else 1))]
    df = spark.createDataFrame([((s, e), t) for s, e, t in rows], "_key struct<seq_id:long,elem:int>, t string").coalesce(1)
    got = cut.unpacked(cut.packed(df, "_key", "t").withColumn("field", F.lit("t"))).collect()
    want = sorted(("t", p, s, e, len(ats), len(t.encode()), tuple(ats)) for s, e, t in rows if t for p, ats in T.query_terms(t))
    assert sorted((*r[:6], tuple(r["offsets"])) for r in got) == want


def test_found_documents_are_not_moved_nor_the_others_read(engine):
    found = engine.search("dishes", {"query": "fish", "query by": ["title"]})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(seq_id" not in plan and "PushedFilters: [In(seq_id" in plan.replace("IsNotNull(seq_id), ", "")


def test_a_rebuilt_segment_keeps_its_order(engine):
    """One segment with removals is merged by leaving rows out; all its tables equal those derived from its documents."""
    engine.remove_documents("dishes", [12])
    tables = lambda: [sorted(map(repr, t.collect())) for t in (engine.postings("dishes"), engine.term_stats("dishes"), engine.documents("dishes"), engine.dictionary("dishes"))]
    before = tables()
    engine.rebuild("dishes")
    assert tables() == before and engine.store.current("dishes")["removals"] == []
    terms = [r["term"] for r in engine.postings("dishes").filter("field = 'title'").select("term").collect()]
    assert "apple" in terms and engine.search("dishes", {"query": "pie", "query by": ["title"]}, fuzzy=False).count() == 1


QUERIES = ["search_word_tfidf", "search_and", "search_phrase_slop", "relax_drop_token", "fuzzy_search", "suggest_topk", "suggest_lookup", "nested_first_elements", "validate_props_json", "phonetic_groups", "batch_search"]
FACADE = ["engine_remove", "engine_search", "add_batch_conflicts", "doc_to_json", "search_json", "engine_errors", "config_flat", "segment_terms", "sound_search", "json_chunks"]


@pytest.mark.parametrize("name", QUERIES + FACADE)
def test_query_equals_sql(spark, tiny, name):
    import duckdb

    from lexmill.plans import registry

    base = duckdb.connect()
    for t in ("documents", "part", "conversations", "events", "benchmark"):
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    found = registry.queries()[name](spark, tiny)
    columns = sorted(found.columns)
    want = base.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = [tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall()]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in found.collect()))) == sorted(map(repr, rows))
