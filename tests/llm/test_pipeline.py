"""The pipeline stage by stage, and the registered queries' columns."""

import pytest

import __spark_entry__
import corpus_pipeline
from lexmill.llm import neardup, rules, secrets

from .conftest import SCHEMA, prose
from .test_corpus import brute_lines

CONTRACT = {
    2: "doc_id held_out score predicted",
    3: "doc_id n_assign n_access n_hex base_sha256 spans",
    5: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    6: "doc_id n_tokens ids_sha256 decoded_sha256",
    7: "query_id rank vec_id score",
    8: "doc_id n_words n_base first_word last_word base_labels labels score",
}


def test_every_operator_is_registered():
    names = [x for x in __spark_entry__.queries() if x.startswith("op")]
    assert [x.split("_")[0] for x in names] == [f"op{n}" for n in range(1, 11)] and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("n", [2, 3, 5, 6, 7, 8])
def test_columns(spark, tiny, n):
    """The queries that do their work only when their rows are asked for; the others' columns are read in the tests of their operators."""
    name = next(x for x in __spark_entry__.queries() if x.startswith(f"op{n}_"))
    assert set(CONTRACT[n].split()) <= set(__spark_entry__.queries()[name](spark, tiny).columns)


def test_stages(spark, tiny):
    """Each stage against brute force over all that its predecessor kept."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.cut(stage(spark, docs, tiny))
        assert docs.columns == names
        after = {r["doc_id"]: r for r in docs.collect()}
        if name == "line_dedup":
            lost = {i: g for i, _, g, _ in brute_lines(before.items())}
            assert all(after[i]["text"] == before[i] for i, g in lost.items() if not g)
            whole = lambda t: [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
            for i, g in lost.items():
                left = len(whole(before[i])) - g
                assert (i in after) == (left > 0 or not g)
                assert i not in after or len(whole(after[i]["text"])) == left
        if name == "near_dedup":
            assert set(after) == {i for i, _, _, kept in neardup.brute_force(list(before.items()), percent=corpus_pipeline.NEAR) if kept}
        if name == "secret_scan":
            assert {i: r["text"] for i, r in after.items()} == {i: secrets.redact_text(t) for i, t in before.items()}
            assert not any(secrets.base_spans(r["text"]) for r in after.values())
        if name == "quality_rules":
            assert 0 < len(after) < len(before) and all(before[i] == r["text"] for i, r in after.items())
            # What fails the base rules goes; the method's verdicts are those of the operator.
            failed = {i for i, t in before.items() if rules.brute_force(t)[5]}
            assert not failed & set(after)
    assert corpus_pipeline.queries()["pipeline"] is corpus_pipeline.run
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, tiny)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.collect()}


def near_dedup(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)
    return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)


def test_near_dedup_keeps_null_ids(spark):
    """Documents without an id are told apart by their texts."""
    kept = [(None, prose(1, 60)), (None, prose(2, 60)), (None, None), (3, prose(3, 60)), (5, prose(5, 60)), (5, prose(6, 60))]
    assert near_dedup(spark, [*kept, (4, prose(3, 60)), (6, prose(2, 60))]) == sorted(kept, key=str)


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    """Rows of one id and text count once, blank ones and those without an id too."""
    kept = [(None, prose(1, 60)), (None, None), (3, prose(3, 60)), (4, ""), (5, "  ")]
    assert near_dedup(spark, [*kept, *kept, *kept]) == sorted(kept, key=str)


def test_pipeline_of_odd_rows(spark, clashing, tiny):
    """Null ids, nulls in any column, repeated rows and columns of other names go through all stages; rows are counted, not ids."""
    from pyspark.sql import functions as F

    odd = spark.createDataFrame([(None, prose(3, 60), None, None, None), (None, prose(3, 60), None, None, None), (None, None, None, None, None)], SCHEMA)
    docs = clashing.unionByName(odd, allowMissingColumns=True)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, tiny))
        assert docs.columns == names
        if name == "near_dedup":
            assert docs.groupBy("doc_id", "text").count().filter("count > 1").count() == 0
            assert docs.filter(F.col("doc_id").isNull() & (F.col("text") == prose(3, 60))).count() == 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, tiny)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_empty_documents(spark, empty, tiny):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, tiny))
    assert docs.count() == 0
