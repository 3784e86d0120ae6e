"""Every operator over the edge cases and over empty tables: no crash, a row for each row, defined values."""

import corpus_pipeline
import pytest
from cases import EDGES, SCHEMA, story

from siloflow.llm import compaction, decontam, htmltext, langid, licenses, mixing, neardup, pii, quality, secretscan


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, story(7)[:200]), (2, None), (3, ""), (4, "word"), (1, story(7)[:200])], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (7, 1), (None, 1), (8, None)], "doc_id long, quality int")


def ids(rows):
    return sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows)


ALL = sorted(-1 if r[0] is None else r[0] for r in EDGES)
PER_ROW = {
    "op1": lambda d, b, q: langid.op1(d),
    "op3": lambda d, b, q: secretscan.op3(d),
    "op4": lambda d, b, q: compaction.op4(d),
    "op5": lambda d, b, q: licenses.op5(d),
    "op6": lambda d, b, q: pii.op6(d),
    "op7": lambda d, b, q: quality.op7(d, q),
    "op8": lambda d, b, q: neardup.op8(d),
    "op10": lambda d, b, q: mixing.op10(d),
}


@pytest.mark.parametrize("op", PER_ROW)
def test_a_row_for_each_row(op, docs, bench, labels):
    assert ids(PER_ROW[op](docs, bench, labels).collect()) == ALL


@pytest.mark.parametrize("op", PER_ROW)
def test_empty_table(op, empty, bench, labels):
    got = PER_ROW[op](empty, bench, labels)
    assert got.columns and got.collect() == []


def test_no_letter_is_undetermined(docs):
    got = {r["doc_id"]: r for r in langid.op1(docs).collect()}
    for i in (1, 2, 3, 4):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[None]["held_out"] is False


def test_sets_of_edge_documents(docs):
    got = neardup.op8(docs).collect()
    by_id = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3):
        assert by_id[i]["n_shingles"] == 0 and by_id[i]["component_id"] == i and by_id[i]["kept"]
    assert by_id[5]["n_shingles"] == 1
    assert by_id[10]["component_id"] == 7 and not by_id[10]["kept"]


def test_one_of_each_group_stays(docs):
    left = neardup.keep_one(docs).collect()
    assert ids(left) == sorted([-1, 1, 2, 3, 4, 5, 7, 8, 9])


def test_containment_of_short_and_repeated_items(docs, bench):
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op2(docs, bench).collect()}
    assert got == {(7, 1), (10, 1), (5, 4)}
    left = decontam.clean(docs, bench).collect()
    assert ids(left) == sorted([-1, 1, 2, 3, 4, 8, 9])


def test_empty_benchmark(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.op2(docs, none).collect() == []
    assert ids(decontam.clean(docs, none).collect()) == ALL


def test_empty_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "no tags < here")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in htmltext.op9(pages).collect()}
    assert got == {1: ("", 0), 2: ("", 0), None: ("no tags < here", 14)}
    assert htmltext.op9(pages.limit(0)).collect() == []


def test_foreign_columns_are_kept(docs, bench):
    odd = docs.selectExpr("*", "1 AS size", "'x' AS target", "2 AS epochs", "'y' AS lang_pred", "3 AS component_id", "'z' AS _h")
    for left in (decontam.clean(odd, bench), neardup.keep_one(odd), mixing.repeat(odd)):
        assert left.columns == odd.columns and {r["lang_pred"] for r in left.collect()} == {"y"}
    assert {r["lang_pred"] for r in corpus_pipeline.language_id(odd.sparkSession, odd, "").collect()} == {"y"}
    assert pii.redact(odd).columns == odd.columns


def test_columns_of_the_results_names_are_replaced(spark):
    odd = spark.createDataFrame([(1, "token = abcdefgh1", "x", "y", "z", 5)], "doc_id long, text string, lang_pred string, lang_score string, spans string, n_chars int")
    assert secretscan.scan(odd).first()["spans"].startswith("assign:") and secretscan.redact(odd).columns == odd.columns
    assert langid.identify(odd, langid.fit(odd.withColumn("lang", odd["lang_pred"]))).first()["lang_pred"] == "x"
    got = htmltext.extract(odd, "text").first()
    assert got["text"] == "token = abcdefgh1" and got["n_chars"] == 17 and got["spans"] == "z"
