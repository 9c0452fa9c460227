"""The physical plans that the scale of the corpus depends on."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import keyword, library, summarize, topk
from marginalia.operators.chunking import evidence_rows
from marginalia.operators.vector import vector_search
from marginalia.plans import derive
from marginalia.plans.search import keyword_retrieve, retrieve
from marginalia.sources import formats as fm


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """Evidence as a stored table, the way searches meet it."""
    path = str(tmp_path_factory.mktemp("evidence") / "rows")
    derive.budget_evidence(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def test_evidence_needs_no_shuffle(spark, sf_dir):
    rows = derive.table(spark, sf_dir, "documents", "doc_id", "text", "source")
    built = evidence_rows(derive._unpacked(derive._parsed(rows, F.col("text"))))
    text = plan(built)
    assert "Exchange" not in text and "Window" not in text and "Python" not in text and "Arrow" not in text


def test_summaries_stay_in_the_row(spark, sf_dir):
    rows = derive.table(spark, sf_dir, "documents", "doc_id", "text", "source")
    text = plan(rows.select("doc_id", summarize.extractive_summary(F.col("text")).alias("s")))
    assert "Exchange" not in text and "Arrow" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_single_search_is_a_top_k_over_one_scan(stored):
    text = plan(keyword.keyword_search(stored, "content falcon"))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text and text.count("FileScan") == 1


def test_scope_reaches_the_scan(stored):
    text = plan(keyword_retrieve(stored, "content", ["doc_1", "doc_2"], prefilter=True))
    assert "PushedFilters: [In(document_id, [doc_1,doc_2])" in text


def test_vector_scope_and_columns_reach_the_scan(spark, stored, tmp_path):
    stored.select("id", "seq", "document_id", "snippet", F.array(F.lit(1.0)).alias("embedding")).write.parquet(str(tmp_path / "v"))
    vectors = spark.read.parquet(str(tmp_path / "v"))
    text = plan(vector_search(vectors, [1.0], scope=["doc_1"]))
    assert "EqualTo(document_id,doc_1)" in text or "In(document_id" in text
    assert "snippet" not in text.rpartition("ReadSchema")[2]
    assert "MapInArrow" in text and "WindowGroupLimit" in text


def test_batch_search_never_pairs_queries_with_rows(spark, sf_dir, stored):
    queries = derive.questions(spark, sf_dir)
    text = plan(keyword.keyword_search_batch(stored, queries))
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text and text.count("MapInArrow") == 1
    # Tasks trim their hits before the only shuffle of them.
    assert "WindowGroupLimit" in text


def test_hits_are_found_once_and_pick_the_evidence(spark, sf_dir, stored):
    text = plan(retrieve(stored, derive.questions(spark, sf_dir)))
    assert "LeftSemi" in text and "MapInArrow" not in text and "CartesianProduct" not in text


def test_dedupe_trims_hot_keys_before_the_shuffle(stored):
    from marginalia.plans.search import dedupe_hits

    text = plan(dedupe_hits(stored.select("id", "seq", "snippet"), order="seq"))
    partial, exchange = text.rfind("WindowGroupLimit"), text.rfind("Exchange")
    assert text.count("WindowGroupLimit") == 2 and exchange < partial


def test_every_task_returns_at_most_k_rows_per_query(spark):
    rows = spark.range(20_000, numPartitions=7).select(
        F.concat(F.lit("ev_"), F.col("id").cast("string")).alias("id"), F.col("id").alias("seq"),
        F.lit("all the same words").alias("snippet_lower"), F.lit("name").alias("label_lower"),
    )
    lists = [["same"], ["words", "name"], ["none"]]
    hits = topk.best_per_task(rows, lambda: keyword._term_scorer(lists), [0, 1, 2], 12, 1.0, "int")
    assert hits.count() == 7 * 2 * 12
    best = topk.top_k_per(hits, "query_id", [F.col("score").desc(), F.col("seq")], 12)
    assert sorted(r.seq for r in best.filter("query_id = 1").collect()) == list(range(12))


def test_lists_read_one_page(stored):
    rows = stored.select("id", F.lit("ready").alias("status"), F.col("seq").alias("doc_seq"))
    assert "TakeOrderedAndProject" in plan(library.list_documents(rows, "ready"))


def test_plain_text_stays_out_of_python(spark):
    rows = spark.createDataFrame([(bytearray(b"x"),)], "payload binary")
    text = plan(rows.select(fm.parse_plain_text(fm.decode(F.col("payload"))).alias("p")))
    assert "Arrow" not in text and "Python" not in text


def test_oversized_files_are_never_opened(spark, tmp_path):
    from marginalia.plans.ingest import read_files

    (tmp_path / "a.txt").write_text("x")
    accepted, _ = fm.admit(read_files(spark, str(tmp_path)))
    assert "LessThanOrEqual(length,52428800)" in plan(accepted)
