"""Steps whose work must grow no faster than their input."""

import numpy as np
import pyarrow as pa
import pytest

from marginalia.config import Settings
from marginalia.operators import cells, ocr, topk, vector
from marginalia.plans import derive, search
from marginalia.plans.catalog import QUERIES
from marginalia.sources import parsers, tables


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_a_batch_do_not_meet_in_one_task(spark, no_broadcast):
    documents = spark.createDataFrame([("a", 0), ("b", 0), ("a", 1)], "document_id string, batch_id bigint")
    rows = spark.createDataFrame([("a", 0, 1), ("b", 0, 2), ("a", 1, 3), ("c", 7, 4)], "document_id string, batch_id bigint, n int")
    left = tables.current_rows(rows, documents)
    assert sorted(r["n"] for r in left.collect()) == [2, 3]
    # A shuffle on the batch alone is left only for the few rows of the batches themselves.
    assert plan(left).count("SortMergeJoin [batch_id") == 0 and "BroadcastHashJoin [batch_id" in plan(left)


def test_only_a_slice_of_a_batch_is_python_objects():
    rows = pa.array(['a,b\n"c"', None, ""] * 100)
    kind = pa.list_(pa.list_(pa.string()))
    assert parsers.in_slices(parsers.csv_records, kind, rows).to_pylist() == [parsers.csv_records(x) for x in rows.to_pylist()]
    assert parsers.in_slices(parsers.csv_records, kind, rows.slice(0, 0)).to_pylist() == []


def test_words_are_grouped_where_their_document_is(spark, sf_dir, no_broadcast):
    keys = ["document_id", "page_number"]
    rows = ocr.pages_from_lines(ocr.lines_from_words(derive.words(spark, sf_dir), keys), keys, "tesseract")
    assert plan(rows).count("Exchange ") == 1


def test_scores_equal_after_rounding_go_by_seq():
    best = topk._Best(1, 1, 12)
    for score, seq in ((0.5, 5), (0.5 - 1e-14, 3), (0.5 - 1e-9, 1)):
        best.add(np.array([[score]]), np.array([seq]), np.array([f"v{seq}"], object), 0.35)
    assert best.batch([7], pa.int64()).to_pylist() == [{"query_id": 7, "score": 0.5, "seq": 3, "id": "v3"}]


def test_vectors_are_searched_once(spark, monkeypatch):
    kept, keep = [], search.store.keep
    monkeypatch.setattr(search.store, "keep", lambda rows, path: kept.append(path) or keep(rows, path))
    evidence = spark.createDataFrame(
        [("a", "d1", "n", "s", "red fox", 1.0, 1), ("b", "d2", "n", "s", "blue whale", 1.0, 2)],
        "id string, document_id string, document_name string, section string, snippet string, retrieval_score double, seq bigint",
    )
    questions = spark.createDataFrame([(1, "fox"), (2, "whale")], "query_id bigint, query string")
    vectors = spark.createDataFrame([("a", 1, "d1", [1.0, 0.0])], "id string, seq bigint, document_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    found = search.search(search.retrieve(evidence, questions, vectors=vectors, query_vectors=asked, fields=("id",)))
    assert sorted((r["query_id"], r["id"]) for r in found.collect()) == [(1, "a"), (2, "b")]
    assert sum("/near-" in path for path in kept) == 1


def test_pairs_of_queries_and_blocks_carry_no_vectors(spark, tmp_path):
    rows = [(f"v{n}", n, "d", [float(n % 7), float(n % 5), 1.0]) for n in range(60)]
    vectors = spark.createDataFrame(rows, "id string, seq bigint, document_id string, embedding array<float>")
    cells.build_cells(vectors, str(tmp_path), cells=3)
    asked = vectors.filter("seq < 9").selectExpr("seq AS query_id", "embedding")
    assert cells.wanted_blocks(spark, str(tmp_path), asked).columns == ["query_id", "ask", "least", "cell", "block", "n"]


def test_queries_of_one_id_keep_their_own_hits(spark, tmp_path):
    rows = [(f"v{n}", n, "d", [float(n % 7), float(n % 5), 1.0]) for n in range(60)]
    vectors = spark.createDataFrame(rows, "id string, seq bigint, document_id string, embedding array<float>")
    cells.build_cells(vectors, str(tmp_path), cells=3)
    asked = spark.createDataFrame(
        [(1, [1.0, 2.0, 1.0]), (1, [0.0, 3.0, 1.0]), (2, [4.0, 0.0, 1.0]), (2, [4.0, 0.0, 1.0])], "query_id bigint, embedding array<float>"
    )
    want = vector.vector_search_batch(vectors, asked, min_similarity=0.0)
    got = cells.cell_search_batch(spark, str(tmp_path), asked, min_similarity=0.0)
    assert sorted(r[:4] for r in got.collect()) == sorted(r[:4] for r in want.collect())


def test_queries_above_the_bound_stay_a_table(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"v{n}", n, "d", rng.integers(0, 4, 3).astype(float).tolist()) for n in range(300)]
    vectors = spark.createDataFrame(rows, "id string, seq bigint, document_id string, embedding array<float>")
    asked = vectors.selectExpr("seq % 90 AS query_id", "embedding").repartition(3)
    want = vector.vector_search_batch(vectors, asked, min_similarity=0.5).collect()
    monkeypatch.setattr(vector, "GROUP", 100)
    read, collect = [], type(asked).collect
    monkeypatch.setattr(type(asked), "collect", lambda rows: read.append(collect(rows)) or read[-1])
    found = vector.vector_search_batch(vectors, asked, min_similarity=0.5, settings=Settings(queries_per_scan=16))
    # The driver reads no more queries than it takes to see that they are many.
    assert sum(map(len, read)) <= 17
    assert sorted(collect(found)) == sorted(want) and len({r["query_id"] for r in want}) == 90


def test_few_better_scores_are_merged_in_order():
    rng = np.random.default_rng(1)
    score, seq = rng.integers(0, 40, size=(20, 6000)) / 40, rng.permutation(6000)
    best, merged = topk._Best(20, 12, 12), []
    merge = best._merge
    best._merge = lambda *given: merged.append(1) or merge(*given)
    for start in range(0, 6000, 500):
        part = slice(start, start + 500)
        best.add(score[:, part], seq[part], np.array([f"v{s}" for s in seq[part]], object), 0.35)
    assert len(merged) > 5
    for q in range(20):
        order = np.lexsort((seq, -score[q]))[:12]
        assert best.seq[q].tolist() == seq[order].tolist() and best.id[q].tolist() == [f"v{s}" for s in seq[order]]


@pytest.mark.parametrize("name", ["search_results", "first_hits", "citation_pages"])
def test_texts_are_parsed_once(spark, sf_dir, monkeypatch, name):
    before = plan(derive.documents(spark, sf_dir)).count("FileScan")
    kept, keep = [], search.store.keep
    monkeypatch.setattr(search.store, "keep", lambda rows, path: kept.append(plan(rows)) or keep(rows, path))
    found = QUERIES[name](spark, sf_dir)
    assert sum("/documents.parquet" in line for text in [*kept, plan(found)] for line in text.split("\n") if "FileScan" in line) == before
