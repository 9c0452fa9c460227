"""The stored index and the versioned store."""

import pytest
from pyspark.sql import functions as F
from test_search import evidence

from marginalia.operators import keyword, postings
from marginalia.plans import derive
from marginalia.sources import store
from marginalia.streaming import ingest as stream


def corpus(spark, sf_dir, root):
    stream.store_batch(root)(derive.parsed_documents(spark, sf_dir), 0)
    postings.write_index(stream.current_evidence(spark, root), root, 0)
    return postings.read_index(spark, root, stream.DOCUMENT_COLUMNS)


def bag(rows):
    return sorted(map(tuple, rows.collect()), key=repr)


@pytest.mark.parametrize("limit", [3, 12])
def test_pruned_search_equals_the_full_scan(spark, sf_dir, tmp_path, limit):
    index = corpus(spark, sf_dir, str(tmp_path))
    asked = derive.questions(spark, sf_dir)
    want = bag(keyword.keyword_search_batch(derive.evidence(spark, sf_dir), asked, limit))
    hits, work = postings.pruned_search(index, asked, f"{tmp_path}/search", limit)
    assert bag(hits) == want
    assert bag(postings.index_search(index, asked, limit)) == want
    every, taken, completed = (x.first()[0] for x in (work.every, work.taken, work.completed))
    assert completed < taken < every


def indexed(spark, rows, tmp_path):
    documents = rows.select("document_id", F.lit("ready").alias("status")).distinct()
    store.write(documents, str(tmp_path), "documents", 0, "document_id")
    postings.write_index(rows, str(tmp_path), 0)
    return postings.read_index(spark, str(tmp_path), "document_id string, status string")


def test_terms_inside_words_and_labels(spark, tmp_path):
    rows = evidence(spark, ["Falcon-records, stay", "records of a café", "nothing", "", "x" * 5000 + "needle"])
    index = indexed(spark, rows, tmp_path)
    texts = ["falcon RECORDS", "cords, afé", "content", "needle", "zz", "", None, "nothing nothing cont"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    want = bag(keyword.keyword_search_batch(rows, asked, 3))
    assert want and bag(postings.index_search(index, asked, 3)) == want
    assert bag(postings.pruned_search(index, asked, f"{tmp_path}/search", 3)[0]) == want


def test_requests_of_one_id_are_pooled(spark, tmp_path):
    rows = evidence(spark, [f"falcon {'records' * (n % 2)} {'stay' * (n % 3)} {n}" for n in range(40)])
    index = indexed(spark, rows, tmp_path)
    texts = [(1, "falcon records"), (1, "records stay content"), (2, "stay"), (2, "stay"), (3, "stay"), (None, "falcon")]
    asked = spark.createDataFrame(texts, "query_id int, query string")
    want = bag(postings.index_search(index, asked.filter("query_id is not null"), 5))
    assert bag(postings.pruned_search(index, asked, f"{tmp_path}/search", 5)[0]) == want


def version(spark, sf_dir, root, batch, which, letters):
    stream.store_batch(root, embedder=derive.letter_model)(derive.edited_documents(spark, sf_dir, which, letters), batch)


def test_versions_deletions_and_compaction(spark, sf_dir, tmp_path):
    root, number = str(tmp_path), F.col("doc_id")
    version(spark, sf_dir, root, 0, number < 40, "z")
    before = bag(stream.current_evidence(spark, root).select("id", "snippet"))
    version(spark, sf_dir, root, 1, number < 10, "e")
    edited = bag(stream.current_evidence(spark, root).select("id", "snippet"))
    assert edited != before and [i for i, _ in edited] == [i for i, _ in before]
    gone = spark.createDataFrame([("doc_3",), ("doc_20",), ("doc_none",)], "document_id string")
    stream.delete_documents(gone, root, 2)
    left = [r for r in edited if r[0] not in ("ev_3_0001", "ev_20_0001")]
    for _ in range(2):
        assert bag(stream.current_evidence(spark, root).select("id", "snippet")) == left
        assert bag(stream.current_vectors(spark, root).select("id")) == [(i,) for i, _ in left]
        assert bag(stream.current_documents(spark, root).select("document_id").filter("document_id in ('doc_3', 'doc_20')")) == []
        stream.compact(spark, root)
    # A compaction that was cut short before its commit is not read.
    (tmp_path / "compacted-lost").mkdir()
    assert bag(stream.current_evidence(spark, root).select("id", "snippet")) == left
    version(spark, sf_dir, root, 3, number == 3, "z")
    assert len(bag(stream.current_evidence(spark, root).select("id"))) == len(left) + 1
    tables = ["evidence", "vectors"]
    assert store.vacuum(spark, root, tables) > 0 and not store.obsolete(spark, root, tables)
    assert len(bag(stream.current_evidence(spark, root).select("id"))) == len(left) + 1
    stream.compact(spark, root)
    assert len(bag(stream.current_vectors(spark, root).select("id"))) == len(left) + 1
    assert store.compaction(spark, root)[2] == 3


def test_batch_search_shuffles_no_postings(spark, tmp_path, monkeypatch):
    rows = evidence(spark, ["red fox", "blue whale", "red wolf"]).unionByName(evidence(spark, ["grey wolf"]))
    index = indexed(spark, rows, tmp_path)
    kept, keep = [], postings.store.keep
    monkeypatch.setattr(postings.store, "keep", lambda rows, path: kept.append(rows._jdf.queryExecution().executedPlan().toString()) or keep(rows, path))
    asked = spark.createDataFrame([(1, "fox wolf")], "query_id bigint, query string")
    hits = postings.pruned_search(index, asked, f"{tmp_path}/search", 3)[0]
    # The rows that share an id are one row, with the words of both.
    found = [(r["query_id"], r["rank"], r["id"], r["match_score"]) for r in hits.orderBy("rank").collect()]
    assert bag(hits) == bag(postings.index_search(index, asked, 3)) and found == [(1, 1, "ev_0_0001", 4), (1, 2, "ev_2_0001", 2)]
    assert not any("/postings" in text for text in kept)
