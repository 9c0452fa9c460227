import math

from pyspark.sql import functions as F

from marginalia.functions import boxes, labels
from marginalia.operators import changes, jobs, library, ocr, providers


def now():
    return F.lit("2024-01-02 00:00:00").cast("timestamp")


CITATION = "query_id int, rank int, id string, document_id string, document_name string, page int, ocr_confidence double"


def groups(spark, *rows):
    data = [(1, n, *row) for n, row in enumerate(rows)]
    found = library.group_citations(spark.createDataFrame(data, CITATION), ["query_id"])
    return found.orderBy("first_rank").collect()


def test_citation_groups(spark):
    found = groups(
        spark,
        ("e1", "d1", "lease.pdf", 9, 0.98), ("e2", "d1", "lease.pdf", 2, 0.31), ("e1", "d1", "lease.pdf", 9, 0.98),
        ("e3", "d2", "policy.pdf", 1, None), ("e4", "d1", "lease.pdf", 5, None), ("e5", None, "lease.pdf", 3, None),
    )
    assert [(g.group_key, [p.page for p in g.passages], g.min_confidence, g.low_confidence) for g in found] == [
        ("d1", [2, 5, 9], 0.31, True),
        ("d2", [1], None, False),
        ("lease.pdf", [3], None, False),
    ]
    assert [p.id for p in found[0].passages] == ["e2", "e4", "e1"]


def test_page_words_and_totals(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4, 9, 9],), ([5],), ([9, 2, 5],), ([],)], "p array<int>")
    got = [r[0] for r in rows.select(library.page_summary(F.col("p"))).collect()]
    assert got == ["Pages 1–9 · 5 total", "Page 5", "Pages 2, 5, 9", ""]
    found = library.group_citations(
        spark.createDataFrame([(1, 0, "a", "d", "n", 1, None), (2, 0, "a", "d", "n", 1, None), (2, 1, "b", "d", "n", 2, None), (2, 2, "c", "e", "m", 2, None)], CITATION),
        ["query_id"],
    )
    got = {r.query_id: r.label for r in library.source_totals(found, ["query_id"]).collect()}
    assert got == {1: "1 passage from 1 document", 2: "3 passages from 2 documents"}


def test_missing_evidence_becomes_a_stub(spark):
    from test_search import evidence

    cited = spark.createDataFrame([(1, "ev_0_0001", 1, "short"), (1, "gone", 2, "kept words")], "query_id int, evidence_unit_id string, ordinal int, snippet string")
    rows = {r.ordinal: r for r in library.hydrate_citations(cited, evidence(spark, ["whole text"])).collect()}
    assert (rows[1].snippet, rows[1].document_name, rows[1].lines) == ("whole text", "file0.txt", "1-1")
    assert (rows[2].snippet, rows[2].document_name, rows[2].section, rows[2].page) == ("kept words", "Retrieved evidence", "Citation 2", 1)


def docs(spark, *rows):
    return spark.createDataFrame(
        [(f"doc_{n}", name, status, n, 2, "ocr_dependent") for n, (name, status) in enumerate(rows)],
        "id string, name string, status string, doc_seq int, pages int, fidelity_tier string",
    ).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))


def test_lists_and_counts(spark):
    rows = docs(spark, *[("A.txt", "ready")] * 3, ("b.txt", "review"), ("c.txt", "failed"), ("d", "processing"))
    page = library.list_documents(rows, "ready", 2).collect()
    assert [r.id for r in page] == ["doc_0", "doc_1"] and all(r.has_more for r in page)
    assert not library.list_documents(rows, "ready", 3).first().has_more
    everything = [r.doc_seq for r in library.list_documents(rows, limit=100).collect()]
    first = [r.doc_seq for r in library.list_documents(rows, limit=2).collect()]
    rest = [r.doc_seq for r in library.list_documents(rows, limit=100, after_seq=first[-1]).collect()]
    assert first + rest == everything
    assert library.filter_library(rows, " a.T", "ready").count() == 3
    assert library.filter_library(rows, "", "attention").count() == 2
    stats = library.library_stats(rows).first()
    assert (stats.all_documents, stats.ready, stats.attention, stats.total_pages) == (6, 3, 2, 12)
    review = library.review_stats(rows).first()
    assert (review.coverage_pct, review.ocr_derived) == (50, 6)
    none = library.review_stats(rows.limit(0)).first()
    assert (none.coverage_pct, library.library_stats(rows.limit(0)).first().total_pages) == (0, 0)


def test_labels(spark):
    rows = spark.createDataFrame([(10,), (1536,), (2560,), (1024 * 1024 * 3 // 2,)], "b bigint")
    assert [r[0] for r in rows.select(labels.size_label(F.col("b"))).collect()] == ["1 KB", "2 KB", "3 KB", "1.5 MB"]
    names = spark.createDataFrame([("a.PDF",), ("x.csv",), ("y.tiff",), ("z.py",), ("w.docx",), ("q.txt",), ("pdf",)], "n string")
    assert [r[0] for r in names.select(labels.kind(F.col("n"))).collect()] == ["pdf", "sheet", "image", "code", "doc", "text", "pdf"]
    ages = [30, 90, 3000, 3 * 3600, 30 * 3600, 20 * 86400]
    rows = spark.createDataFrame([(a,) for a in ages], "s int").withColumn("u", F.timestamp_seconds(F.unix_seconds(now()) - F.col("s")))
    got = [r[0] for r in rows.select(labels.updated_label(F.col("u"), now())).collect()]
    assert got[:3] == ["Just now", "2 min ago", "50 min ago"]
    assert got[3].startswith("Today, ") and got[4].startswith("Yesterday, ") and got[5] == "Dec 13"


JOB = "id string, document_id string, status string, stage string, progress_pct int, error map<string,string>, updated_at string, seq int"


def job_rows(spark):
    data = [
        ("j0", "doc_0", "failed", "failed", 100, {"a": "b"}, "2024-01-01", 0), ("j1", "doc_0", "processing", "ocr", 30, None, "2024-01-01", 1),
        ("j2", "doc_1", "queued", "queued", 0, None, "2024-01-01", 2), ("j3", "doc_2", "ready", "ready", 100, None, "2024-01-01", 3),
    ]
    return spark.createDataFrame(data, JOB).withColumn("updated_at", F.col("updated_at").cast("timestamp"))


def test_reconcile(spark):
    before = job_rows(spark)
    after = {r.id: r for r in jobs.reconcile_jobs(before, now()).collect()}
    assert (after["j1"].status, after["j1"].error["reason_code"], after["j1"].error["stage"]) == ("failed", "interrupted", "ocr")
    assert after["j2"].status == "failed" and after["j0"].error == {"a": "b"} and after["j3"].status == "ready"
    again = jobs.reconcile_jobs(jobs.reconcile_jobs(before, now()), F.lit("2030-01-01").cast("timestamp"))
    assert sorted(map(str, again.collect())) == sorted(map(str, after.values()))
    library_rows = docs(spark, ("a", "processing"), ("b", "processing"), ("c", "ready"))
    states = {r.id: r.status for r in jobs.reconcile_documents(library_rows, before, now()).collect()}
    assert states == {"doc_0": "review", "doc_1": "review", "doc_2": "ready"}


def test_latest_job_and_progress(spark):
    latest = {r.document_id: r.id for r in jobs.latest_jobs(job_rows(spark)).collect()}
    assert latest == {"doc_0": "j1", "doc_1": "j2", "doc_2": "j3"}
    shown = jobs.documents_with_progress(docs(spark, ("a", "processing"), ("b", "ready"), ("c", "ready"), ("d", "processing")), job_rows(spark))
    got = {r.id: (r.stage, r.progress) for r in shown.collect()}
    assert got == {"doc_0": ("ocr", 30), "doc_1": (None, None), "doc_2": (None, None), "doc_3": (None, None)}


def test_progress_reports(spark):
    rows = spark.createDataFrame([(list(range(1, 13)), 12), ([1, 2, 8, 3, 9, 12], 12), ([3], 3), ([], 0)], "r array<int>, t int")
    got = [[(p.page, p.progress_pct) for p in r[0]] for r in rows.select(jobs.throttle_reports(F.col("r"), F.col("t"))).collect()]
    assert got[0] == [(5, 5 + math.floor(55 * 5 / 12)), (10, 50), (12, 60)]
    assert [p for p, _ in got[1]] == [8, 12] and got[2] == [(3, 60)] and got[3] == []


def test_changes(spark):
    existing = docs(spark, ("a", "ready"), ("b", "ready")).withColumn("document_id", F.col("id"))
    incoming = existing.filter("id = 'doc_0'").withColumn("status", F.lit("processing"))
    rows = [(r.id, r.status) for r in changes.upsert(existing, incoming).collect()]
    assert sorted(rows) == [("doc_0", "processing"), ("doc_1", "ready")] and rows[0][0] == "doc_0"
    emptied = changes.replace_by_document(existing, existing.limit(0), incoming.select("document_id"))
    assert [r.id for r in emptied.collect()] == ["doc_1"]
    updates = spark.createDataFrame([("doc_1", "review", None), ("doc_9", "ready", 4)], "id string, status string, pages int")
    got = {r.id: r for r in changes.apply_updates(existing, updates, now()).collect()}
    assert (got["doc_1"].status, got["doc_1"].pages, str(got["doc_1"].updated_at)) == ("review", 2, "2024-01-02 00:00:00")
    assert set(got) == {"doc_0", "doc_1"} and got["doc_0"].status == "ready"


def test_provider_configs(spark, tmp_path):
    base = providers.default_configs(spark)
    new = base.filter("id = 'cfg_chat_extractive'").withColumn("is_default", F.lit(True))
    got = {r.id: r.is_default for r in providers.upsert_configs(base, new).collect()}
    assert got == {"cfg_chat_extractive": True, "cfg_chat_ollama": False, "cfg_embed_ollama": True, "cfg_embed_keyword": False}
    rows = base.collect()
    assert providers.resolve(rows, "chat", lambda c: True)[0] == "ollama"
    assert providers.resolve(rows, "chat", lambda c: False) == ("extractive", "evidence_synthesis_v1")
    assert providers.resolve([], "embedding", lambda c: True) == ("keyword", "local_text_match")
    assert providers.delete_config(base, "cfg_chat_ollama").count() == 3
    path = tmp_path / "configs.json"
    path.write_text('[{"id": "a", "role": "chat", "provider_type": "openai"}, {"role": "chat"}]')
    loaded = providers.load_configs(spark, str(path)).collect()
    assert [(r.id, r.model_name, r.is_default) for r in loaded] == [("a", "", False)]
    path.write_text("[]")
    assert providers.load_configs(spark, str(path)).count() == 4


def test_model_names(spark):
    rows = spark.createDataFrame([("m:1b", ["m:7b"]), ("m", ["m:7b"]), ("m:1b", ["m"]), ("m", ["mm:1b"]), ("m", [])], "w string, i array<string>")
    assert [r[0] for r in rows.select(providers.model_installed(F.col("w"), F.col("i"))).collect()] == [True, True, True, False, False]


def test_boxes(spark):
    rows = spark.createDataFrame(
        [([[100.0, 50.0], [300.0, 50.0], [300.0, 90.0], [100.0, 90.0]],), ([[5.0, 5.0]] * 4,), ([[-50.0, -20.0], [100.0, 100.0]],), ([],), (None,), ([[1.0]],)],
        "q array<array<double>>",
    )
    got = [r[0] for r in rows.select(boxes.quad_to_box(F.col("q"), F.lit(1000), F.lit(200))).collect()]
    assert tuple(got[0]) == (0.1, 0.25, 0.2, 0.2) and tuple(got[2]) == (0.0, 0.0, 0.1, 0.5)
    assert got[1] is None and got[3:] == [None, None, None]


def test_confidence_and_envelope(spark):
    rows = spark.createDataFrame(
        [("a", 1.0, (0.1, 0.1, 0.2, 0.1)), ("a", 0.0, (0.5, 0.4, 0.2, 0.2)), ("b", None, None)],
        "k string, c double, box struct<x:double,y:double,width:double,height:double>",
    )
    got = {r.k: r for r in rows.groupBy("k").agg(ocr.mean_confidence(F.col("c")).alias("c"), ocr.envelope("box").alias("e")).collect()}
    assert got["a"].c == 0.5 and [round(v, 6) for v in got["a"].e] == [0.1, 0.1, 0.6, 0.5]
    assert got["b"].c is None and got["b"].e is None


def test_words_to_lines_and_pages(spark):
    words = spark.createDataFrame(
        [("p", 1, 1, 2, 3, " second ", 50.0, 10.0, 40.0, 50.0, 10.0), ("p", 1, 1, 1, 1, "first", -1.0, 10.0, 10.0, 50.0, 10.0),
         ("p", 1, 1, 1, 2, "line", 90.0, 70.0, 10.0, 60.0, 10.0), ("p", 1, 1, 1, 9, " ", 10.0, 0.0, 0.0, 0.0, 0.0)],
        "page string, block_num int, par_num int, line_num int, pos int, text string, conf double, left double, top double, width double, height double",
    ).withColumns({"page_width": F.lit(100.0), "page_height": F.lit(100.0)})
    lines = ocr.lines_from_words(words, ["page"]).orderBy("first_pos").collect()
    assert [(r.text, r.confidence) for r in lines] == [("first line", 0.9), ("second", 0.5)]
    assert tuple(lines[0].bbox) == (0.1, 0.1, 0.9, 0.1)  # the right edge is clamped to the page
    page = ocr.pages_from_lines(ocr.lines_from_words(words, ["page"]), ["page"], "tesseract").first()
    assert page.ocr_text == "first line\nsecond" and page.ocr_confidence == 0.7


def test_regions_to_pages(spark):
    box = [[10.0, 10.0], [110.0, 10.0], [110.0, 30.0], [10.0, 30.0]]
    rows = spark.createDataFrame(
        [("d", 1, 0, box, "Retention window", 0.98, 200, 100), ("d", 1, 1, box, "eighteen months", 0.90, 200, 100), ("d", 1, 2, box, "  ", 0.1, 200, 100),
         ("d", 1, 3, box, "unsure", None, 200, 100)],
        "document_id string, page_number int, pos int, quad array<array<double>>, text string, score double, page_width int, page_height int",
    )
    page = ocr.pages_from_lines(ocr.lines_from_quads(rows), ["document_id", "page_number"], "rapidocr").first()
    assert page.ocr_text == "Retention window\neighteen months\nunsure" and round(page.ocr_confidence, 6) == 0.94
    assert [round(v, 9) for v in page.ocr_bbox] == [0.05, 0.1, 0.5, 0.2]


def test_languages(spark):
    rows = spark.createDataFrame([("eng",), ("chi_sim",), ("jpn",), ("eng+chi_sim",), ("xyz",), (" FRA ",), ("",)], "l string")
    assert [r[0] for r in rows.select(ocr.language_code(F.col("l"))).collect()] == ["en", "ch", "japan", "en", "xyz", "fr", "en"]
