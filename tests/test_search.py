import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marginalia.config import Settings
from marginalia.operators import keyword, topk
from marginalia.operators.vector import vector_search, vector_search_batch
from marginalia.plans import search as sr

COLUMNS = (
    "id string, document_id string, document_name string, section string, page int, line_start int, line_end int, "
    "snippet string, retrieval_score double, relevance string, anchor_quality string, fidelity_tier string, "
    "ocr_confidence double, ocr_engine string, bbox struct<x:double,y:double,width:double,height:double>, seq bigint"
)


def evidence(spark, snippets, names=None):
    """snippets: texts; row n is the only chunk of doc_n."""
    names = names or [f"file{n}.txt" for n in range(len(snippets))]
    rows = [
        (f"ev_{n}_0001", f"doc_{n}", names[n], "Imported content", 1, 1, 1, s, 0.74, "Medium", "paragraph", "full_layout",
         None, None, None, n)
        for n, s in enumerate(snippets)
    ]
    return spark.createDataFrame(rows, COLUMNS)


def brute(snippets, names, query, k=12):
    terms = {t for t in query.lower().split() if len(t) > 2}
    scored = []
    for n, (s, name) in enumerate(zip(snippets, names, strict=True)):
        points = 0
        for t in terms:
            points += 2 if t in s.lower() else 1 if t in f"{name} Imported content {s}".lower() else 0
        if points:
            scored.append((-points, n))
    return [(f"ev_{n}_0001", -p) for p, n in sorted(scored)[:k]]


def corpus(seed, size, hot=0.35):
    """Random snippets; a third are copies of one text."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "falcon", "record", "port", "amber", "stone", "été", "über", "the"]
    copy = "falcon records stay local"
    return [copy if rng.random() < hot else " ".join(rng.choices(words, k=rng.randint(1, 8))) for _ in range(size)]


QUERIES = ["falcon records 18 months", "imported port", "a an it", "", "file1 ÉTÉ über", "content amberstone", "the the THE alpha,"]


def test_single_search_matches_brute_force(spark):
    snippets = corpus(1, 200)
    names = [f"file{n}.txt" for n in range(200)]
    rows = evidence(spark, snippets).repartition(5)
    for query in QUERIES:
        got = [(r.id, r.match_score) for r in keyword.keyword_search(rows, query).collect()]
        assert got == brute(snippets, names, query), query


def test_batch_matches_single_and_slices_above_the_bound(spark):
    snippets = corpus(2, 1500)
    names = [f"file{n}.txt" for n in range(1500)]
    rows = evidence(spark, snippets).repartition(6)
    queries = spark.createDataFrame(list(enumerate(QUERIES * 3)), "query_id int, query string")
    for bound in (4096, 8):
        hits = keyword.keyword_search_batch(rows, queries, settings=Settings(queries_per_scan=bound)).collect()
        for n, query in enumerate(QUERIES * 3):
            found = sorted((r.rank, r.id, r.match_score) for r in hits if r.query_id == n)
            assert [(i, m) for _, i, m in found] == brute(snippets, names, query), query
            assert [r for r, _, _ in found] == list(range(1, len(found) + 1))


def test_finder_without_the_matching_library(monkeypatch):
    import builtins

    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name == "ahocorasick":
            raise ImportError(name)
        return real(name, *args, **kwargs)

    terms = ["abc", "bcd", "xyz"]
    fast = keyword._finder(terms)
    monkeypatch.setattr(builtins, "__import__", missing)
    assert set(keyword._finder(terms)("zabcdz")) == set(fast("zabcdz")) == {0, 1}


def test_partial_top_k_keeps_order_and_ties():
    rng = np.random.default_rng(0)
    score = rng.integers(0, 4, size=(3, 2000)).astype(float)
    seq = rng.permutation(2000)
    best = topk._Best(3, 12)
    for start in range(0, 2000, 300):
        part = slice(start, start + 300)
        best.add(score[:, part], seq[part], np.array([f"i{s}" for s in seq[part]], dtype=object), 1.0)
    for q in range(3):
        order = np.lexsort((seq, -score[q]))[:12]
        assert best.seq[q].tolist() == seq[order].tolist()
        assert best.score[q].tolist() == score[q][order].tolist()


def test_partial_top_k_drops_rows_below_the_floor():
    best = topk._Best(1, 3)
    best.add(np.array([[0.0, 2.0]]), np.array([1, 2]), np.array(["a", "b"], dtype=object), 1.0)
    assert best.batch(["q"], pa.string()).to_pylist() == [{"query_id": "q", "score": 2.0, "seq": 2, "id": "b"}]


def test_scope_before_and_after_the_limit(spark):
    snippets = ["falcon falcon"] * 20 + ["falcon"]
    rows = evidence(spark, [f"{s} {n}" for n, s in enumerate(snippets)])
    late = sr.keyword_retrieve(rows, "falcon", ["doc_20"], prefilter=False).collect()
    early = sr.keyword_retrieve(rows, "falcon", ["doc_20"]).collect()
    assert late == [] and [r.document_id for r in early] == ["doc_20"]
    queries = spark.createDataFrame([("q", "falcon")], "query_id string, query string")
    late = sr.search(sr.retrieve(rows, queries, ["doc_20"], prefilter=False)).collect()
    early = sr.search(sr.retrieve(rows, queries, ["doc_20"])).collect()
    assert late == [] and [r.document_id for r in early] == ["doc_20"]
    scope = spark.createDataFrame([("doc_3",), ("doc_3",)], "document_id string")
    assert [r.document_id for r in sr.keyword_retrieve(rows, "falcon", scope).collect()] == ["doc_3"]
    assert sr.keyword_retrieve(rows, "falcon", []).count() == 12
    assert sr.resolve_scope("selection", document_ids=[]) is None
    assert sr.resolve_scope("document", "doc_1") == ["doc_1"]


def test_a_request_gets_as_many_rows_as_it_asks_for(spark):
    rows = evidence(spark, [f"falcon {n}" for n in range(25)])
    queries = spark.createDataFrame([("q", "falcon")], "query_id string, query string")
    found = sr.search(sr.retrieve(rows, queries, top_k=20), 20).orderBy("rank").collect()
    assert [r.document_id for r in found] == [f"doc_{n}" for n in range(20)]
    assert sr.keyword_retrieve(rows, "falcon", top_k=20).count() == 20
    assert sr.search(sr.retrieve(rows, queries), 20).count() == 12


def test_search_finds_a_document_and_reports_the_constant_score(spark):
    rows = evidence(spark, ["Falcon records must stay on the local machine for 18 months.", "Other"])
    queries = spark.createDataFrame([("q", "falcon records 18 months")], "query_id string, query string")
    results = sr.search(sr.retrieve(rows, queries)).collect()
    assert "Falcon records" in results[0].snippet and results[0].score == 0.74
    found = sr.first_for_document(sr.search(sr.retrieve(rows, queries)), "doc_0").collect()
    assert len(found) == 1


def test_hot_copies_are_one_passage(spark):
    rows = evidence(spark, ["Same   text"] * 50 + ["same text", "other text", " \n"])
    kept = sr.dedupe_hits(rows, order="seq").orderBy("seq").collect()
    assert [r.seq for r in kept] == [0, 51]
    queries = spark.createDataFrame([(1, "text")], "query_id int, query string")
    assert [r.id for r in sr.search(sr.retrieve(rows, queries)).collect()] == ["ev_0_0001"]


def vectors(spark, matrix):
    rows = [(f"ev_{n}_0001", n, f"doc_{n % 3}", [float(x) for x in v]) for n, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "id string, seq bigint, document_id string, embedding array<float>")


def test_vector_search_matches_brute_force_with_exact_copies(spark):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(400, 16)).astype(np.float32)
    matrix[100:240] = matrix[5]  # a third are copies of one vector
    rows = vectors(spark, matrix).repartition(5)
    wanted = matrix[[5, 7, 11]].astype(np.float64)
    queries = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(wanted)], "query_id int, embedding array<double>")
    hits = vector_search_batch(rows, queries, min_similarity=0.1).collect()
    wide = matrix.astype(np.float64)
    for q, v in enumerate(wanted):
        cosine = np.round(wide @ v / np.linalg.norm(wide, axis=1) / np.linalg.norm(v), 12)
        order = [i for i in np.lexsort((np.arange(400), -cosine)) if cosine[i] >= 0.1][:12]
        got = sorted((r.rank, r.seq) for r in hits if r.query_id == q)
        assert [s for _, s in got] == order
    single = vector_search(rows, wanted[0].tolist(), scope=["doc_1"]).collect()
    assert {r.seq % 3 for r in single} == {1} and all(0.35 <= r.score <= 1 for r in single)


def test_vectors_first_then_keywords(spark):
    rows = evidence(spark, ["alpha", "beta", "alpha beta"])
    near = vectors(spark, np.eye(3))
    queries = spark.createDataFrame([(1, "alpha"), (2, "alpha"), (3, "beta")], "query_id int, query string")
    asked = spark.createDataFrame([(1, [0.0, 1.0, 0.1]), (2, [-1.0, 0.0, 0.0])], "query_id int, embedding array<double>")
    found = sr.retrieve(rows, queries, vectors=near, query_vectors=asked)
    got = {r.query_id: [(c.id, round(c.score, 3)) for c in r.chunks] for r in found.collect()}
    assert got[1] == [("ev_1_0001", 0.995)]
    assert got[2] == [("ev_0_0001", 0.74), ("ev_2_0001", 0.74)]  # nothing similar: keywords
    assert [i for i, _ in got[3]] == ["ev_1_0001", "ev_2_0001"]  # no query vector at all
    gone = near.filter(F.col("seq") != 99).withColumn("id", F.concat("id", F.lit("x")))
    stale = sr.retrieve(rows, queries, vectors=gone, query_vectors=asked)
    assert [c.id for c in stale.filter("query_id = 1").first().chunks] == ["ev_0_0001", "ev_2_0001"]


def test_floors_and_bitmaps_match_brute_force(spark, monkeypatch):
    from marginalia.operators import termbits

    monkeypatch.setattr(keyword, "SEEDED", 1)
    monkeypatch.setattr(keyword, "SEEDS", 30)
    snippets = corpus(3, 700)
    names = [f"file{n % 9} alpha.txt" if n % 2 else "über port.txt" for n in range(700)]
    rows = evidence(spark, snippets, names).repartition(3)
    words = ["alpha", "beta", "falcon", "record", "port", "amber", "stone", "été", "über", "the", "ile3", "rds", "none"]
    rng = random.Random(4)
    texts = [" ".join(rng.sample(words, rng.randint(0, 9))) for _ in range(60)] + [None]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    monkeypatch.setattr(termbits, "CHUNK", 7)
    hits = keyword.keyword_search_batch(rows, queries).collect()
    for n, query in enumerate(texts):
        found = sorted((r.rank, r.id, r.match_score) for r in hits if r.query_id == n)
        assert [(i, m) for _, i, m in found] == brute(snippets, names, query or ""), query


def test_floors_leave_few_pairs_to_count(monkeypatch):
    from marginalia.operators import termbits

    rng = np.random.default_rng(5)
    size = np.r_[np.full(64, 150), np.full(termbits.BLOCK - 64, 30)]
    strong = [np.sort(rng.choice(300, n, replace=False)).astype(np.int32) for n in size]
    none = [np.zeros(0, np.int32)] * len(size)
    rows = termbits.Block(np.arange(len(size)), np.array([f"i{n}" for n in range(len(size))], object), strong, none)
    asked = termbits.requests(list(range(200)), [[str(t) for t in rng.choice(300, 20, replace=False)] for _ in range(200)])
    asked.tid = np.array([int(asked.terms[t]) for t in asked.tid], np.int32)
    asked.terms = [str(t) for t in range(300)]
    first = termbits.Block(rows.seq[:64], rows.ids[:64], strong[:64], none[:64])
    asked.floor, asked.floor_seq = termbits.floors(asked, first, 12, range(200))
    best = termbits.Best(asked, 12)
    met = []
    find = best._candidates
    monkeypatch.setattr(best, "_candidates", lambda *a: met.append(find(*a)) or met[-1])
    best.add(rows)
    # The full scan met every pair of request and row.
    assert sum(int(np.bitwise_count(m).sum()) for m in met) < 0.3 * 200 * len(size)
    best._rank()
    for slot in range(200):
        own = set(asked.tid[asked.ptr[slot] : asked.ptr[slot + 1]].tolist())
        want = sorted((-2 * len(own & set(s.tolist())), n) for n, s in enumerate(strong))[:12]
        at = best.kept[0] == slot
        assert list(zip((-best.kept[1][at]).tolist(), best.kept[2][at].tolist(), strict=True)) == want


def test_fields_and_texts_leave_out_what_nobody_reads(spark):
    snippets = ["falcon one", "falcon ONE", "falcon two", "falcon", "falcon three", " \n", "falcon four"]
    rows = evidence(spark, snippets)
    queries = spark.createDataFrame([("q", "falcon"), ("none", "zzz")], "query_id string, query string")
    whole = {r.query_id: r.chunks for r in sr.retrieve(rows, queries).collect()}
    lean = {r.query_id: r.chunks for r in sr.retrieve(rows, queries, fields=("id", "snippet"), texts=3).collect()}
    assert whole["none"] == lean["none"] == []
    assert [c.snippet for c in whole["q"]] == ["falcon one", "falcon two", "falcon", "falcon three", "falcon four"]
    assert [(c.id, c.snippet) for c in lean["q"]] == [(c.id, c.snippet if n < 3 else None) for n, c in enumerate(whole["q"])]
    plan = sr.search(sr.retrieve(rows, queries, fields=("id", "document_name"))).select("query_id", "rank", "id", "document_name", "score")
    assert [(r.rank, r.id, r.document_name) for r in plan.orderBy("rank").collect()] == [
        (n + 1, c.id, c.document_name) for n, c in enumerate(whole["q"])
    ]


def test_each_word_is_looked_through_once(monkeypatch):
    from marginalia.operators import termbits

    rng = random.Random(3)
    words = ["".join(rng.choices("abé", k=rng.randint(1, 9))) for _ in range(60)] + ["a" * 500]
    terms = sorted({"".join(rng.choices("abé", k=rng.randint(3, 4))) for _ in range(40)})
    texts = [rng.choice([" ", "\n", " ", "\x1d "]).join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(300)] + [None, ""]
    labels = [rng.choice([None, "", "abab content", "bé aab"]) for _ in texts]
    columns = [pa.array([f"i{n}" for n in range(len(texts))]), pa.array([None, *range(1, len(texts))], pa.int64()), pa.array(texts), pa.array(labels)]
    batch = pa.RecordBatch.from_arrays(columns, ["id", "seq", "snippet_lower", "label_lower"])
    for bound, remembered in ((1 << 22, 1 << 19), (200, 20)):
        monkeypatch.setattr(termbits, "PART_BYTES", bound)
        monkeypatch.setattr(termbits, "REMEMBERED", remembered)
        find, seen = keyword._word_finder(terms), []
        finder = termbits.Words(lambda some, find=find, seen=seen: seen.extend(some) or find(some))
        blocks = list(termbits.found_rows([batch, batch.slice(0, 0)], finder, len(terms)))
        assert remembered < 100 or len(seen) == len(set(seen))
        strong, weak = (sum((getattr(b, kind) for b in blocks), []) for kind in ("strong", "weak"))
        assert [i for b in blocks for i in b.ids] == columns[0].to_pylist() and blocks[0].seq[0] == termbits.FIRST
        for text, label, own, named in zip(texts, labels, strong, weak, strict=True):
            held = {n for n, t in enumerate(terms) if t in (text or "")}
            assert sorted(held) == own.tolist()
            assert sorted({n for n, t in enumerate(terms) if t in (label or "")} - held) == named.tolist()
    assert [len(r) for b in termbits.found_rows([batch], termbits.Words(keyword._word_finder([])), 0) for r in b.strong] == [0] * len(texts)


def test_counts_of_64_rows_at_a_time():
    from marginalia.operators import termbits

    rng = np.random.default_rng(7)
    bits = rng.integers(0, 2, size=(37, 50, 64)).astype(np.uint8)
    packed = [np.packbits(b, axis=1, bitorder="little").view(np.uint64)[:, 0] for b in bits]
    count, least = bits.sum(axis=0), rng.integers(-1, 70, 50)
    got = termbits._at_least(termbits._counted(packed), least)
    assert (np.unpackbits(got[:, None].view(np.uint8), axis=1, bitorder="little") == (count >= least[:, None])).all()
