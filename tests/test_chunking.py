import random

from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.config import Settings
from marginalia.operators import chunking as ch


def documents(spark, docs):
    """docs: list of (document_id, suffix, tier, engine, pages)."""
    rows = [(d, f"{d}.txt", n, s, t, e, p) for n, (d, s, t, e, p) in enumerate(docs)]
    return spark.createDataFrame(
        rows,
        "document_id string, document_name string, doc_seq bigint, suffix string, fidelity_tier string, "
        f"ocr_engine string, pages array<{schemas.PAGE}>",
    )


def page(n, text, source="native", confidence=None, bbox=None):
    return (n, text, source, confidence, bbox, None)


def brute_chunks(text, budget, overlap):
    """Independent check: paragraphs from the split text, then groups grown and cut by hand."""
    paras, open_from, held = [], None, []
    rows = text.splitlines()
    for n, line in enumerate([*rows, ""], start=1):
        if line.strip():
            open_from = open_from or n
            held.append(line.strip())
        elif held:
            paras.append((open_from, n - 1, " ".join(held)))
            open_from, held = None, []
    size = [len(p[2].split()) for p in paras]
    found, first = [], 0
    while paras:
        last = first if not found else max(first, found[-1][1] + 1)
        while last + 1 < len(paras) and sum(size[first : last + 2]) <= budget:
            last += 1
        found.append((first, last))
        if last + 1 == len(paras):
            break
        nxt = last + 1
        while nxt > first and sum(size[nxt - 1 : last + 1]) <= overlap:
            nxt -= 1
        first = nxt
    return [(paras[a][0], paras[b][1], " ".join(p[2] for p in paras[a : b + 1])) for a, b in found]


def test_pages_and_confidence_are_kept(spark):
    docs = documents(
        spark,
        [
            (
                "doc_1",
                "pdf",
                "ocr_dependent",
                "tesseract",
                [
                    page(1, "Native page one.\n\nSecond paragraph here."),
                    page(2, "OCR recognized text on page two.", "ocr", 0.42, (0.1, 0.2, 0.3, 0.4)),
                ],
            )
        ],
    )
    rows = ch.evidence_rows(docs).orderBy("seq").collect()
    assert [(r.id, r.page, r.ocr_confidence, r.ocr_engine, r.anchor_quality) for r in rows] == [
        ("ev_1_0001", 1, None, None, "paragraph"),
        ("ev_1_0002", 2, 0.42, "tesseract", "bbox"),
    ]
    assert rows[1].bbox.width == 0.3 and rows[0].bbox is None
    assert (rows[0].section, rows[0].retrieval_score, rows[0].relevance) == ("Imported content", 0.74, "Medium")


def test_long_pages_split_with_overlap(spark):
    text = "\n\n".join(f"Paragraph {i} has some words in it for budget testing." for i in range(10))
    rows = ch.evidence_rows(
        documents(spark, [("doc_1", "txt", "full_layout", None, [page(1, text)])]),
        Settings(chunk_max_words=20, chunk_overlap_words=10),
    ).orderBy("seq").collect()
    assert len(rows) > 1 and {r.page for r in rows} == {1}
    assert all(b.line_start <= a.line_end for a, b in zip(rows, rows[1:], strict=False))


def test_every_chunk_of_a_document(spark):
    text = "\n\n".join(f"word{i} filler text here" for i in range(50))
    docs = documents(spark, [("doc_1", "txt", "full_layout", None, [page(1, text), page(2, text)])])
    assert ch.evidence_rows(docs, Settings(chunk_max_words=5)).count() == 100


def test_anchor_quality_and_long_snippets(spark):
    docs = documents(
        spark,
        [
            ("doc_a", "xlsx", "structural", None, [page(1, "a b")]),
            ("doc_b", "csv", "structural", None, [page(1, "x" * 9000)]),
            ("doc_c", "txt", "full_layout", None, [page(1, " \n\t\n")]),
            ("plain", "txt", "full_layout", None, [page(3, "one\ntwo")]),
        ],
    )
    rows = {r.document_id: r for r in ch.evidence_rows(docs).collect()}
    assert rows["doc_a"].anchor_quality == "cell" and rows["doc_b"].anchor_quality == "line"
    assert len(rows["doc_b"].snippet) == 9000
    assert "doc_c" not in rows
    assert (rows["plain"].id, rows["plain"].snippet, rows["plain"].line_end) == ("ev_plain_0001", "one two", 2)
    assert {r.document_id for r in docs.filter(ch.has_chunks(F.col("pages"))).collect()} == set(rows)


def test_fold_matches_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(300):
        lines = [" ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 0, 1, 2, 5, 9, 14]))) for _ in range(rng.randint(0, 25))]
        texts.append("".join(line + rng.choice(["\n", "\n\n", "\r\n", "\x0b", "\n \t\n"]) for line in lines))
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    for budget, overlap in ((12, 4), (10, 10), (3, 0), (1, 30)):
        got = {r.n: [tuple(c) for c in r.c] for r in rows.select("n", ch.page_chunks(F.col("t"), budget, overlap).alias("c")).collect()}
        for n, text in enumerate(texts):
            assert got[n] == brute_chunks(text, budget, overlap), (text, budget, overlap)


def test_numbering_of_separate_rows(spark):
    rows = spark.createDataFrame([("d", 2, 0), ("d", 1, 1), ("d", 1, 0), ("e", 5, 0)], "document_id string, page int, seq_in_page int")
    got = {(r.document_id, r.page, r.seq_in_page): r.ordinal for r in ch.number_chunks(rows).collect()}
    assert got == {("d", 1, 0): 1, ("d", 1, 1): 2, ("d", 2, 0): 3, ("e", 5, 0): 1}
