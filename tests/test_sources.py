import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.config import Settings
from marginalia.operators import pages as pg
from marginalia.plans import office
from marginalia.plans.ingest import ingest, parse_files, read_files
from marginalia.sources import formats as fm
from marginalia.sources import parsers, tables

LINES = ["Quarterly budget for the archive", "Widgets & more < 42 > items", "Renewals happen every quarter"]


def parsed(spark, *files):
    rows = spark.createDataFrame([(n, bytearray(p), s) for n, (p, s) in enumerate(files)], "n int, payload binary, suffix string")
    return [r.parsed for r in parse_files(rows).orderBy("n").collect()]


def test_csv_and_html(spark):
    csv, html = parsed(
        spark,
        (b'name,score\nAlice, 95 \n"Bob, ""B""\nJr",88\n,,\n', "csv"),
        (b"<html><head><style>p{}</style><script>x('</p>')</script></head><body><h1>Report</h1><p>Renewals happen every <b>quarter</b>. A &amp; B</p></body></html>", "html"),
    )
    assert csv.fidelity_tier == "structural"
    assert csv.pages[0].text == 'name | score\nAlice | 95\nBob, "B"\nJr | 88'
    assert html.pages[0].text == "Report\nRenewals happen every quarter . A & B"


def test_plain_text_rules(spark):
    text, marked, latin, blank, json, unknown = parsed(
        spark,
        (b"Falcon\x00\x01records stay on the local machine", "txt"),
        ("\ufeffFalcon records étaient ici longtemps".encode(), "md"),
        ("été falcon records stay local forever".encode("latin-1"), "txt"),
        (b"....... ---- .......", "txt"),
        (b'{"some": ["json", "text", "kept", "verbatim"]}', "json"),
        (b"MZ" * 50, "exe"),
    )
    assert text.pages[0].text == "Falcon records stay on the local machine" and text.fidelity_tier == "full_layout"
    assert marked.pages[0].text.startswith("Falcon") and latin.pages[0].text.startswith("été")
    assert blank is None and unknown is None
    assert json.pages[0].text.startswith('{"some"')


def test_long_text_is_whole(spark):
    rows = spark.createDataFrame([("word " * 100_000 + "last",)], "t string")
    got = rows.select(fm.parse_plain_text(F.col("t")).alias("p")).first().p
    assert len(got.pages[0].text) == 500_004


def test_html_references_and_open_ends(spark):
    markup = "<p>one</p>Profit AT&T &amp; caf&eacute; &#233;&#xE9; &nosuch; &amp<!-- <p>no --> x<script>y</p>"
    rows = spark.createDataFrame([(markup,), (None,), ("",)], "h string")
    got = [r.t for r in rows.select(parsers.html_text(F.col("h")).alias("t")).collect()]
    assert got == ["one Profit AT&T & caf\u00e9 \u00e9\u00e9 &nosuch; & x", None, ""]


def test_long_cells_and_corrupt_packages():
    assert parsers.csv_records("a," + "b" * 140_000)[0][1] == "b" * 140_000
    good = office.write_docx([LINES])
    assert parsers.office_pages(good[:200] + b"\0" * 40 + good[240:], "docx") is None


def test_office_files(spark):
    docx, xlsx, pptx, broken = parsed(
        spark,
        (office.write_docx([LINES, ["short"], LINES[:1]]), "docx"),
        (office.write_xlsx([LINES, [" "]]), "xlsx"),
        (office.write_pptx([LINES, [" "], ["x"]]), "pptx"),
        (b"not a zip", "docx"),
    )
    # The short middle page falls below the floor, and page numbers keep the gap.
    assert [p.page_number for p in docx.pages] == [1, 3] and docx.page_count == 2
    assert docx.pages[0].text == "\n".join(LINES) and docx.fidelity_tier == "full_layout"
    assert [p.text for p in xlsx.pages][0] == "Sheet: S1\n" + "\n".join(f"{line} | {n}" for n, line in enumerate(LINES, 1))
    assert [p.text for p in xlsx.pages][1] == "Sheet: S2\n1" and xlsx.fidelity_tier == "structural"
    assert [(p.page_number, p.text) for p in pptx.pages] == [(1, "Slide 1\n" + "\n".join(LINES)), (3, "Slide 3\nx")]
    assert broken is None


def test_docx_headers_join_the_last_page():
    payload = office.write_docx([LINES])
    import io

    buffer = io.BytesIO(payload)
    with zipfile.ZipFile(buffer, "a") as archive:
        archive.writestr("word/header1.xml", f"<w:hdr {office.WORD}><w:p><w:r><w:t>Head</w:t><w:tab/></w:r></w:p></w:hdr>")
    assert parsers.docx_pages(buffer.getvalue())[-1][1].endswith("quarter\nHead")


def test_spreadsheet_values():
    from xml.etree import ElementTree

    def cell(xml):
        return parsers._cell_text(ElementTree.fromstring(xml), ["shared"])

    assert [cell(x) for x in ("<c><v>42</v></c>", "<c><v>95.50</v></c>", '<c t="s"><v>0</v></c>', '<c t="b"><v>1</v></c>', "<c/>")] == [
        "42", "95.5", "shared", "True", "",
    ]


@pytest.mark.parametrize(
    ("name", "suffix"),
    [("a.TXT", "txt"), ("x.tar.gz", "gz"), (".bashrc", ""), ("noext", ""), ("a.b/c", ""), ("dir.d/f.Md", "md"), ("a.", ""), ("..a", "")],
)
def test_suffix(spark, name, suffix):
    assert spark.createDataFrame([(name,)], "n string").select(fm.suffix_of(F.col("n"))).first()[0] == suffix


def test_admission(spark):
    files = spark.createDataFrame([("payload.exe", 1), ("big.txt", 60 * 2**20), ("ok.pdf", 50 * 2**20)], "name string, size_bytes bigint")
    accepted, rejected = fm.admit(files)
    assert [r.name for r in accepted.collect()] == ["ok.pdf"]
    assert {(r.name, r.status_code) for r in rejected.collect()} == {("payload.exe", 415), ("big.txt", 413)}


def test_folder_ingest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "note.txt").write_text("Falcon records must stay on the local machine for 18 months.")
    (tmp_path / "blank.md").write_text("....... ---- .......")
    (tmp_path / "sheet.xlsx").write_bytes(office.write_xlsx([LINES]))
    accepted, _ = fm.admit(read_files(spark, str(tmp_path)))
    rows = parse_files(accepted).select(
        "document_id", F.col("name").alias("document_name"), F.lit(0).cast("bigint").alias("doc_seq"),
        F.lit("job_1").alias("job_id"), "suffix", F.lit(3).alias("probed_pages"), "parsed",
    )
    made = ingest(rows, embedder=lambda: lambda texts: [[1.0] for _ in texts], summarizer=lambda p: F.lit("A model summary of enough length."), summarizer_name="ollama:m")
    evidence = {r.document_name: r for r in made.evidence.collect()}
    assert set(evidence) == {"note.txt", "sheet.xlsx"} and evidence["sheet.xlsx"].anchor_quality == "cell"
    states = {r.id: r for r in made.document_updates.collect()}
    assert sorted(r.status for r in states.values()) == ["ready", "ready", "review"]
    note = states[evidence["note.txt"].document_id]
    assert (note.pages, note.summary_method, note.summary_provider) == (3, "abstractive", "ollama:m")
    ended = made.job_updates.collect()
    assert sorted(r.status for r in ended) == ["failed", "ready", "ready"]
    assert {r.error["reason_code"] for r in ended if r.error} == {"no_extractable_content"}
    assert made.vectors.count() == 2


def test_page_merge(spark):
    rows = spark.createDataFrame(
        [
            ("sparse", 1, "Hi", "", None), ("scan", 1, "", "Recognised text", 0.4), ("scan", 2, "x" * 50, None, None),
            ("native", 1, "y" * 40, None, None), ("empty", 1, " ", "\n", None),
        ],
        "document_id string, page_number int, native_text string, ocr_text string, ocr_confidence double",
    ).withColumns({"ocr_bbox": F.lit(None).cast(schemas.BBOX), "ocr_engine": F.lit("tesseract")})
    found = {r.document_id: r for r in pg.assemble_documents(pg.merge_pages(rows), "tesseract").collect()}
    assert set(found) == {"sparse", "scan", "native"}
    assert found["sparse"].fidelity_tier == "ocr_dependent" and found["sparse"].pages[0].source == "native"
    assert found["sparse"].pages[0].confidence is None
    assert [p.source for p in found["scan"].pages] == ["ocr", "native"] and found["scan"].pages[0].confidence == 0.4
    assert (found["native"].fidelity_tier, found["native"].ocr_engine) == ("full_layout", None)


def test_schema_versions_and_rules(spark):
    old = spark.createDataFrame([("ev_1", "doc_legacy", 0.5)], "id string, document_id string, retrieval_score double")
    row = schemas.evolve(old, schemas.EVIDENCE_DDL, schemas.EVIDENCE_DEFAULTS).first()
    assert (row.fidelity_tier, row.anchor_quality, row.ocr_confidence) == ("full_layout", "line", None)
    bad = spark.createDataFrame([("j1", "d", "queued", "ocr", 10), ("j2", "d", "lost", "ocr", 101)], "id string, document_id string, status string, stage string, progress_pct int")
    good, quarantined = schemas.split_valid(bad, schemas.job_rules())
    assert [r.id for r in good.collect()] == ["j1"]
    assert quarantined.first().violations == ["unknown status", "progress_pct outside 0..100"]


DOCUMENT = (
    '{"id":"doc_1","name":"a.txt","file_type":"txt","mime_type":"text/plain","size_bytes":1,"status":"ready",'
    '"fidelity_tier":"full_layout","pages":1,"category":"c","current_version_id":"v","created_at":"2024-01-01T00:00:00Z",'
    '"updated_at":"2024-01-01T00:00:00Z","tags":["x"]}'
)
EVIDENCE = (
    '{"id":"ev_1","document_id":"doc_1","document_name":"a.txt","section":"s","page":1,"line_start":1,"line_end":1,'
    '"snippet":"t","retrieval_score":0.7,"relevance":"Medium","anchor_quality":"line","fidelity_tier":"full_layout",'
    '"bbox":[0.1,0.2,0.3,0.4]}'
)


def test_state_file(spark, tmp_path):
    path = tmp_path / "state.json"
    path.write_text(f'{{"documents": [{DOCUMENT}], "evidence": [{EVIDENCE}], "updated_at": "x"}}')
    state = tables.read_state(spark, str(path))
    assert state["documents"].first().tags == ["x"] and state["jobs"].count() == 0
    assert state["evidence"].first().bbox.height == 0.4
    path.write_text(f'{{"documents": [{DOCUMENT.replace("ready", "lost")}], "evidence": [{EVIDENCE}]}}')
    assert [t.count() for t in tables.read_state(spark, str(path)).values()] == [0, 0, 0]
    path.write_text("{broken")
    assert [t.count() for t in tables.read_state(spark, str(path)).values()] == [0, 0, 0]
    assert [t.count() for t in tables.read_state(spark, str(tmp_path / "none.json")).values()] == [0, 0, 0]
    tables.write_state({"documents": state["documents"].limit(0)}, str(tmp_path / "out"))
