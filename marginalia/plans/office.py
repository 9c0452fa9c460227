"""Minimal Office packages made from corpus lines, as input for the package parsers."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.sources import parsers

WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
DRAW = (
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" '
    'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
)
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELATIONS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def _package(parts: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body in parts.items():
            archive.writestr(name, body)
    return buffer.getvalue()


def _relations(targets: list[str]) -> str:
    rows = "".join(f'<Relationship Id="rId{n}" Target="{t}"/>' for n, t in enumerate(targets, start=1))
    return f"<Relationships {RELATIONS}>{rows}</Relationships>"


def write_docx(pages: list[list[str]]) -> bytes:
    page_break = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
    body = page_break.join(
        "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in page) for page in pages
    )
    return _package({"word/document.xml": f"<w:document {WORD}><w:body>{body}</w:body></w:document>"})


def write_xlsx(pages: list[list[str]]) -> bytes:
    """One sheet per page; each line is a row of the text and its number."""
    sheets = "".join(f'<sheet name="S{n}" sheetId="{n}" r:id="rId{n}"/>' for n in range(1, len(pages) + 1))
    parts = {
        "xl/workbook.xml": f'<workbook {SHEET} xmlns:r="{LINK}"><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _relations([f"worksheets/sheet{n}.xml" for n in range(1, len(pages) + 1)]),
    }
    for number, page in enumerate(pages, start=1):
        rows = "".join(
            f'<row><c t="inlineStr"><is><t>{escape(line)}</t></is></c><c><v>{n}</v></c></row>'
            for n, line in enumerate(page, start=1)
        )
        parts[f"xl/worksheets/sheet{number}.xml"] = f"<worksheet {SHEET}><sheetData>{rows}</sheetData></worksheet>"
    return _package(parts)


def write_pptx(pages: list[list[str]]) -> bytes:
    slides = "".join(f'<p:sldId id="{255 + n}" r:id="rId{n}"/>' for n in range(1, len(pages) + 1))
    parts = {
        "ppt/presentation.xml": f'<p:presentation {DRAW} xmlns:r="{LINK}"><p:sldIdLst>{slides}</p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _relations([f"slides/slide{n}.xml" for n in range(1, len(pages) + 1)]),
    }
    for number, page in enumerate(pages, start=1):
        lines = "".join(f"<a:p><a:r><a:t>{escape(line)}</a:t></a:r></a:p>" for line in page)
        parts[f"ppt/slides/slide{number}.xml"] = (
            f"<p:sld {DRAW}><p:cSld><p:spTree><p:sp><p:txBody>{lines}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>"
        )
    return _package(parts)


WRITERS = {"docx": write_docx, "xlsx": write_xlsx, "pptx": write_pptx}


def _written(pages: list[list[str]] | None, suffix: str | None) -> bytes | None:
    return None if pages is None else WRITERS[suffix](pages)


@F.arrow_udf(T.BinaryType())
def write_office_udf(pages: pa.Array, suffix: pa.Array) -> pa.Array:
    return parsers.in_slices(_written, pa.binary(), pages, suffix)
