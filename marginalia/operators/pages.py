"""Merging native text with recognised text, page by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.config import DEFAULTS, Settings
from marginalia.functions import text as tx


def merge_pages(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Choose the text of every page. ``rows`` needs document_id, page_number, native_text, ocr_text,
    ocr_confidence, ocr_bbox and ocr_engine (null recognition columns where no page was scanned).

    A native layer of enough characters wins. Any other page counts as scanned: recognised text if
    there is some, else the sparse native text; a page with neither is dropped (``kept`` is false).
    """
    native = tx.strip(F.coalesce("native_text", F.lit("")))
    recognised = tx.strip(F.coalesce("ocr_text", F.lit("")))
    rich = F.length("_native") >= settings.ocr_min_chars_per_page
    has_ocr = ~F.col("scanned_native") & (F.col("_ocr") != "")
    return (
        rows.withColumns({"_native": native, "_ocr": recognised})
        .withColumn("scanned_native", rich)
        .withColumns(
            {
                "scanned": ~F.col("scanned_native"),
                "text": F.when(F.col("scanned_native"), F.col("_native")).otherwise(
                    F.coalesce(F.nullif("_ocr", F.lit("")), F.nullif("_native", F.lit("")))
                ),
                "source": F.when(has_ocr, "ocr").otherwise("native"),
                "confidence": F.when(has_ocr, F.col("ocr_confidence")),
                "bbox": F.when(has_ocr, F.col("ocr_bbox")),
                "engine": F.when(has_ocr, F.col("ocr_engine")),
            }
        )
        .withColumn("kept", F.col("text").isNotNull())
        .select(
            "document_id", "page_number", "text", "source", "confidence", "bbox", "engine", "scanned", "kept"
        )
    )


def assemble_documents(merged: DataFrame, engine: str = "unavailable") -> DataFrame:
    """One parsed document per document_id; fidelity says whether recognition was *needed*.

    The page array of a document is bounded by the file-size limit of an upload.
    """
    page = F.struct("page_number", "text", "source", "confidence", "bbox", "engine").cast(schemas.PAGE)
    grouped = merged.groupBy("document_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("kept"), page))).alias("pages"),
        F.bool_or("scanned").alias("scanned"),
    )
    return grouped.filter(F.size("pages") > 0).select(
        "document_id",
        "pages",
        F.when(F.col("scanned"), "ocr_dependent").otherwise("full_layout").alias("fidelity_tier"),
        F.size("pages").alias("page_count"),
        F.when(F.col("scanned"), F.lit(engine)).alias("ocr_engine"),
    )
