"""File-format rules: extension sets, admission, decoding and the plain-text page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.config import DEFAULTS, Settings
from marginalia.functions import text as tx
from marginalia.functions.text import let

# File extensions by family.
CODE_EXTENSIONS = [
    "ts", "tsx", "js", "jsx", "py", "java", "c", "cpp", "cc", "h", "hpp",
    "cs", "go", "rs", "sql", "css", "sh", "rb", "php", "kt", "swift",
]
STRUCTURED_TEXT_EXTENSIONS = ["json", "xml", "yaml", "yml"]
PLAIN_TEXT_EXTENSIONS = ["txt", "md"]
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "webp", "tiff", "tif", "bmp"]
HTML_EXTENSIONS = ["html", "htm"]
OFFICE_EXTENSIONS = ["docx", "xlsx", "pptx"]
TEXT_EXTENSIONS = CODE_EXTENSIONS + STRUCTURED_TEXT_EXTENSIONS + PLAIN_TEXT_EXTENSIONS
SUPPORTED_EXTENSIONS = ["pdf", "csv", *OFFICE_EXTENSIONS, *HTML_EXTENSIONS, *TEXT_EXTENSIONS, *IMAGE_EXTENSIONS]
PREVIEWABLE_EXTENSIONS = ["pdf", *IMAGE_EXTENSIONS]
INLINE_SAFE_EXTENSIONS = ["pdf", "png", "jpg", "jpeg", "webp", "bmp", "csv", *TEXT_EXTENSIONS]

MIN_ALNUM = 20


def suffix_of(name: Column) -> Column:
    """Lower-case extension without the dot; '' for none, a leading or a trailing dot."""
    base = F.regexp_replace(name, r"\A.*/", "")
    return F.lower(F.regexp_extract(base, r"(?s)[^.].*\.([^.]+)\z", 1))


def has_enough_text(text: Column) -> Column:
    """At least twenty ASCII letters or digits."""
    return tx.has_ascii_alnum(text, MIN_ALNUM)


def decode(payload: Column) -> Column:
    """Bytes as text: UTF-8 (byte-order mark dropped) where valid, else Latin-1, which never fails."""
    utf8 = F.is_valid_utf8(payload.cast("string"))
    return F.when(utf8, F.regexp_replace(payload.cast("string"), "\\A\ufeff", "")).otherwise(
        F.decode(payload, "ISO-8859-1")
    )


def admit(files: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) uploads. ``files`` needs name and size_bytes.

    Rejected rows carry ``status_code`` and ``reason_code``; the type is checked before the size.
    """
    checked = files.withColumn("suffix", suffix_of(F.col("name"))).withColumn(
        "reason_code",
        F.when(~F.col("suffix").isin(*SUPPORTED_EXTENSIONS), "unsupported_file_type").when(
            F.col("size_bytes") > settings.max_file_size, "file_too_large"
        ),
    )
    # The plain size predicate repeats part of the reason so that it reaches the file scan, which then
    # never opens an oversized file.
    fitting = checked.filter(F.col("size_bytes") <= settings.max_file_size)
    accepted = fitting.filter(F.col("reason_code").isNull()).drop("reason_code")
    rejected = checked.filter(F.col("reason_code").isNotNull()).withColumn(
        "status_code", F.when(F.col("reason_code") == "file_too_large", 413).otherwise(415)
    )
    return accepted, rejected


def upload_document_rows(accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document and queued-job rows of accepted uploads.

    ``accepted`` needs document_id, job_id, name, suffix, mime_type, size_bytes, probed_pages and
    created_at.
    """
    documents = accepted.select(
        F.col("document_id").alias("id"),
        F.coalesce(F.nullif("name", F.lit("")), F.lit("Untitled file")).alias("name"),
        F.col("suffix").alias("file_type"),
        F.coalesce("mime_type", F.lit("application/octet-stream")).alias("mime_type"),
        F.col("size_bytes").cast("bigint").alias("size_bytes"),
        F.lit("processing").alias("status"),
        F.when(F.col("suffix").isin(*IMAGE_EXTENSIONS), "ocr_dependent").otherwise("structural").alias("fidelity_tier"),
        F.greatest(F.coalesce("probed_pages", F.lit(1)), F.lit(1)).cast("int").alias("pages"),
        F.lit("New upload").alias("category"),
        F.concat(F.lit("ver_"), F.sha2("document_id", 256)).alias("current_version_id"),
        "created_at",
        F.col("created_at").alias("updated_at"),
        F.array().cast("array<string>").alias("tags"),
        *[F.lit(None).cast("string").alias(n) for n in ("summary", "summary_method", "summary_provider")],
    )
    jobs = accepted.select(
        F.col("job_id").alias("id"),
        "document_id",
        F.lit("queued").alias("status"),
        F.lit("queued").alias("stage"),
        F.lit(0).alias("progress_pct"),
        F.lit(None).cast("map<string,string>").alias("error"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )
    return documents, jobs


#: What every parser returns; null when the file has no usable content.
PARSED = f"struct<pages:array<{schemas.PAGE}>,fidelity_tier:string,page_count:int,ocr_engine:string>"


def native_page(number: Column, text: Column) -> Column:
    return F.struct(
        number.cast("int").alias("page_number"),
        text.alias("text"),
        F.lit("native").alias("source"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast(schemas.BBOX).alias("bbox"),
        F.lit(None).cast("string").alias("engine"),
    )


def single_page(text: Column, tier: str) -> Column:
    """Parsed document of one native page, or null below the text floor."""
    return F.when(
        has_enough_text(text),
        F.struct(
            F.array(native_page(F.lit(1), text)).alias("pages"),
            F.lit(tier).alias("fidelity_tier"),
            F.lit(1).alias("page_count"),
            F.lit(None).cast("string").alias("ocr_engine"),
        ),
    )


def plain_text(text: Column) -> Column:
    """Plain text without control characters."""
    return tx.clean_control(text)


def parse_plain_text(text: Column) -> Column:
    """Parsed document of decoded plain text, code, JSON, XML or YAML (none is parsed structurally)."""
    return let(plain_text(text), lambda cleaned: single_page(cleaned, "full_layout"))


def csv_line(cells: Column) -> Column:
    """One CSV record as text: stripped non-blank cells joined by `` | ``."""
    return F.array_join(F.filter(F.transform(cells, tx.strip), lambda cell: cell != ""), " | ")
