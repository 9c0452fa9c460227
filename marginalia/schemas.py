"""Explicit table schemas, closed value sets, validation and additive schema evolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BBOX = "struct<x:double,y:double,width:double,height:double>"

PAGE = (
    "struct<page_number:int,text:string,source:string,confidence:double,"
    f"bbox:{BBOX},engine:string>"
)

DOCUMENT_DDL = (
    "id string, name string, file_type string, mime_type string, size_bytes bigint, status string, "
    "fidelity_tier string, pages int, category string, current_version_id string, created_at timestamp, "
    "updated_at timestamp, tags array<string>, summary string, summary_method string, summary_provider string"
)
JOB_DDL = (
    "id string, document_id string, status string, stage string, progress_pct int, "
    "error map<string,string>, created_at timestamp, updated_at timestamp"
)
EVIDENCE_DDL = (
    "id string, document_id string, document_name string, section string, page int, line_start int, line_end int, "
    "snippet string, retrieval_score double, relevance string, anchor_quality string, fidelity_tier string, "
    f"ocr_confidence double, ocr_engine string, bbox {BBOX}"
)
CONFIG_DDL = (
    "id string, role string, provider_type string, model_name string, base_url string, api_key_ref string, "
    "is_default boolean"
)


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


# Closed value sets, checked on write.
DOCUMENT_STATES = ("ready", "processing", "review", "failed")
JOB_STATES = ("queued", "processing", "ready", "failed", "cancelled")
RUNNING_STATES = ("queued", "processing")
JOB_STAGES = ("queued", "parsing", "ocr", "chunking", "summarizing", "embedding", "indexing", "ready", "failed")
FIDELITY_TIERS = ("full_layout", "structural", "ocr_dependent", "best_effort")
RELEVANCE = ("High", "Medium", "Low")
ANCHORS = ("line", "paragraph", "bbox", "cell")
SUMMARY_METHODS = ("extractive", "abstractive")
PROVIDER_TYPES = ("ollama", "openai", "anthropic", "gemini", "openai_compatible", "extractive", "keyword")

# Constants written on every indexed evidence row.
SECTION = "Imported content"
INDEX_SCORE = 0.74
INDEX_RELEVANCE = "Medium"


def _required(*names: str) -> list[tuple[str, Column]]:
    return [(f"{name} is missing", F.col(name).isNotNull()) for name in names]


def _unit_interval(name: str) -> tuple[str, Column]:
    return f"{name} outside 0..1", F.col(name).between(0, 1)


def document_rules() -> list[tuple[str, Column]]:
    return [
        *_required("id", "name", "file_type", "mime_type", "size_bytes", "status", "fidelity_tier", "pages"),
        ("size_bytes below 0", F.col("size_bytes") >= 0),
        ("pages below 1", F.col("pages") >= 1),
        ("unknown status", F.col("status").isin(*DOCUMENT_STATES)),
        ("unknown fidelity_tier", F.col("fidelity_tier").isin(*FIDELITY_TIERS)),
        ("unknown summary_method", F.col("summary_method").isNull() | F.col("summary_method").isin(*SUMMARY_METHODS)),
    ]


def job_rules() -> list[tuple[str, Column]]:
    return [
        *_required("id", "document_id", "status", "stage", "progress_pct"),
        ("unknown status", F.col("status").isin(*JOB_STATES)),
        ("unknown stage", F.col("stage").isin(*JOB_STAGES)),
        ("progress_pct outside 0..100", F.col("progress_pct").between(0, 100)),
    ]


def evidence_rules() -> list[tuple[str, Column]]:
    return [
        *_required("id", "document_id", "document_name", "section", "page", "snippet", "retrieval_score"),
        _unit_interval("retrieval_score"),
        ("ocr_confidence outside 0..1", F.col("ocr_confidence").isNull() | F.col("ocr_confidence").between(0, 1)),
        ("unknown relevance", F.col("relevance").isin(*RELEVANCE)),
        ("unknown anchor_quality", F.col("anchor_quality").isin(*ANCHORS)),
        ("unknown fidelity_tier", F.col("fidelity_tier").isin(*FIDELITY_TIERS)),
    ]


def with_violations(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add ``violations``: the messages of every broken rule (a null outcome counts as broken)."""
    flags = [F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(message)) for message, ok in rules]
    return rows.withColumn("violations", F.array_compact(F.array(*flags)))


def split_valid(rows: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their ``violations``)."""
    checked = with_violations(rows, rules)
    return (
        checked.filter(F.size("violations") == 0).drop("violations"),
        checked.filter(F.size("violations") > 0),
    )


#: Value taken by a column that an older table version did not have.
EVIDENCE_DEFAULTS = {"anchor_quality": "line", "fidelity_tier": "full_layout"}


def evolve(rows: DataFrame, ddl: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Bring a table of any older version to the current schema: columns are only ever added."""
    defaults = defaults or {}
    present = set(rows.columns)
    target = schema(ddl)

    def column(field: T.StructField) -> Column:
        if field.name in present:
            return F.col(field.name).cast(field.dataType).alias(field.name)
        return F.lit(defaults.get(field.name)).cast(field.dataType).alias(field.name)

    return rows.select(*[column(field) for field in target.fields])


def union_versions(tables: list[DataFrame], ddl: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Union tables written under different schema versions."""
    return reduce(DataFrame.unionByName, [evolve(table, ddl, defaults) for table in tables])
