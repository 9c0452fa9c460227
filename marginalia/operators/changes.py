"""Table changes as DataFrame rewrites: upsert, replace by document, partial update, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows first, then the existing rows they do not replace."""
    kept = existing.join(incoming.select(key), key, "left_anti").select(*existing.columns)
    return incoming.select(*existing.columns).unionByName(kept)


def replace_by_document(existing: DataFrame, incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """Drop all rows of the given documents (document_id), then add the incoming rows.

    ``documents`` is separate from ``incoming`` because a re-indexed document may have no rows left.
    """
    kept = existing.join(documents.select("document_id").distinct(), "document_id", "left_anti")
    return kept.select(*existing.columns).unionByName(incoming.select(*existing.columns))


def delete_documents(existing: DataFrame, documents: DataFrame) -> DataFrame:
    return existing.join(documents.select("document_id").distinct(), "document_id", "left_anti").select(
        *existing.columns
    )


def apply_updates(existing: DataFrame, updates: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Partial update: non-null columns of ``updates`` win, and ``updated_at`` moves to ``now``.

    Updates for unknown keys are ignored; at most one update per key may be given.
    """
    changed = [c for c in updates.columns if c not in {key, "updated_at"}]
    patch = updates.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = existing.join(patch, key, "left")
    values = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in changed if c in existing.columns}
    if "updated_at" in existing.columns:
        values["updated_at"] = F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))
    return joined.withColumns(values).select(*existing.columns)
