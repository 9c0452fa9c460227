"""Ingest jobs: latest per document, reconciliation, progress and final states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.schemas import RUNNING_STATES

# Progress per stage.
STAGE_PROGRESS = {
    "queued": 0, "parsing": 5, "chunking": 62, "summarizing": 72, "embedding": 82, "indexing": 92, "ready": 100,
    "failed": 100,
}
OCR_START_PCT = 5
OCR_SPAN_PCT = 55
OCR_MAX_PCT = 60
REPORT_EVERY = 5

#: Errors a job can end with.
INTERRUPTED = "A restart cut this ingest off. Ask for a retry to run it again."
NO_CONTENT = "The file was read, but it holds nothing that could be turned into text."
NO_PAGES = "The text of this file comes from a table of pages, and none has arrived yet."


def error_map(stage: Column, reason: str, message: str) -> Column:
    return F.create_map(
        F.lit("stage"), stage, F.lit("reason_code"), F.lit(reason), F.lit("human_message"), F.lit(message)
    )


def latest_jobs(jobs: DataFrame, seq: str = "seq") -> DataFrame:
    """The last inserted job of every document.

    An aggregate with map-side combine: a document with very many jobs costs one row per task.
    """
    columns = [c for c in jobs.columns if c != "document_id"]
    return (
        jobs.groupBy("document_id")
        .agg(F.max_by(F.struct(*columns), F.col(seq)).alias("job"))
        .select("document_id", *[F.col(f"job.{c}").alias(c) for c in columns])
    )


def documents_with_progress(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents with stage and progress of their latest job, shown only while processing."""
    latest = latest_jobs(jobs).select(
        F.col("document_id").alias("id"), F.col("stage").alias("_stage"), F.col("progress_pct").alias("_progress")
    )
    live = F.col("status") == "processing"
    return (
        documents.join(latest, "id", "left")
        .withColumns({"stage": F.when(live, F.col("_stage")), "progress": F.when(live, F.col("_progress"))})
        .drop("_stage", "_progress")
    )


def is_running() -> Column:
    return F.col("status").isin(*RUNNING_STATES)


def reconcile_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Fail every job left running by an earlier process; running it again changes nothing."""
    running = is_running()
    error = error_map(F.col("stage"), "interrupted", INTERRUPTED)
    return jobs.withColumns(
        {
            "error": F.when(running, error).otherwise(F.col("error")),
            "stage": F.when(running, "failed").otherwise(F.col("stage")),
            "updated_at": F.when(running, now).otherwise(F.col("updated_at")),
            "status": F.when(running, "failed").otherwise(F.col("status")),
        }
    )


def reconcile_documents(documents: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Send the documents of orphaned jobs to review. ``jobs`` is the state before reconciliation."""
    orphaned = jobs.filter(is_running()).select(F.col("document_id").alias("id")).distinct()
    marked = documents.join(orphaned.withColumn("_orphaned", F.lit(True)), "id", "left")
    hit = F.coalesce("_orphaned", F.lit(False))
    return marked.withColumns(
        {
            "status": F.when(hit, "review").otherwise(F.col("status")),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    ).drop("_orphaned")


def page_progress(current: Column, total: Column) -> Column:
    """Percent shown after page ``current`` of ``total``."""
    pct = F.lit(OCR_START_PCT) + F.floor(F.lit(OCR_SPAN_PCT) * current / F.greatest(total, F.lit(1)))
    return F.least(pct, F.lit(OCR_MAX_PCT)).cast("int")


def throttle_reports(reports: Column, total: Column) -> Column:
    """Page reports of one job that reach the job row, in order.

    ``reports`` is the array of page numbers in reporting order (bounded by the pages of one file);
    native pages may come first and scanned ones after, so numbers can go back. A report passes when
    it is the last page or at least five pages beyond the last one that passed.
    """

    def step(state: Column, page: Column) -> Column:
        passes = (page == total) | (page - state["last"] >= REPORT_EVERY)
        return F.when(
            passes,
            F.struct(page.alias("last"), F.concat(state["kept"], F.array(page)).alias("kept")),
        ).otherwise(state)

    start = F.struct(F.lit(0).cast("int").alias("last"), F.array().cast("array<int>").alias("kept"))
    return F.aggregate(
        reports, start, step, lambda s: F.transform(s["kept"], lambda p: F.struct(p.alias("page"), page_progress(p, total).alias("progress_pct")))
    )


def finish(parsed: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Final (document updates, job updates) of an ingest.

    ``parsed`` needs document_id, job_id, has_content, has_chunks, fidelity_tier, page_count,
    probed_pages and the summary struct. A file without content fails its job, as ``awaiting_pages`` where
    the optional column ``awaits_pages`` holds; a parsed file without chunks leaves its job ready and its
    document in review.
    """
    ok = F.col("has_content")
    waits = F.col("awaits_pages") if "awaits_pages" in parsed.columns else F.lit(False)
    parsing = F.lit("parsing")
    error = F.when(~ok & waits, error_map(parsing, "awaiting_pages", NO_PAGES)).when(
        ~ok, error_map(parsing, "no_extractable_content", NO_CONTENT)
    )
    documents = parsed.select(
        F.col("document_id").alias("id"),
        F.when(ok & F.col("has_chunks"), "ready").otherwise("review").alias("status"),
        F.when(ok, F.col("fidelity_tier")).alias("fidelity_tier"),
        F.when(ok, F.greatest("page_count", "probed_pages")).alias("pages"),
        F.when(ok, F.nullif(F.col("summary.text"), F.lit(""))).alias("summary"),
        F.when(ok, F.col("summary.method")).alias("summary_method"),
        F.when(ok, F.col("summary.provider")).alias("summary_provider"),
        now.alias("updated_at"),
    )
    jobs = parsed.select(
        F.col("job_id").alias("id"),
        "document_id",
        F.when(ok, "ready").otherwise("failed").alias("status"),
        F.when(ok, "ready").otherwise("failed").alias("stage"),
        F.lit(100).alias("progress_pct"),
        error.alias("error"),
        now.alias("updated_at"),
    )
    return documents, jobs


def timeline(parsed: DataFrame) -> DataFrame:
    """Status rows every job goes through, in order: (job_id, document_id, step, status, stage, progress_pct).

    ``parsed`` needs job_id, document_id, has_content and has_chunks. A file without content ends
    after parsing; the indexing step only happens with chunks. Page progress comes from
    ``throttle_reports``.
    """

    def row(stage: str) -> Column:
        status = stage if stage in {"queued", "ready", "failed"} else "processing"
        return F.struct(
            F.lit(status).alias("status"), F.lit(stage).alias("stage"), F.lit(STAGE_PROGRESS[stage]).alias("progress_pct")
        )

    started = [row("queued"), row("parsing")]
    worked = [row("chunking"), row("summarizing"), row("embedding")]
    steps = (
        F.when(~F.col("has_content"), F.array(*started, row("failed")))
        .when(F.col("has_chunks"), F.array(*started, *worked, row("indexing"), row("ready")))
        .otherwise(F.array(*started, *worked, row("ready")))
    )
    exploded = parsed.select("job_id", "document_id", F.posexplode(steps).alias("step", "at"))
    return exploded.select("job_id", "document_id", "step", "at.*")


def retry(documents: DataFrame, requested: DataFrame, stored: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queue documents for another ingest of their stored file.

    ``requested`` needs document_id and job_id (of the new job), ``stored`` the document_id of every
    stored file. Returns the new jobs, the document updates, and the refused requests with a reason.
    """
    known = documents.select(F.col("id").alias("document_id"), F.lit(True).alias("_known"))
    files = stored.select("document_id").distinct().withColumn("_stored", F.lit(True))
    checked = requested.join(known, "document_id", "left").join(files, "document_id", "left")
    accepted = checked.filter(F.col("_known") & F.col("_stored"))
    refused = checked.filter(F.col("_known").isNull() | F.col("_stored").isNull()).select(
        "document_id",
        F.when(F.col("_known").isNull(), "Document was not found.").otherwise("The stored file is missing.").alias("reason"),
    )
    jobs = accepted.select(
        F.col("job_id").alias("id"),
        "document_id",
        F.lit("queued").alias("status"),
        F.lit("queued").alias("stage"),
        F.lit(0).alias("progress_pct"),
        F.lit(None).cast("map<string,string>").alias("error"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    return jobs, accepted.select(F.col("document_id").alias("id"), F.lit("processing").alias("status")), refused


def document_status(jobs: DataFrame, document_id: str) -> DataFrame:
    """The latest job of one document; empty where it has none."""
    return jobs.filter(F.col("document_id") == document_id).orderBy(F.col("seq").desc()).limit(1)
