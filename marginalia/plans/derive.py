"""Library tables derived from the driver's corpus tables, all by Spark and in full.

``documents`` is the corpus (doc_id -> document, source -> name), ``labels`` its review state,
``events`` the job log, ``conversations`` the questions, ``embeddings`` the vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.operators import chunking
from marginalia.plans import office
from marginalia.session import spread
from marginalia.sources import formats as fm

LINES_PER_PAGE = 10
#: Documents whose words one task groups; sorting them stays in memory.
DOCUMENTS_PER_PART = 2000
EXTENSIONS = ("txt", "md", "pdf", "csv", "png", "docx", "py", "exe")
MIXED = ("docx", "xlsx", "pptx", "txt", "csv", "pdf", "exe")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*columns) if columns else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rows spread over the slots by their unique id."""
    return spread(table(spark, sf_dir, "documents", "doc_id", "text", "source"), "doc_id")


def document_id() -> Column:
    return F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))


def _parsed(rows: DataFrame, text: Column) -> DataFrame:
    return rows.select(
        document_id().alias("document_id"),
        F.col("source").alias("document_name"),
        F.col("doc_id").alias("doc_seq"),
        F.concat(F.lit("job_"), F.col("doc_id").cast("string")).alias("job_id"),
        F.lit("txt").alias("suffix"),
        F.lit(1).alias("probed_pages"),
        fm.parse_plain_text(text).alias("parsed"),
    )


def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as parsed plain-text uploads."""
    return _parsed(documents(spark, sf_dir), F.col("text"))


def edited_documents(spark: SparkSession, sf_dir: str, which: Column, letters: str) -> DataFrame:
    """Some of ``parsed_documents`` with these lower-case letters made capital."""
    return _parsed(documents(spark, sf_dir).filter(which), F.translate("text", letters, letters.upper()))


def parsed_stream(rows: DataFrame) -> DataFrame:
    """``parsed_documents`` for a stream of corpus rows."""
    return _parsed(rows, F.col("text"))


def parsed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with every line made a paragraph of its own, so that word budgets matter."""
    return _parsed(documents(spark, sf_dir), F.replace("text", F.lit("\n"), F.lit("\n\n")))


def _unpacked(parsed: DataFrame) -> DataFrame:
    # A null page array explodes to no rows, so files without content need no filter of their own.
    return parsed.select(
        "document_id",
        "document_name",
        "doc_seq",
        "suffix",
        F.col("parsed.fidelity_tier").alias("fidelity_tier"),
        F.col("parsed.ocr_engine").alias("ocr_engine"),
        F.col("parsed.pages").alias("pages"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the corpus: no text has a blank line, so each document is one chunk."""
    return chunking.evidence_rows(_unpacked(parsed_documents(spark, sf_dir)))


def budget_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the corpus with lines as paragraphs."""
    return chunking.evidence_rows(_unpacked(parsed_paragraphs(spark, sf_dir)))


def page_texts(text: Column) -> Column:
    """Array of (page_number, text): ten lines to a page, each line a paragraph."""
    lines = F.split(text, "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / LINES_PER_PAGE).cast("int"))
    return F.transform(
        starts,
        lambda p: F.struct(
            (p + 1).alias("page_number"),
            F.array_join(F.slice(lines, p * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n\n").alias("text"),
        ),
    )


def paged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the corpus split into pages; even pages count as recognised text."""
    confidence = (F.col("doc_id") % 100) / 100.0

    def page(p: Column) -> Column:
        scanned = p["page_number"] % 2 == 0
        return F.struct(
            p["page_number"].alias("page_number"),
            p["text"].alias("text"),
            F.when(scanned, "ocr").otherwise("native").alias("source"),
            F.when(scanned, confidence).alias("confidence"),
            F.lit(None).cast(schemas.BBOX).alias("bbox"),
            F.when(scanned, "tesseract").alias("engine"),
        )

    rows = documents(spark, sf_dir).select(
        document_id().alias("document_id"),
        F.col("source").alias("document_name"),
        F.col("doc_id").alias("doc_seq"),
        F.lit("pdf").alias("suffix"),
        F.lit("ocr_dependent").alias("fidelity_tier"),
        F.lit("tesseract").alias("ocr_engine"),
        F.transform(page_texts(F.col("text")), page).alias("pages"),
    )
    return chunking.evidence_rows(rows)


def office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as Office files: Word, Excel and PowerPoint in turn, ten lines to a page."""
    suffix = F.get(F.array(*[F.lit(s) for s in ("docx", "xlsx", "pptx")]), (F.col("doc_id") % 3).cast("int"))
    pages = F.transform(page_texts(F.col("text")), lambda p: F.split(p["text"], "\n\n"))
    rows = documents(spark, sf_dir).select("doc_id", suffix.alias("suffix"), pages.alias("pages"))
    return rows.select("doc_id", "suffix", office.write_office_udf("pages", "suffix").alias("payload"))


def csv_content(text: Column) -> Column:
    """A CSV file of one quoted cell per line, a blank one and ``x``."""
    quoted = F.transform(
        F.split(text, "\n"), lambda l: F.concat(F.lit('"'), F.replace(l, F.lit('"'), F.lit('""')), F.lit('", , x'))
    )
    return F.array_join(quoted, "\n")


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as uploads of seven kinds in turn; the last kind is not supported."""
    suffix = F.get(F.array(*[F.lit(s) for s in MIXED]), (F.col("doc_id") % len(MIXED)).cast("int"))
    packaged = F.col("suffix").isin(*fm.OFFICE_EXTENSIONS)
    pages = F.transform(page_texts(F.col("text")), lambda p: F.split(p["text"], "\n\n"))
    rows = documents(spark, sf_dir).withColumn("suffix", suffix).withColumn("pages", F.when(packaged, pages))
    payload = (
        F.when(packaged, office.write_office_udf("pages", "suffix"))
        .when(F.col("suffix") == "csv", F.encode(csv_content(F.col("text")), "UTF-8"))
        .otherwise(F.encode("text", "UTF-8"))
    )
    return rows.select(
        "doc_id",
        F.concat(F.lit("file."), F.col("suffix")).alias("name"),
        payload.alias("payload"),
        F.octet_length("text").alias("size_bytes"),
    )


def scanned_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a PDF upload, and as an image of which no pages are known."""
    rows = table(spark, sf_dir, "documents", "doc_id", "source")

    def uploads(prefix: str, suffix: str) -> DataFrame:
        number = F.col("doc_id").cast("string")
        return rows.select(
            F.concat(F.lit(prefix), number).alias("document_id"),
            F.col("source").alias("document_name"),
            F.col("doc_id").alias("doc_seq"),
            F.concat(F.lit(f"job_{prefix}"), number).alias("job_id"),
            F.lit(suffix).alias("suffix"),
            F.lit(1).alias("probed_pages"),
        )

    return uploads("doc_", "pdf").unionByName(uploads("img_", "png"))


def boxed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recognised_pages`` with a box on even pages whose number is not divisible by 3."""
    page = F.col("page_number")
    box = F.struct(
        F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.5).alias("width"), (page / 1000.0).alias("height")
    ).cast(schemas.BBOX)
    return recognised_pages(spark, sf_dir).withColumn("ocr_bbox", F.when((page % 2 == 0) & (page % 3 != 0), box))


def letter_model():
    """A deterministic stand-in for an embedding model: characters, blanks and letters e of a text."""
    return lambda texts: [[len(t), t.count(" "), t.count("e")] for t in texts]


def recognised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a native layer and a recognition result: odd pages are rich, pages divisible by 4
    have no recognised text, the other even pages have a sparse native layer."""
    page = F.col("page.page_number")
    body = F.col("page.text")
    return (
        documents(spark, sf_dir)
        .select("doc_id", F.explode(page_texts(F.col("text"))).alias("page"))
        .select(
            document_id().alias("document_id"),
            page.alias("page_number"),
            F.when(page % 2 == 1, body).when(page % 4 == 0, F.substring(body, 1, 10)).otherwise("").alias("native_text"),
            F.when((page % 2 == 0) & (page % 4 != 0), F.replace(body, F.lit("e"), F.lit("E"))).alias("ocr_text"),
            F.when(page % 2 == 0, (F.col("doc_id") % 100) / 100.0).alias("ocr_confidence"),
            F.lit(None).cast(schemas.BBOX).alias("ocr_bbox"),
            F.lit("tesseract").alias("ocr_engine"),
        )
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a question."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return turns.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query")
    )


def single_question(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """One request in the place of the user turns."""
    return questions(spark, sf_dir).agg(F.min("query_id").alias("query_id")).select("query_id", F.lit(query).alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "embeddings"), "vec_id")
    return rows.select(
        F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("id"),
        F.col("vec_id").alias("seq"),
        F.concat(F.lit("doc_"), F.col("label").cast("string")).alias("document_id"),
        "embedding",
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rows: the state comes from the labels, the tier from the language."""
    rows = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    extensions = F.array(*[F.lit(e) for e in EXTENSIONS])
    extension = F.get(extensions, (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    created = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id"))
    return rows.join(labels, "doc_id", "left").select(
        document_id().alias("id"),
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), extension).alias("name"),
        extension.alias("file_type"),
        F.lit("application/octet-stream").alias("mime_type"),
        (F.col("n_chars") * 997).alias("size_bytes"),
        F.when(F.col("toxic") == 1, "failed")
        .when(F.col("quality") == 1, "ready")
        .when(F.col("quality") == 0, "review")
        .otherwise("processing")
        .alias("status"),
        F.when(F.col("lang") == "en", "full_layout")
        .when(F.col("lang") == "de", "ocr_dependent")
        .when(F.col("lang") == "fr", "structural")
        .otherwise("best_effort")
        .alias("fidelity_tier"),
        (F.floor(F.col("n_chars") / 1000) + 1).cast("int").alias("pages"),
        F.lit("New upload").alias("category"),
        F.concat(F.lit("ver_"), F.col("doc_id").cast("string")).alias("current_version_id"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.col("doc_id").alias("doc_seq"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a job log: an event is a job of its user's document."""
    rows = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    kind = F.col("event_type")
    stage = (
        F.when(kind == "signup", "queued")
        .when(kind == "view", "parsing")
        .when(kind == "click", "ocr")
        .when(kind == "purchase", "ready")
        .otherwise("failed")
    )
    return rows.select(
        F.concat(F.lit("job_"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("doc_"), F.col("user_id").cast("string")).alias("document_id"),
        F.when(stage.isin("queued", "ready", "failed"), stage).otherwise("processing").alias("status"),
        stage.alias("stage"),
        F.when(stage == "queued", 0)
        .when(stage == "parsing", 5)
        .when(stage == "ocr", 30)
        .otherwise(100)
        .alias("progress_pct"),
        F.lit(None).cast("map<string,string>").alias("error"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        F.col("event_id").alias("seq"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as recognised words: five lines to a paragraph, forty to a page.

    Texts are dealt by document before they are taken apart, so that grouping by document, page and line moves no words.
    """
    rows = table(spark, sf_dir, "documents", "doc_id", "text")
    parts = max(spark.sparkContext.defaultParallelism * 2, -(-rows.count() // DOCUMENTS_PER_PART))
    rows = rows.select(document_id().alias("document_id"), "text").repartition(parts, "document_id")
    lines = rows.select("document_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    exploded = lines.select("document_id", "line", F.posexplode(F.split("body", " ")).alias("n", "text"))
    return exploded.select(
        "document_id",
        (F.floor(F.col("line") / 40) + 1).cast("int").alias("page_number"),
        F.lit(1).alias("block_num"),
        F.floor(F.col("line") / 5).cast("int").alias("par_num"),
        (F.col("line") % 5).alias("line_num"),
        (F.col("line").cast("bigint") * 100_000 + F.col("n")).alias("pos"),
        "text",
        ((F.length("text") * 37 + F.col("n")) % 120 - 10).cast("double").alias("conf"),
        (F.col("n") * 50).cast("double").alias("left"),
        ((F.col("line") % 40) * 30).cast("double").alias("top"),
        (F.length("text") * 8).cast("double").alias("width"),
        F.lit(16.0).alias("height"),
        F.lit(2000.0).alias("page_width"),
        F.lit(1100.0).alias("page_height"),
    )


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight numbers of every vector as a four-point polygon on a page of 0.2 x 0.1."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    number = [F.get("embedding", F.lit(i)).cast("double") for i in range(8)]
    return rows.select(
        "vec_id",
        F.array(*[F.array(number[2 * i], number[2 * i + 1]) for i in range(4)]).alias("quad"),
        F.lit(0.2).alias("page_width"),
        F.lit(0.1).alias("page_height"),
    )
