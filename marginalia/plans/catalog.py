"""The query catalogue: every operator run over the whole corpus tables.

Each entry takes (spark, sf_dir) and returns a DataFrame of plain scalar columns. The matching SQL is
in ``oracle.py`` under the same key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.functions import boxes, labels
from marginalia.functions import text as tx
from marginalia.operators import cells, changes, chunking, embedding, jobs, keyword, library, ocr, pages, postings, providers, segments, summarize
from marginalia.operators import grounding as gr
from marginalia.operators.vector import vector_search, vector_search_batch
from marginalia.plans import derive
from marginalia.plans.ask import ask
from marginalia.plans.ingest import full_text, ingest, parse_files, parsed_pages
from marginalia.plans.search import collect_chunks, dedupe_hits, first_per_document, keyword_retrieve, retrieve, search
from marginalia.session import shared_dir, spread
from marginalia.sources import formats as fm
from marginalia.sources import parsers, store, tables
from marginalia.streaming import ingest as stream
from marginalia.streaming import tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The single search request of the catalogue; "content" is part of every row's section.
SEARCH_QUERY = "Thinwhst shouha content archive src7"
#: 2024-02-01 00:00:00 UTC.
NOW_MICROS = 1_706_745_600_000_000


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _r6(value: Column) -> Column:
    return F.round(value, 6)


def _now() -> Column:
    return F.timestamp_micros(F.lit(NOW_MICROS))


# --- parsing and pages -------------------------------------------------------------------------


@query
def plain_text_admission(spark, sf_dir):
    """Every document against the plain-text rules: ASCII alphanumerics and the text floor."""
    rows = derive.documents(spark, sf_dir).withColumn("clean", fm.plain_text(F.col("text")))
    return rows.select(
        "doc_id",
        tx.ascii_alnum_count(F.col("clean")).alias("alnum"),
        F.length("clean").alias("chars"),
        fm.has_enough_text(F.col("clean")).alias("admitted"),
    )


@query
def decoded_payloads(spark, sf_dir):
    """Texts as upload bytes (UTF-8 with and without a mark, or Latin-1) and back."""
    rows = derive.documents(spark, sf_dir).withColumn("kind", F.col("doc_id") % 3)
    utf8 = F.encode("text", "UTF-8")
    payload = (
        F.when(F.col("kind") == 0, utf8)
        .when(F.col("kind") == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8))
        .otherwise(F.encode("text", "ISO-8859-1"))
    )
    decoded = fm.decode(F.col("payload"))
    return rows.withColumn("payload", payload).select(
        "doc_id", F.octet_length("payload").alias("payload_bytes"), F.md5(F.encode(decoded, "UTF-8")).alias("text_md5")
    )


@query
def html_to_text(spark, sf_dir):
    rows = spread(derive.table(spark, sf_dir, "pages", "page_id", "html"), "page_id")
    return rows.select("page_id", parsers.html_text(F.col("html")).alias("text"))


@query
def csv_rows_to_text(spark, sf_dir):
    """Customers rendered as CSV records; blank cells drop out."""
    rows = derive.table(spark, sf_dir, "customer")
    cells = F.array(
        F.concat(F.lit("  "), F.col("c_name")),
        F.when(F.col("c_custkey") % 3 == 0, "   ").otherwise(F.col("c_mktsegment")),
        F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_nationkey").cast("string")),
    )
    return rows.select("c_custkey", fm.csv_line(cells).alias("line"))


@query
def csv_files_to_text(spark, sf_dir):
    """Each document as a CSV file with one quoted cell per line, parsed and joined again."""
    records = parsers.csv_records_udf(derive.csv_content(F.col("text")))
    rows = derive.documents(spark, sf_dir).select("doc_id", records.alias("records"))
    return rows.select("doc_id", F.size("records").alias("records"), F.md5(parsers.csv_text(F.col("records"))).alias("text_md5"))


@query
def file_admission(spark, sf_dir):
    """Uploads against the supported types and the size limit."""
    files = derive.library(spark, sf_dir).select("id", "name", "size_bytes")
    accepted, rejected = fm.admit(files)
    return accepted.select("id", "suffix", F.lit(201).alias("status_code"), F.lit("accepted").alias("reason_code")).unionByName(
        rejected.select("id", "suffix", "status_code", "reason_code")
    )


@query
def merged_pages(spark, sf_dir):
    """Native text, else recognised text, else the sparse native text of every page."""
    merged = pages.merge_pages(derive.recognised_pages(spark, sf_dir))
    return merged.select(
        "document_id", "page_number", "source", "scanned", "kept", _r6(F.col("confidence")).alias("confidence"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    )


@query
def merged_documents(spark, sf_dir):
    """Documents assembled from merged pages with their fidelity."""
    merged = pages.merge_pages(derive.recognised_pages(spark, sf_dir))
    return pages.assemble_documents(merged, "tesseract").select(
        "document_id", "fidelity_tier", "page_count", "ocr_engine",
        F.array_join(F.transform("pages", lambda p: p["page_number"].cast("string")), ",").alias("page_numbers"),
    )


@query
def paragraphs(spark, sf_dir):
    """Paragraphs of the corpus with a blank line after every third line."""
    lines = F.split("text", "\n")
    spaced = F.array_join(
        F.transform(lines, lambda l, i: F.when(i % 3 == 2, F.concat(l, F.lit("\n"))).otherwise(l)), "\n"
    )
    rows = derive.documents(spark, sf_dir).select("doc_id", F.posexplode(chunking.paragraphs(spaced)).alias("n", "p"))
    return rows.select(
        "doc_id",
        (F.col("n") + 1).alias("paragraph"),
        F.col("p.start_line").alias("start_line"),
        F.col("p.end_line").alias("end_line"),
        F.col("p.words").alias("words"),
        F.md5("p.text").alias("text_md5"),
    )


@query
def budget_chunks(spark, sf_dir):
    """Word-budgeted chunks with overlap, one line to a paragraph."""
    rows = derive.budget_evidence(spark, sf_dir)
    return rows.select(
        "id", "document_id", "page", "line_start", "line_end", F.length("snippet").alias("chars"),
        F.md5("snippet").alias("snippet_md5"),
    )


@query
def segmented_chunks(spark, sf_dir):
    """The chunks of ``budget_chunks`` by the segmented fold; segments are short, so that texts cross several."""
    files = derive.parsed_paragraphs(spark, sf_dir)
    texts = files.select("document_id", F.explode("parsed.pages").alias("p")).select("document_id", F.col("p.page_number").alias("page"), "p.text")
    rows = segments.chunks(segments.line_blocks(texts, 64), group=1)
    return rows.select("document_id", "ordinal", "line_start", "line_end", F.md5("text").alias("snippet_md5"))


@query
def paged_chunks(spark, sf_dir):
    """Chunks of multi-page documents: ordinals run across pages, recognised pages keep their confidence."""
    rows = derive.paged_evidence(spark, sf_dir)
    return rows.select(
        "id", "page", "line_start", "line_end", "anchor_quality", "ocr_engine",
        _r6(F.col("ocr_confidence")).alias("ocr_confidence"), F.md5("snippet").alias("snippet_md5"),
    )


@query
def evidence_rows(spark, sf_dir):
    rows = derive.evidence(spark, sf_dir)
    return rows.select(
        "id", "document_id", "document_name", "section", "page", "line_start", "line_end", "snippet",
        "retrieval_score", "relevance", "anchor_quality", "fidelity_tier",
    )


@query
def ingest_outcomes(spark, sf_dir):
    """Final document and job states of a whole-corpus ingest."""
    made = ingest(derive.parsed_documents(spark, sf_dir), now=_now())
    documents = made.document_updates.select("id", "status", "fidelity_tier", "pages", "summary_method")
    ended = made.job_updates.select(
        F.col("document_id").alias("id"), F.col("status").alias("job_status"), "stage", "progress_pct",
        F.element_at("error", "reason_code").alias("reason_code"),
    )
    return documents.join(ended, "id")


@query
def office_pages(spark, sf_dir):
    """Every document written as a Word, Excel or PowerPoint file and parsed again."""
    files = derive.office_files(spark, sf_dir)
    parsed = parsers.office_document(parsers.office_pages_udf("payload", "suffix"), F.col("suffix"))
    rows = files.select("doc_id", "suffix", parsed.alias("parsed")).select(
        "doc_id", "suffix", F.col("parsed.fidelity_tier").alias("fidelity_tier"), F.explode("parsed.pages").alias("page")
    )
    return rows.select(
        "doc_id", "suffix", "fidelity_tier", F.col("page.page_number").alias("page_number"), F.md5("page.text").alias("text_md5")
    )


@query
def dispatched_files(spark, sf_dir):
    """Uploads of seven kinds, admitted and parsed by suffix, with what became of each."""
    accepted, rejected = fm.admit(derive.mixed_files(spark, sf_dir))
    pages = F.col("parsed.pages")
    outcome = (
        F.when(pages.isNotNull(), "parsed")
        .when(F.col("suffix").isin(*fm.PREVIEWABLE_EXTENSIONS), "awaiting_pages")
        .otherwise("no_extractable_content")
    )
    parsed = parse_files(accepted).select(
        "doc_id", "suffix", outcome.alias("outcome"), F.col("parsed.fidelity_tier").alias("fidelity_tier"),
        F.col("parsed.page_count").alias("page_count"), F.md5(full_text(pages)).alias("text_md5"),
    )
    refused = rejected.select("doc_id", "suffix", F.col("reason_code").alias("outcome"))
    return parsed.unionByName(refused, allowMissingColumns=True)


def _ingested_pages(spark: SparkSession, sf_dir: str):
    uploads = parsed_pages(derive.scanned_uploads(spark, sf_dir), derive.boxed_pages(spark, sf_dir), "tesseract")
    return ingest(uploads, now=_now())


@query
def page_ingest_outcomes(spark, sf_dir):
    """Final states of uploads whose text comes as page rows; images have none yet."""
    made = _ingested_pages(spark, sf_dir)
    ended = made.job_updates.select(
        F.col("document_id").alias("id"), F.col("status").alias("job_status"),
        F.element_at("error", "reason_code").alias("reason_code"),
    )
    return made.document_updates.select("id", "status", "fidelity_tier", "pages").join(ended, "id")


@query
def page_evidence(spark, sf_dir):
    """Evidence of page rows: native and recognised pages, some of them with a box."""
    return _ingested_pages(spark, sf_dir).evidence.select(
        "id", "page", "line_start", "line_end", "anchor_quality", "fidelity_tier",
        _r6(F.col("ocr_confidence")).alias("ocr_confidence"), _r6(F.col("bbox.height")).alias("box_height"),
        F.md5("snippet").alias("snippet_md5"),
    )


def _digest_model(prompt: Column) -> Column:
    """Stands for a language model: a digest of the prompt, or words too short to be used."""
    digest = F.concat(F.lit("Digest "), F.md5(prompt), F.lit("."))
    return F.concat(F.lit("Summary: "), F.when(F.length(prompt) % 2 == 1, digest).otherwise("Too short."))


@query
def abstractive_outcomes(spark, sf_dir):
    """A whole-corpus ingest with a summary model; its words count where they are long enough."""
    made = ingest(derive.parsed_documents(spark, sf_dir), summarizer=_digest_model, summarizer_name="digest", now=_now())
    return made.document_updates.select("id", "status", "summary", "summary_method", "summary_provider")


@query
def evidence_vectors(spark, sf_dir):
    """The vector of every chunk by a pluggable model."""
    made = ingest(derive.parsed_documents(spark, sf_dir), embedder=derive.letter_model, now=_now())
    parts = [F.get("embedding", F.lit(i)).cast("int").alias(name) for i, name in enumerate(("chars", "blanks", "es"))]
    return made.vectors.select("id", "document_id", *parts)


def _stored_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus ingested into batch tables, and its evidence as search reads it."""
    root = f"{shared_dir(spark)}/library-{uuid.uuid4().hex}"
    stream.store_batch(root)(derive.parsed_documents(spark, sf_dir), 0)
    return stream.current_evidence(spark, root)


@query
def stored_keyword_search(spark, sf_dir):
    """``keyword_search`` over evidence that was stored once."""
    return _found(_stored_evidence(spark, sf_dir))


@query
def stored_answers(spark, sf_dir):
    """``ask_answers`` over evidence that was stored once."""
    return _answers(ask(_answerable(_stored_evidence(spark, sf_dir), derive.questions(spark, sf_dir))))


def _index(spark: SparkSession, sf_dir: str) -> tuple[str, postings.Index]:
    """The corpus ingested and indexed, as search on a store finds it."""
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    stream.store_batch(root)(derive.parsed_documents(spark, sf_dir), 0)
    postings.write_index(stream.current_evidence(spark, root), root, 0)
    return root, postings.read_index(spark, root, stream.DOCUMENT_COLUMNS)


@query
def indexed_keyword_search(spark, sf_dir):
    """``keyword_search`` over a stored index: no text is read but that of the hits."""
    root, index = _index(spark, sf_dir)
    asked = derive.single_question(spark, sf_dir, SEARCH_QUERY)
    hits = postings.index_search(index, asked).withColumn("similarity", F.lit(None).cast("double"))
    scores = hits.select("id", "match_score")
    found = search(collect_chunks(stream.current_evidence(spark, root), asked, hits))
    return found.join(scores, "id").select("rank", "id", "document_id", "match_score", "score", "snippet")


@query
def indexed_keyword_search_batch(spark, sf_dir):
    """``keyword_search_batch`` over a stored index, with upper bounds."""
    root, index = _index(spark, sf_dir)
    hits, _ = postings.pruned_search(index, derive.questions(spark, sf_dir), f"{root}/search")
    return hits.select("query_id", "rank", "id", "match_score")


def _edited(spark: SparkSession, sf_dir: str) -> str:
    """A store after four batches: all documents, a third edited, a seventh deleted, a fifth edited again or restored.

    Compacted after the third.
    """
    root = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    write = stream.store_batch(root, embedder=derive.letter_model)
    number = F.col("doc_id")
    write(derive.parsed_documents(spark, sf_dir), 0)
    write(derive.edited_documents(spark, sf_dir, number % 3 == 0, "aeiou"), 1)
    gone = derive.documents(spark, sf_dir).filter(number % 7 == 0).select(derive.document_id().alias("document_id"))
    stream.delete_documents(gone, root, 2)
    stream.compact(spark, root)
    write(derive.edited_documents(spark, sf_dir, number % 5 == 0, "t"), 3)
    return root


@query
def versioned_evidence(spark, sf_dir):
    """Evidence of a store whose documents were ingested again, deleted, compacted and restored."""
    rows = stream.current_evidence(spark, _edited(spark, sf_dir))
    return rows.select("id", "document_id", "document_name", "line_end", "seq", F.md5("snippet").alias("snippet_md5"))


@query
def versioned_vectors(spark, sf_dir):
    """The vectors of the same store, in step with its evidence."""
    parts = [F.get("embedding", F.lit(i)).cast("int").alias(name) for i, name in enumerate(("chars", "blanks", "es"))]
    return stream.current_vectors(spark, _edited(spark, sf_dir)).select("id", "document_id", *parts)


@query
def incremental_ingest(spark, sf_dir):
    """The corpus ingested by the stream into batch tables, then read back as current evidence."""
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    files = spark.readStream.schema("doc_id bigint, text string, source string")
    # A pattern, since the stream takes a plain path for a folder; the table may be one file or a folder of files.
    source = files.parquet(f"{sf_dir}/documents.parque[t]")
    parsed = derive.parsed_stream(source)
    stream.start_ingest(parsed, root, f"{root}/checkpoint", once=True).awaitTermination()
    rows = stream.current_evidence(spark, root)
    return rows.select("id", "document_id", "document_name", "line_end", "seq", F.md5("snippet").alias("snippet_md5"))


# --- summaries and vectors ---------------------------------------------------------------------


@query
def sentence_stats(spark, sf_dir):
    parts = tx.sentences(F.col("text"))
    long = F.filter(parts, lambda s: tx.word_count(s) >= summarize.MIN_SENTENCE_WORDS)
    return derive.documents(spark, sf_dir).select(
        "doc_id", F.size(parts).alias("sentences"), F.size(long).alias("long_sentences")
    )


@query
def extractive_summaries(spark, sf_dir):
    return derive.documents(spark, sf_dir).select("doc_id", summarize.extractive_summary(F.col("text")).alias("summary"))


@query
def model_summaries(spark, sf_dir):
    """Assistant turns as raw model summaries with a lead-in, cleaned."""
    turns = derive.table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return turns.select(
        "conv_id", "turn", summarize.clean_model_summary(F.concat(F.lit("  Summary:  "), F.col("text"))).alias("summary")
    )


@query
def summary_prompts(spark, sf_dir):
    prompt = summarize.summary_prompt(F.col("source"), F.col("text"))
    return derive.documents(spark, sf_dir).select("doc_id", F.length(prompt).alias("chars"), F.md5(prompt).alias("prompt_md5"))


@query
def hash_embeddings(spark, sf_dir):
    """The hash vector of every document, one row per non-zero bucket."""
    rows = derive.documents(spark, sf_dir).select("doc_id", F.posexplode(embedding.hash_vector(F.col("text"))).alias("bucket", "value"))
    return rows.filter(F.col("value") > 0).select("doc_id", "bucket", _r6(F.col("value")).alias("value"))


@query
def vector_topk(spark, sf_dir):
    """Nearest neighbours of the first vector."""
    vectors = derive.vectors(spark, sf_dir)
    wanted = vectors.agg(F.min_by("embedding", "seq")).first()[0]
    hits = vector_search(vectors, wanted)
    return hits.select("rank", "id", _r6(F.col("score")).alias("score"))


@query
def vector_topk_scoped(spark, sf_dir):
    """The same within two documents; the scope applies before the top-k."""
    vectors = derive.vectors(spark, sf_dir)
    wanted = vectors.agg(F.min_by("embedding", "seq")).first()[0]
    hits = vector_search(vectors, wanted, min_similarity=0.0, scope=["doc_1", "doc_2"])
    return hits.select("rank", "id", _r6(F.col("score")).alias("score"))


def _question_vectors(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """A vector stands for the conversation of the same number."""
    asked = questions.select("query_id", (F.floor(F.col("query_id") / 1000)).alias("seq"))
    return asked.join(vectors.select("seq", "embedding"), "seq").select("query_id", "embedding")


@query
def vector_topk_batch(spark, sf_dir):
    """The vector of every question that has one, against all vectors."""
    vectors = derive.vectors(spark, sf_dir)
    hits = vector_search_batch(vectors, _question_vectors(derive.questions(spark, sf_dir), vectors))
    return hits.select("query_id", "rank", "id", _r6(F.col("score")).alias("score"))


@query
def vector_cells_batch(spark, sf_dir):
    """The same hits from a stored cell index, which scores only the blocks that can hold one."""
    vectors = derive.vectors(spark, sf_dir)
    root = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    cells.build_cells(vectors, root)
    hits = cells.cell_search_batch(spark, root, _question_vectors(derive.questions(spark, sf_dir), vectors))
    return hits.select("query_id", "rank", "id", _r6(F.col("score")).alias("score"))


# --- search ------------------------------------------------------------------------------------


def _made_once(evidence: DataFrame, *columns: str) -> DataFrame:
    """What search and a query itself read of the evidence, kept in the shared folder: each reading parses all texts anew."""
    read = dict.fromkeys(["id", "seq", "document_id", "document_name", "section", "snippet", *columns])
    return store.keep(evidence.select(*read), f"{shared_dir(evidence.sparkSession)}/evidence-{uuid.uuid4().hex}")


def _found(evidence: DataFrame) -> DataFrame:
    rows = keyword_retrieve(evidence, SEARCH_QUERY)
    return rows.select("rank", "id", "document_id", "match_score", "score", "snippet")


@query
def keyword_search(spark, sf_dir):
    return _found(derive.evidence(spark, sf_dir))


def _good_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select(derive.document_id().alias("document_id"))


@query
def keyword_search_scope_postlimit(spark, sf_dir):
    """Scope after the library-wide limit: can return fewer rows than exist."""
    rows = keyword_retrieve(derive.evidence(spark, sf_dir), SEARCH_QUERY, _good_documents(spark, sf_dir), prefilter=False)
    return rows.select("rank", "id", "match_score", "score")


@query
def keyword_search_scope_prefilter(spark, sf_dir):
    rows = keyword_retrieve(derive.evidence(spark, sf_dir), SEARCH_QUERY, _good_documents(spark, sf_dir), prefilter=True)
    return rows.select("rank", "id", "match_score", "score")


@query
def keyword_search_batch(spark, sf_dir):
    """Every user turn against the whole corpus."""
    hits = keyword.keyword_search_batch(derive.evidence(spark, sf_dir), derive.questions(spark, sf_dir))
    return hits.select("query_id", "rank", "id", "match_score")


@query
def query_terms(spark, sf_dir):
    rows = derive.questions(spark, sf_dir)
    terms = keyword.query_terms_column(F.col("query"))
    return rows.select("query_id", F.size(terms).alias("terms"), F.array_join(F.sort_array(terms), " ").alias("sorted_terms"))


@query
def search_results(spark, sf_dir):
    """Deduplicated search results of every user turn."""
    evidence = _made_once(derive.evidence(spark, sf_dir), "retrieval_score")
    found = retrieve(evidence, derive.questions(spark, sf_dir), fields=("id", "document_name"))
    return search(found).select("query_id", "rank", "id", "document_name", "score")


@query
def retrieve_dedupe(spark, sf_dir):
    """Best-ranked evidence per passage key over the whole library."""
    hits = derive.evidence(spark, sf_dir).select("id", "seq", "snippet")
    return dedupe_hits(hits, order="seq").select("id", "dedupe_key")


@query
def vector_first_retrieval(spark, sf_dir):
    """Vector hits first, keyword hits for questions without any."""
    evidence = _made_once(derive.evidence(spark, sf_dir), "retrieval_score")
    vectors = derive.vectors(spark, sf_dir)
    # A vector stands for the document of the same number, too.
    placed = vectors.select(
        F.concat(F.lit("ev_"), F.col("seq").cast("string"), F.lit("_0001")).alias("id"), "seq", "document_id", "embedding"
    )
    questions = derive.questions(spark, sf_dir)
    asked = _question_vectors(questions, vectors)
    found = retrieve(evidence, questions, vectors=placed, query_vectors=asked, fields=("id",))
    return search(found).select("query_id", "rank", "id", _r6(F.col("score")).alias("score"))


# --- grounded answers --------------------------------------------------------------------------


def _as_chunk(id_: Column, snippet: Column, score: Column, ocr_confidence: Column) -> Column:
    return F.struct(
        id_.alias("id"), snippet.alias("snippet"), score.alias("score"), ocr_confidence.alias("ocr_confidence")
    )


def _single_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evidence row as the only retrieved chunk of a question."""
    rows = derive.evidence(spark, sf_dir)
    return rows.select(
        "id", "seq", "snippet",
        F.array(_as_chunk(F.col("id"), F.col("snippet"), F.col("retrieval_score"), F.col("ocr_confidence"))).alias("chunks"),
    )


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of every document as the retrieved chunks of one question."""
    rows = derive._unpacked(derive.parsed_paragraphs(spark, sf_dir)).filter(F.col("pages").isNotNull())
    made = F.transform(
        chunking.document_chunks(F.col("pages")),
        lambda c, i: _as_chunk(
            chunking.evidence_id(F.col("document_id"), i + 1),
            c["text"],
            F.lit(1.0) / (i + 1),
            F.when(i % 2 == 1, (i % 10) / 10.0),
        ),
    )
    return rows.select("document_id", made.alias("chunks"))


@query
def ask_prompts(spark, sf_dir):
    prompt = gr.ask_prompt(F.lit("What does it say?"), F.col("chunks"))
    return _single_chunk(spark, sf_dir).select("id", F.length(prompt).alias("chars"), F.md5(prompt).alias("prompt_md5"))


@query
def extractive_answers(spark, sf_dir):
    """The answer of every passage to one question, read from the prompt."""
    prompt = gr.ask_prompt(F.lit("What does it say?"), F.col("chunks"))
    return _single_chunk(spark, sf_dir).withColumn("prompt", prompt).select(
        "id", gr.answer_prompt(F.col("prompt")).alias("answer")
    )


@query
def gate_outcomes(spark, sf_dir):
    """Synthetic answers to every evidence row: valid, unknown id, no marker, declined, sparse."""
    kind = F.floor(F.col("seq") / chunking.SEQ_STRIDE) % 5
    marker = F.concat(F.lit(" [chunk:"), F.col("id"), F.lit("]."))
    opening = F.regexp_replace("snippet", r"[.!?\s]+", " ")
    raw = (
        F.when(kind == 0, F.concat(opening, marker))
        .when(kind == 1, F.concat(opening, F.lit(" [chunk:ev_missing].")))
        .when(kind == 2, F.col("snippet"))
        .when(kind == 3, F.lit("INSUFFICIENT_EVIDENCE: nothing found"))
        .otherwise(F.concat(F.col("snippet"), marker))
    )
    rows = _single_chunk(spark, sf_dir).withColumn("raw", raw)
    verdict = gr.gate(F.col("raw"), F.transform("chunks", lambda c: c["id"]))
    return rows.withColumn("verdict", verdict).select(
        "id",
        F.col("verdict.outcome").alias("outcome"),
        F.col("verdict.reason").alias("reason"),
        F.size("verdict.cited_ids").alias("cited"),
    )


@query
def citation_density(spark, sf_dir):
    """Factual and uncited sentences of every text with a marker after every fourth full stop."""
    rows = derive.evidence(spark, sf_dir)
    marked = F.array_join(
        F.transform(F.split("snippet", r"\. "), lambda s, i: F.when(i % 4 == 0, F.concat(s, F.lit(" [chunk:a]"))).otherwise(s)),
        ". ",
    )
    return rows.withColumn("density", gr.citation_density(marked)).select(
        "id", F.col("density.factual").alias("factual"), F.col("density.uncited").alias("uncited")
    )


@query
def bound_citations(spark, sf_dir):
    """Citations bound in first-cited order: last chunk first, repeats and unknown ids dropped."""
    ids = F.transform("chunks", lambda c: c["id"])
    cited = F.concat(F.reverse(ids), ids, F.array(F.lit("ev_none")))
    rows = _answered(spark, sf_dir).select(
        "document_id", F.explode(gr.bind_citations(cited, F.col("chunks"), F.col("document_id"))).alias("c")
    )
    return rows.select(
        "document_id", F.col("c.ordinal").alias("ordinal"), F.col("c.evidence_unit_id").alias("evidence_unit_id"),
        F.md5("c.snippet").alias("snippet_md5"),
    )


@query
def confidence_breakdown(spark, sf_dir):
    """Confidence where every other chunk is cited."""
    cited = F.transform(F.filter("chunks", lambda c, i: i % 2 == 0), lambda c: c["id"])
    more = F.transform(F.slice("chunks", 1, 2), lambda c: c["id"])
    scored = gr.confidence(F.col("chunks"), F.concat(cited, more), digits=6)
    return _answered(spark, sf_dir).withColumn("scored", scored).select("document_id", "scored.*")


@query
def stripped_markers(spark, sf_dir):
    turns = derive.table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    marked = F.regexp_replace("text", r"([.,])", " [chunk:ev_1] $1 ")
    return turns.select("conv_id", "turn", gr.strip_markers(marked).alias("answer"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _made_once(derive.evidence(spark, sf_dir), "retrieval_score", "ocr_confidence")
    return ask(_answerable(evidence, derive.questions(spark, sf_dir)))


def _answerable(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """Retrieved chunks as far as ``ask`` without a model reads them: sentences come from the first passages."""
    return retrieve(evidence, questions, fields=("id", "snippet", "ocr_confidence"), texts=gr.ANSWER_CHUNKS)


@query
def ask_answers(spark, sf_dir):
    """Every user turn answered end to end: retrieve, dedupe, synthesize, gate, bind, score."""
    return _answers(_responses(spark, sf_dir))


def _answers(rows: DataFrame) -> DataFrame:
    return rows.select(
        "query_id", "outcome", "answer", "refusal_reason", "retrieved_chunk_count",
        F.array_join(F.transform("citations", lambda c: c["evidence_unit_id"]), ",").alias("cited"),
        F.element_at("provider", "name").alias("provider"),
        F.element_at("diagnostic", "top_score").alias("top_score"),
        F.element_at("diagnostic", "confidence").alias("confidence"),
        F.element_at("diagnostic", "coverage").alias("coverage"),
    )


@query
def answer_stream(spark, sf_dir):
    """Tokens of every answer, in order."""
    return tokens.token_rows(_responses(spark, sf_dir)).select("query_id", "token_index", "token")


@query
def document_tokens(spark, sf_dir):
    rows = derive.documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer"))
    return tokens.token_rows(rows).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.max("token_index").alias("last_index"), F.sum(F.length("token")).alias("chars")
    )


@query
def event_stream(spark, sf_dir):
    """Event frames of every answer, parsed and put together again."""
    responses = _responses(spark, sf_dir).select("query_id", "outcome", "answer")
    whole = tokens.reassemble(tokens.event_frames(responses))
    return whole.select(
        "query_id", "streamed", F.get_json_object("record", "$.outcome").alias("outcome"),
        F.get_json_object("record", "$.answer").alias("answer"),
    )


# --- library -----------------------------------------------------------------------------------


@query
def library_list(spark, sf_dir):
    rows = library.list_documents(derive.library(spark, sf_dir), status="ready")
    return rows.select("id", "name", "status", "has_more")


@query
def library_next_page(spark, sf_dir):
    """The page after that of ``library_list``, by its last row."""
    rows = derive.library(spark, sf_dir)
    last = library.list_documents(rows, status="ready").agg(F.max("doc_seq")).first()[0]
    return library.list_documents(rows, status="ready", after_seq=last).select("id", "name", "status", "has_more")


@query
def document_lookup(spark, sf_dir):
    return library.by_id(derive.library(spark, sf_dir), "doc_7").select("id", "name", "status", "pages")


@query
def library_filter(spark, sf_dir):
    rows = library.filter_library(derive.library(spark, sf_dir), " SRC1 ", "attention")
    return rows.select("id", "name", "status")


@query
def library_stats(spark, sf_dir):
    return library.library_stats(derive.library(spark, sf_dir))


@query
def review_stats(spark, sf_dir):
    return library.review_stats(derive.library(spark, sf_dir))


@query
def document_labels(spark, sf_dir):
    now = F.timestamp_seconds(F.lit(1_704_070_800))  # an hour after the first document
    rows = library.document_records(derive.library(spark, sf_dir), now)
    # The clock part of older labels depends on the locale, so only the words are kept.
    return rows.select("id", "type", "size", "fidelity", "kind", F.regexp_extract("updated", r"\A([A-Za-z0-9 ]+)", 1).alias("updated"))


@query
def inline_files(spark, sf_dir):
    """Which stored files a browser may show inline, and which have page images."""
    rows = derive.library(spark, sf_dir)
    kind = F.col("file_type")
    return rows.select(
        "id",
        kind.isin(*fm.INLINE_SAFE_EXTENSIONS).alias("inline"),
        kind.isin(*fm.PREVIEWABLE_EXTENSIONS).alias("previewable"),
    )


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every search result of every user turn as a citation, the best one cited twice."""
    paged = _made_once(derive.paged_evidence(spark, sf_dir), "page", "ocr_confidence")
    hits = keyword.keyword_search_batch(paged, derive.questions(spark, sf_dir))
    rows = hits.join(paged.select("id", "document_id", "document_name", "page", "ocr_confidence"), "id")
    ranks = F.when(F.col("rank") == 1, F.array("rank", F.lit(100))).otherwise(F.array("rank"))
    twice = rows.withColumn("rank", F.explode(ranks))
    return twice.withColumn("document_id", F.when(F.col("query_id") % 2 == 0, F.col("document_id")))


@query
def first_hits(spark, sf_dir):
    """The best hit of every document for every user turn."""
    paged = _made_once(derive.paged_evidence(spark, sf_dir))
    hits = keyword.keyword_search_batch(paged, derive.questions(spark, sf_dir))
    results = hits.join(paged.select("id", "document_id"), "id")
    return first_per_document(results).select("query_id", "document_id", "rank", "id")


@query
def citation_groups(spark, sf_dir):
    """Citations of every answer by document; half of the answers know only document names."""
    rows = library.group_citations(_cited(spark, sf_dir), ["query_id"])
    return rows.select(
        "query_id", "group_key", "document_name", "first_rank", F.size("passages").alias("passages"),
        F.array_join(F.transform("passages", lambda p: p["id"]), ",").alias("passage_ids"),
        _r6(F.col("min_confidence")).alias("min_confidence"), "low_confidence",
    )


@query
def citation_pages(spark, sf_dir):
    groups = library.group_citations(_cited(spark, sf_dir), ["query_id"])
    return groups.select(
        "query_id", "group_key", library.page_summary(F.transform("passages", lambda p: p["page"])).alias("pages")
    )


@query
def source_totals(spark, sf_dir):
    groups = library.group_citations(_cited(spark, sf_dir), ["query_id"])
    return library.source_totals(groups, ["query_id"]).select("query_id", "label")


@query
def document_page_summary(spark, sf_dir):
    """Page ranges of every document."""
    texts = derive.documents(spark, sf_dir).select("doc_id", derive.page_texts(F.col("text")).alias("pages"))
    return texts.select("doc_id", library.page_summary(F.transform("pages", lambda p: p["page_number"])).alias("pages"))


@query
def hydrated_citations(spark, sf_dir):
    """Citations of every document chunk; odd ordinals point at evidence that is gone."""
    evidence = derive.budget_evidence(spark, sf_dir)
    n = F.col("seq") % chunking.SEQ_STRIDE
    cited = evidence.select(
        F.when(n % 2 == 0, F.col("id")).otherwise(F.concat("id", F.lit("_gone"))).alias("evidence_unit_id"),
        n.cast("int").alias("ordinal"),
        F.concat(F.lit("Cited: "), "snippet").alias("snippet"),
    )
    rows = library.hydrate_citations(cited, evidence)
    return rows.select(
        "evidence_unit_id", "ordinal", "document_name", "section", "page", "lines", "relevance", F.md5("snippet").alias("snippet_md5")
    )


# --- jobs and changes --------------------------------------------------------------------------


@query
def latest_jobs(spark, sf_dir):
    rows = jobs.latest_jobs(derive.jobs(spark, sf_dir))
    return rows.select("document_id", "id", "status", "stage", "progress_pct")


@query
def documents_with_progress(spark, sf_dir):
    rows = jobs.documents_with_progress(derive.library(spark, sf_dir), derive.jobs(spark, sf_dir))
    return rows.select("id", "status", "stage", "progress")


@query
def reconciled_jobs(spark, sf_dir):
    rows = jobs.reconcile_jobs(derive.jobs(spark, sf_dir), _now())
    return rows.select(
        "id", "status", "stage", F.element_at("error", "reason_code").alias("reason_code"),
        F.element_at("error", "stage").alias("error_stage"), F.unix_micros("updated_at").alias("updated_us"),
    )


@query
def reconciled_documents(spark, sf_dir):
    rows = jobs.reconcile_documents(derive.library(spark, sf_dir), derive.jobs(spark, sf_dir), _now())
    return rows.select("id", "status", F.unix_micros("updated_at").alias("updated_us"))


@query
def job_timelines(spark, sf_dir):
    """Every status a job of the corpus ingest goes through."""
    parsed = derive.parsed_documents(spark, sf_dir).withColumns(
        {
            "has_content": F.col("parsed").isNotNull(),
            "has_chunks": F.coalesce(chunking.has_chunks(F.col("parsed.pages")), F.lit(False)),
        }
    )
    return jobs.timeline(parsed)


@query
def retried_documents(spark, sf_dir):
    """Retry of every document that needs attention; files of every ninth document are missing."""
    rows = derive.library(spark, sf_dir)
    asked = rows.filter(F.col("status").isin("review", "failed")).select(
        F.col("id").alias("document_id"), F.concat(F.lit("retry_"), F.col("id")).alias("job_id")
    )
    kept = rows.filter(F.col("doc_seq") % 9 != 0).select(F.col("id").alias("document_id"))
    queued, _, refused = jobs.retry(rows, asked, kept, _now())
    return queued.select("document_id", "id", "status", F.lit(None).cast("string").alias("reason")).unionByName(
        refused.select("document_id", F.lit(None).cast("string").alias("id"), F.lit("refused").alias("status"), "reason")
    )


@query
def uploaded_documents(spark, sf_dir):
    """Document and job rows of all accepted uploads."""
    files = derive.library(spark, sf_dir).select("id", "name", "size_bytes", "created_at", "doc_seq")
    accepted, _ = fm.admit(files)
    made, queued = fm.upload_document_rows(
        accepted.select(
            F.col("id").alias("document_id"), F.concat(F.lit("job_"), F.col("id")).alias("job_id"), "name", "suffix",
            F.lit(None).cast("string").alias("mime_type"), "size_bytes",
            F.when(F.col("doc_seq") % 2 == 0, (F.col("doc_seq") % 5).cast("int")).alias("probed_pages"), "created_at",
        )
    )
    states = queued.select(F.col("document_id").alias("id"), F.col("status").alias("job_status"), "progress_pct")
    return made.select("id", "file_type", "mime_type", "status", "fidelity_tier", "pages").join(states, "id")


@query
def progress_reports(spark, sf_dir):
    """Page reports of every document that reach its job: odd pages are reported first, then even ones."""
    total = F.size(F.split("text", "\n"))
    every = F.sequence(F.lit(1), total)
    order = F.concat(F.filter(every, lambda p: p % 2 == 1), F.filter(every, lambda p: p % 2 == 0))
    rows = derive.documents(spark, sf_dir).select("doc_id", total.alias("total"), order.alias("reports"))
    kept = rows.select("doc_id", F.posexplode(jobs.throttle_reports(F.col("reports"), F.col("total"))).alias("n", "r"))
    return kept.select("doc_id", "n", F.col("r.page").alias("page"), F.col("r.progress_pct").alias("progress_pct"))


@query
def upserted_documents(spark, sf_dir):
    """Library with every fifth document uploaded again."""
    existing = derive.library(spark, sf_dir).select("id", "name", "status")
    again = existing.withColumn("n", F.substring("id", 5, 20).cast("bigint"))
    incoming = again.select(
        F.when(F.col("n") % 5 == 0, F.col("id")).otherwise(F.concat(F.lit("new_"), F.col("id"))).alias("id"), "name", F.lit("processing").alias("status")
    )
    return changes.upsert(existing, incoming)


@query
def replaced_evidence(spark, sf_dir):
    """Budget chunks replaced by one-chunk evidence for documents with an even number."""
    existing = derive.budget_evidence(spark, sf_dir).select("id", "document_id", "line_end")
    incoming = derive.evidence(spark, sf_dir).select("id", "document_id", "line_end", "seq")
    incoming = incoming.filter(F.floor(F.col("seq") / chunking.SEQ_STRIDE) % 2 == 0).drop("seq")
    return changes.replace_by_document(existing, incoming, incoming.select("document_id"))


@query
def updated_documents(spark, sf_dir):
    """Partial update of all documents whose newest job has ended."""
    ended = jobs.latest_jobs(derive.jobs(spark, sf_dir)).filter(F.col("status").isin("ready", "failed"))
    updates = ended.select(F.col("document_id").alias("id"), F.when(F.col("status") == "ready", "ready").otherwise("review").alias("status"))
    rows = changes.apply_updates(derive.library(spark, sf_dir), updates, _now())
    return rows.select("id", "status", F.unix_micros("updated_at").alias("updated_us"))


@query
def deleted_vectors(spark, sf_dir):
    """Vectors left after deleting the documents of label 3."""
    vectors = derive.vectors(spark, sf_dir)
    gone = vectors.filter(F.col("document_id") == "doc_3").select("document_id")
    return changes.delete_documents(vectors, gone).select("id", "document_id")


ROLE = "CASE WHEN s_suppkey % 2 = 0 THEN 'chat' ELSE 'embedding' END"


def _configs(rows: DataFrame) -> DataFrame:
    """Supplier rows as provider configurations."""
    return rows.select(
        F.concat(F.lit("cfg_"), F.col("s_suppkey").cast("string")).alias("id"),
        F.expr(ROLE).alias("role"),
        F.when(F.col("s_suppkey") % 3 == 0, "ollama").otherwise("openai").alias("provider_type"),
        F.lit("m").alias("model_name"),
        *[F.lit(None).cast("string").alias(n) for n in ("base_url", "api_key_ref")],
        (F.col("s_suppkey") % 4 == 0).alias("is_default"),
    )


@query
def remaining_configs(spark, sf_dir):
    """Configurations left after deleting one."""
    rows = _configs(derive.table(spark, sf_dir, "supplier", "s_suppkey"))
    return providers.delete_config(rows, "cfg_3").select("id", "role", "provider_type", "is_default")


@query
def demoted_configs(spark, sf_dir):
    """Configurations with the highest key of each role promoted."""
    rows = derive.table(spark, sf_dir, "supplier", "s_suppkey")
    existing = _configs(rows)
    newest = rows.groupBy(F.expr(ROLE).alias("role")).agg(F.max("s_suppkey").alias("n"))
    incoming = newest.select(
        F.concat(F.lit("cfg_"), F.col("n").cast("string")).alias("id"), "role", F.lit("ollama").alias("provider_type"),
        F.lit("m2").alias("model_name"), *[F.lit(None).cast("string").alias(n) for n in ("base_url", "api_key_ref")],
        (F.col("role") == "chat").alias("is_default"),
    )
    merged = providers.provider_list(providers.upsert_configs(existing, incoming))
    return merged.select("id", "role", "provider_type", "model_name", "is_default", "local")


@query
def installed_models(spark, sf_dir):
    """Whether each part's model name is among the installed ones of its brand."""
    rows = derive.table(spark, sf_dir, "part", "p_partkey")
    wanted = F.concat(F.lit("m"), (F.col("p_partkey") % 7).cast("string"), F.when(F.col("p_partkey") % 2 == 0, ":1b").otherwise(""))
    installed = F.array(F.lit("m1"), F.lit("m2:7b"), F.lit("m3:1b"), F.concat(F.lit("m4"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise("")))
    return rows.select("p_partkey", providers.model_installed(wanted, installed).alias("installed"))


@query
def evolved_evidence(spark, sf_dir):
    """Evidence written before the provenance columns, read together with new rows."""
    new = derive.budget_evidence(spark, sf_dir).drop("seq")
    old = derive.evidence(spark, sf_dir).select(
        F.concat(F.lit("old_"), F.col("id")).alias("id"), "document_id", "document_name", "section", "page", "line_start",
        "line_end", "snippet", "retrieval_score", "relevance", "anchor_quality",
    )
    rows = schemas.union_versions([old, new], schemas.EVIDENCE_DDL, schemas.EVIDENCE_DEFAULTS)
    return rows.select("id", "line_end", "anchor_quality", "fidelity_tier", F.isnull("ocr_engine").alias("native"))


def _damaged_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.library(spark, sf_dir).withColumns(
        {
            "status": F.when(F.col("doc_seq") % 7 == 0, "lost").otherwise(F.col("status")),
            "pages": F.when(F.col("doc_seq") % 11 == 0, 0).otherwise(F.col("pages")),
            "size_bytes": F.when(F.col("doc_seq") % 13 == 0, -1).otherwise(F.col("size_bytes")),
            **{n: F.lit(None).cast("string") for n in ("summary", "summary_method", "summary_provider")},
        }
    )


@query
def exported_state(spark, sf_dir):
    """A damaged library exported as JSON lines and read back, with the rules that its rows break."""
    root = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    tables.write_state({"documents": _damaged_library(spark, sf_dir)}, root)
    valid, bad = tables.read_exported(spark, root, "documents")
    broken = bad.withColumn("violations", F.array_join("violations", "; "))
    rows = valid.withColumn("violations", F.lit("")).unionByName(broken)
    return rows.select("id", "name", "size_bytes", "violations")


@query
def quarantined_documents(spark, sf_dir):
    """Rows of a damaged library that break a rule, with the rules they break."""
    rows = _damaged_library(spark, sf_dir)
    _, bad = schemas.split_valid(rows, schemas.document_rules())
    return bad.select("id", F.array_join("violations", "; ").alias("violations"))


# --- recognition -------------------------------------------------------------------------------


@query
def recognised_lines(spark, sf_dir):
    """Corpus words grouped to lines with confidence and box."""
    rows = ocr.lines_from_words(derive.words(spark, sf_dir), ["document_id", "page_number"])
    return rows.select(
        "document_id", "page_number", "par_num", "line_num", "first_pos", F.md5("text").alias("text_md5"),
        F.round("confidence", 9).alias("confidence"), F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"),
        F.round("bbox.width", 4).alias("width"), F.round("bbox.height", 4).alias("height"),
    )


@query
def recognised_page_texts(spark, sf_dir):
    """Pages of recognised lines: text, mean word confidence, envelope box."""
    keys = ["document_id", "page_number"]
    rows = ocr.pages_from_lines(ocr.lines_from_words(derive.words(spark, sf_dir), keys), keys, "tesseract")
    return rows.select(
        "document_id", "page_number", F.md5("ocr_text").alias("text_md5"), F.round("ocr_confidence", 9).alias("confidence"),
        F.round("ocr_bbox.x", 4).alias("x"), F.round("ocr_bbox.y", 4).alias("y"),
        F.round("ocr_bbox.width", 4).alias("width"), F.round("ocr_bbox.height", 4).alias("height"),
    )


@query
def quad_boxes(spark, sf_dir):
    rows = derive.quads(spark, sf_dir)
    box = boxes.quad_to_box(F.col("quad"), F.col("page_width"), F.col("page_height"))
    return rows.withColumn("box", box).select(
        "vec_id", F.col("box.x").alias("x"), F.col("box.y").alias("y"), F.col("box.width").alias("width"), F.col("box.height").alias("height")
    )


@query
def recognition_languages(spark, sf_dir):
    """Language setting of every document mapped to the recogniser's code."""
    rows = derive.table(spark, sf_dir, "documents", "doc_id", "lang")
    configured = F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper("lang"), F.lit("+eng"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), F.col("lang"), F.lit("x"))).otherwise("")
    return rows.select("doc_id", ocr.language_code(configured).alias("code"))


@query
def line_labels(spark, sf_dir):
    """Line ranges and confidence flags as shown beside evidence."""
    rows = derive.paged_evidence(spark, sf_dir)
    return rows.select(
        "id", labels.line_label(F.col("line_start"), F.col("line_end")).alias("lines"),
        labels.is_low_confidence(F.col("ocr_confidence")).alias("low_confidence"),
    )
