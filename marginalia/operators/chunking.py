"""Page text -> paragraphs -> word-budgeted chunks, as array expressions inside one row.

Everything here is a narrow projection: a document row carries its pages, the chunk array is built
in place and exploded once, so chunk ordinals need no window and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.config import DEFAULTS, Settings
from marginalia.functions import text as tx
from marginalia.functions.text import let


def paragraphs(text: Column) -> Column:
    """Array of (start_line, end_line, text, words); blank lines separate paragraphs."""
    return let(tx.lines(text), line_runs)


def line_runs(rows: Column) -> Column:
    """``paragraphs`` of an array of stripped lines.

    A paragraph is the run between two neighbouring blank positions, where position 0 and the
    position after the last line count as blank. That keeps the work linear in the text.
    """
    last = F.size(rows) + 1
    blank_at = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: (i == 0) | (i == last) | (F.get(rows, i - 1) == ""),
    )

    def between(gaps: Column) -> Column:
        edges = F.arrays_zip(gaps.alias("before"), F.slice(gaps, F.lit(2), F.size(gaps) - 1).alias("after"))
        runs = F.filter(edges, lambda e: e["after"] - e["before"] > 1)
        return F.transform(
            runs,
            lambda e: let(
                F.array_join(F.slice(rows, e["before"] + 1, e["after"] - e["before"] - 1), " "),
                lambda body: F.struct(
                    (e["before"] + 1).alias("start_line"),
                    (e["after"] - 1).alias("end_line"),
                    body.alias("text"),
                    tx.word_count(body).alias("words"),
                ),
            ),
        )

    return let(blank_at, between)


def chunk_bounds(counts: Column, budget: int, overlap: int) -> Column:
    """Greedy fold over paragraph word counts -> array of (first, last), 1-based inclusive.

    A group closes when the next paragraph would exceed ``budget``; the longest tail of the closed
    group with at most ``overlap`` words opens the next one. ``counts`` must not be empty.
    """

    def tail(start: Column, i: Column) -> Column:
        # Every paragraph has at least one word, so no tail reaches back more than `overlap` entries.
        low = F.greatest(start, i - overlap)
        return F.aggregate(
            F.reverse(F.slice(counts, low, i - low)),
            F.struct(F.lit(0).alias("taken"), F.lit(0).alias("words"), F.lit(True).alias("open")),
            lambda acc, n: F.when(
                acc["open"] & (acc["words"] + n <= overlap),
                F.struct(
                    (acc["taken"] + 1).alias("taken"), (acc["words"] + n).alias("words"), F.lit(True).alias("open")
                ),
            ).otherwise(F.struct(acc["taken"].alias("taken"), acc["words"].alias("words"), F.lit(False).alias("open"))),
        )

    def step(state: Column, i: Column) -> Column:
        n = F.get(counts, i - 1)
        closes = (i > state["first"]) & (state["words"] + n > budget)
        return F.when(
            closes,
            let(
                tail(state["first"], i),
                lambda kept: F.struct(
                    (i - kept["taken"]).alias("first"),
                    (kept["words"] + n).alias("words"),
                    F.concat(
                        state["done"], F.array(F.struct(state["first"].alias("first"), (i - 1).alias("last")))
                    ).alias("done"),
                ),
            ),
        ).otherwise(
            F.struct(state["first"].alias("first"), (state["words"] + n).alias("words"), state["done"].alias("done"))
        )

    start = F.struct(
        F.lit(1).alias("first"),
        F.lit(0).alias("words"),
        F.array().cast("array<struct<first:int,last:int>>").alias("done"),
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.size(counts)),
        start,
        step,
        lambda state: F.concat(
            state["done"], F.array(F.struct(state["first"].alias("first"), F.size(counts).alias("last")))
        ),
    )


def page_chunks(text: Column, budget: int, overlap: int) -> Column:
    """Chunks of one page: array of (line_start, line_end, text). Never crosses the page."""

    def assemble(paras: Column) -> Column:
        bounds = let(paras["words"], lambda counts: chunk_bounds(counts, budget, overlap))
        return F.transform(
            bounds,
            lambda b: F.struct(
                F.get(paras, b["first"] - 1)["start_line"].alias("line_start"),
                F.get(paras, b["last"] - 1)["end_line"].alias("line_end"),
                F.array_join(F.slice(paras["text"], b["first"], b["last"] - b["first"] + 1), " ").alias("text"),
            ),
        )

    empty = F.array().cast("array<struct<line_start:int,line_end:int,text:string>>")
    return let(paragraphs(text), lambda paras: F.when(F.size(paras) == 0, empty).otherwise(assemble(paras)))


def anchor_quality(suffix: Column, fidelity_tier: Column) -> Column:
    """How precisely evidence of a document can be located."""
    return F.when(suffix == "xlsx", "cell").when(fidelity_tier == "structural", "line").otherwise("paragraph")


def document_chunks(pages: Column, settings: Settings = DEFAULTS) -> Column:
    """All chunks of a document's page array, in page order."""

    def of_page(page: Column) -> Column:
        scanned = page["source"] == "ocr"
        return F.transform(
            page_chunks(page["text"], settings.chunk_max_words, settings.chunk_overlap_words),
            lambda c: F.struct(
                page["page_number"].alias("page"),
                c["line_start"].alias("line_start"),
                c["line_end"].alias("line_end"),
                c["text"].alias("text"),
                F.when(scanned, page["confidence"]).alias("ocr_confidence"),
                F.when(scanned, page["bbox"]).alias("bbox"),
            ),
        )

    return F.flatten(F.transform(pages, of_page))


def has_chunks(pages: Column) -> Column:
    """Whether ``document_chunks`` is non-empty: some page has a non-blank character."""
    return F.exists(pages, lambda p: tx.strip(p["text"]) != "")


#: Room for chunk ordinals inside ``seq``.
SEQ_STRIDE = 1_000_000


def evidence_rows(documents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One evidence row per chunk.

    ``documents`` needs document_id, document_name, doc_seq, suffix, fidelity_tier, ocr_engine and
    pages. ``seq`` gives the insertion order that every ranking breaks its ties with.
    """
    chunked = documents.select(
        "document_id",
        "document_name",
        "doc_seq",
        "suffix",
        "fidelity_tier",
        "ocr_engine",
        F.posexplode(document_chunks(F.col("pages"), settings)).alias("position", "chunk"),
    )
    ordinal = F.col("position") + 1
    return chunked.select(
        evidence_id(F.col("document_id"), ordinal).alias("id"),
        "document_id",
        "document_name",
        F.lit(schemas.SECTION).alias("section"),
        F.col("chunk.page").alias("page"),
        F.col("chunk.line_start").alias("line_start"),
        F.col("chunk.line_end").alias("line_end"),
        F.col("chunk.text").alias("snippet"),
        F.lit(schemas.INDEX_SCORE).alias("retrieval_score"),
        F.lit(schemas.INDEX_RELEVANCE).alias("relevance"),
        F.when(F.col("chunk.bbox").isNotNull(), "bbox")
        .otherwise(anchor_quality(F.col("suffix"), F.col("fidelity_tier")))
        .alias("anchor_quality"),
        "fidelity_tier",
        F.col("chunk.ocr_confidence").alias("ocr_confidence"),
        F.when(F.col("chunk.ocr_confidence").isNotNull(), F.col("ocr_engine")).alias("ocr_engine"),
        F.col("chunk.bbox").alias("bbox"),
        (F.col("doc_seq") * SEQ_STRIDE + ordinal).alias("seq"),
    )


def evidence_id(document_id: Column, ordinal: Column) -> Column:
    """``ev_<document id without doc_>_<ordinal, at least four digits>``."""
    return F.format_string("ev_%s_%04d", F.regexp_replace(document_id, r"\Adoc_", ""), ordinal)


def number_chunks(chunks: DataFrame) -> DataFrame:
    """Ordinals for chunks that arrive as separate rows.

    Needs document_id, page and seq_in_page. Only used where pages of one document come from
    different rows; ``evidence_rows`` numbers chunks without a shuffle.
    """
    order = W.partitionBy("document_id").orderBy("page", "seq_in_page")
    return chunks.withColumn("ordinal", F.row_number().over(order))
