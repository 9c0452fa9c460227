"""From raw recognition rows to lines and pages: grouping, confidence and page envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.functions import boxes
from marginalia.functions import text as tx

# Language codes of the text recognisers, by the code users configure.
LANGUAGE_CODES = {
    "eng": "en", "en": "en", "chi_sim": "ch", "chi_tra": "chinese_cht", "ch": "ch", "zh": "ch", "fra": "fr",
    "fr": "fr", "deu": "german", "de": "german", "spa": "es", "es": "es", "por": "pt", "pt": "pt", "rus": "ru",
    "ru": "ru", "jpn": "japan", "ja": "japan", "kor": "korean", "ko": "korean", "ara": "ar", "ar": "ar",
    "hin": "hi", "hi": "hi", "ita": "it", "it": "it",
}


def language_code(configured: Column) -> Column:
    """First of ``+``-joined codes, mapped; an unknown code stays, a blank one means English."""
    first = F.lower(tx.strip(F.get(F.split(configured, r"\+"), F.lit(0))))
    table = F.create_map(*[F.lit(v) for pair in LANGUAGE_CODES.items() for v in pair])
    return F.coalesce(F.element_at(table, first), F.nullif(first, F.lit("")), F.lit("en"))


def _unit(value: Column) -> Column:
    """Clamp to 0..1; null stays null (greatest and least would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def mean_confidence(values: Column) -> Column:
    """Aggregate: mean over all recognised units, low ones included, clamped to 0..1; null if none."""
    return _unit(F.avg(values))


def envelope(bbox: str) -> Column:
    """Aggregate: the smallest box containing every non-null box; null if none."""
    left, top = F.min(f"{bbox}.x"), F.min(f"{bbox}.y")
    right = F.max(F.col(f"{bbox}.x") + F.col(f"{bbox}.width"))
    bottom = F.max(F.col(f"{bbox}.y") + F.col(f"{bbox}.height"))
    return F.when(
        left.isNotNull(),
        F.struct(left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height")),
    ).otherwise(F.lit(None).cast(schemas.BBOX))


def lines_from_words(words: DataFrame, page_keys: list[str]) -> DataFrame:
    """Recognised words grouped to lines.

    ``words`` needs the page keys, block_num, par_num, line_num, pos (reading order on the page),
    text, conf (percent; negative means unknown), left, top, width, height, and the page_width and
    page_height in pixels. Lines come in first-seen order; only one line's words are ever collected.
    """
    word = tx.strip(F.col("text"))
    rows = words.withColumn("text", word).filter(F.col("text") != "")
    known = F.when(F.col("conf") >= 0, F.col("conf") / 100.0)
    on_page = (F.first("page_width") > 0) & (F.first("page_height") > 0)
    grouped = rows.groupBy(*page_keys, "block_num", "par_num", "line_num").agg(
        F.min("pos").alias("first_pos"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda w: w["text"]), " ").alias(
            "text"
        ),
        mean_confidence(known).alias("confidence"),
        F.sum(known).alias("confidence_sum"),
        F.count(known).alias("confidence_count"),
        F.when(
            on_page,
            F.struct(
                (F.min("left") / F.first("page_width")).alias("l"),
                (F.min("top") / F.first("page_height")).alias("t"),
                (F.max(F.col("left") + F.col("width")) / F.first("page_width")).alias("r"),
                (F.max(F.col("top") + F.col("height")) / F.first("page_height")).alias("b"),
            ),
        ).alias("edges"),
    )
    edge = {name: F.col(f"edges.{name}") for name in "ltrb"}
    return grouped.withColumn(
        "bbox", boxes.box(edge["l"], edge["t"], edge["r"], edge["b"], clamp_first=False)
    ).drop("edges")


def lines_from_quads(regions: DataFrame) -> DataFrame:
    """Recognised regions (quad, text, score and page size) as lines; blank text drops out."""
    return (
        regions.withColumn("text", tx.strip(F.col("text").cast("string")))
        .filter(F.coalesce(F.col("text") != "", F.lit(False)))
        .withColumns(
            {
                "confidence": _unit(F.col("score").cast("double")),
                "bbox": boxes.quad_to_box(F.col("quad"), F.col("page_width"), F.col("page_height")),
            }
        )
        .withColumns(
            {
                "confidence_sum": F.col("confidence"),
                "confidence_count": F.col("confidence").isNotNull().cast("bigint"),
                "first_pos": F.col("pos"),
            }
        )
    )


def pages_from_lines(lines: DataFrame, page_keys: list[str], engine: str) -> DataFrame:
    """Recognised pages: text in reading order, mean confidence over units, and the envelope box."""
    total = F.sum("confidence_count")
    return lines.groupBy(*page_keys).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("first_pos", "text"))), lambda line: line["text"]), "\n"
        ).alias("ocr_text"),
        F.when(total > 0, _unit(F.sum("confidence_sum") / total)).alias("ocr_confidence"),
        envelope("bbox").alias("ocr_bbox"),
        F.lit(engine).alias("ocr_engine"),
    )
