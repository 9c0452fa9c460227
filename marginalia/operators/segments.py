"""Word-budgeted chunks of texts too long for one row: the fold of ``chunking`` cut into segments.

A text is a table of line blocks. Paragraphs are numbered by running counts over one narrow row per block, so
a paragraph may cross any number of blocks. Groups of ``GROUP`` consecutive paragraphs, each with the few
before it that an open chunk can hold, are then folded in two passes:

1. every group maps each possible entry (the number of paragraphs already open before it) to its exit and to
   the number of chunks it closes; all groups at once;
2. a running composition over these maps, one small row per group, gives every group its true entry;
3. every group cuts its chunks from there; all groups at once.

No task holds more of a text than one block or one group (and a paragraph, which is part of one value of the
result). Results equal ``chunking.page_chunks``.

Defined cases: null and blank texts have no chunks; (document_id, page) names one text; null ids are a name
like any other; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.config import DEFAULTS, Settings
from marginalia.functions import text as tx
from marginalia.functions.text import let
from marginalia.operators.chunking import line_runs
from marginalia.session import shared_dir
from marginalia.sources import store

#: Lines in a block, paragraphs in a group.
BLOCK, GROUP = 4096, 4096
_TEXT = ["document_id", "page"]


def line_blocks(texts: DataFrame, size: int = BLOCK) -> DataFrame:
    """(document_id, page, block, lines) of ``texts`` (document_id, page, text)."""

    def cut(rows: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / size).cast("int"))
        return F.transform(starts, lambda b: F.slice(rows, b * size + 1, F.lit(size)))

    rows = texts.filter(F.col("text").isNotNull())
    return rows.select(*_TEXT, F.posexplode(let(tx.lines(F.col("text")), cut)).alias("block", "lines"))


def file_blocks(spark: SparkSession, path: str, size: int = BLOCK) -> DataFrame:
    """``line_blocks`` of text files (UTF-8), each read by as many tasks as it has splits.

    The name of a file is its document_id, its page is 1. A block is named by its split's position in the
    file and its number in the split. Control characters become spaces, as in plain-text parsing.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("document_id"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    # Rows of one split come in file order from one task.
    n = F.row_number().over(W.partitionBy("document_id", "start").orderBy("at"))
    rows = rows.withColumn("n", n).withColumn("part", F.floor((F.col("n") - 1) / size))
    first = (F.col("start") == 0) & (F.col("n") == 1)
    value = F.when(first, F.regexp_replace("value", "\\A\ufeff", "")).otherwise(F.col("value"))
    lines = F.array_sort(F.collect_list(F.struct("n", tx.lines(tx.clean_control(value)).alias("lines"))))
    blocks = rows.groupBy("document_id", "start", "part").agg(F.flatten(lines["lines"]).alias("lines"))
    return blocks.select("document_id", F.lit(1).alias("page"), F.struct("start", "part").alias("block"), "lines")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, nulls included."""
    named = right.select(*[F.col(k).alias(f"{k}_") for k in keys], *[c for c in right.columns if c not in keys])
    met = [left[k].eqNullSafe(named[f"{k}_"]) for k in keys]
    return left.join(named, met).drop(*[f"{k}_" for k in keys])


def paragraph_pieces(blocks: DataFrame) -> DataFrame:
    """(document_id, page, paragraph, start_line, end_line, words, text), numbered over the whole text.

    Paragraphs count from 0. One that crosses blocks is a piece in each of them.
    """
    lines = F.col("lines")
    runs = F.size(F.filter(lines, lambda x, i: (x != "") & ((i == 0) | (F.get(lines, i - 1) == ""))))
    order = W.partitionBy(*_TEXT).orderBy("block")
    earlier = order.rowsBetween(W.unboundedPreceding, W.currentRow - 1)
    known = blocks.select(
        *_TEXT,
        "block",
        F.size("lines").cast("long").alias("n"),
        runs.cast("long").alias("runs"),
        (lines[0] != "").alias("opens"),
        (F.element_at("lines", -1) != "").alias("ends"),
    )
    known = known.withColumn("goes_on", (F.col("opens") & F.lag("ends", 1, False).over(order)).cast("long"))
    known = known.select(
        *_TEXT,
        "block",
        "goes_on",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum(F.col("runs") - F.col("goes_on")).over(earlier), F.lit(0)).alias("before"),
    )
    rows = _same(blocks, known, [*_TEXT, "block"])
    rows = rows.select(*_TEXT, "goes_on", "lines_before", "before", F.posexplode(line_runs(lines)).alias("k", "run"))
    return rows.select(
        *_TEXT,
        (F.col("before") + F.col("k") - F.col("goes_on")).alias("paragraph"),
        (F.col("lines_before") + F.col("run.start_line")).alias("start_line"),
        (F.col("lines_before") + F.col("run.end_line")).alias("end_line"),
        F.col("run.words").alias("words"),
        F.col("run.text").alias("text"),
    )


def _groups(pieces: DataFrame, size: int, open_most: int) -> DataFrame:
    """(document_id, page, group, paragraphs): the group's own and up to ``open_most`` before them."""
    own = F.floor(F.col("paragraph") / size)
    near_end = F.col("paragraph") % size >= size - open_most
    rows = pieces.withColumn("group", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))
    # One exchange serves both aggregates.
    rows = rows.repartition(*_TEXT, "group").groupBy(*_TEXT, "group", "paragraph")
    rows = rows.agg(
        F.min("start_line").alias("start_line"),
        F.max("end_line").alias("end_line"),
        F.sum("words").alias("words"),
        F.array_join(F.array_sort(F.collect_list(F.struct("start_line", "text")))["text"], " ").alias("text"),
    )
    fields = F.struct("paragraph", "start_line", "end_line", "words", "text")
    rows = rows.groupBy(*_TEXT, "group").agg(F.array_sort(F.collect_list(fields)).alias("paragraphs"))
    # The copies after a text's last group stand alone.
    return rows.filter(F.element_at("paragraphs", -1)["paragraph"] >= F.col("group") * size)


def _closings(ends: list[int], first: int, at: int, budget: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(first, close, next first): chunks first..close-1 closed when paragraph ``close`` (>= at) arrives.

    ``ends[i]`` is the number of words before paragraph i; paragraphs first..at-1 are open.
    """
    while True:
        close = max(at, bisect_right(ends, ends[first] + budget) - 1)
        if close >= len(ends) - 1:
            return
        following = max(first, bisect_left(ends, ends[close] - overlap))
        yield first, close, following
        first, at = following, close + 1


def _exits(ends: list[int], base: int, budget: int, overlap: int) -> tuple[list[int], list[int]]:
    """For every number of open paragraphs at paragraph ``base``: those open at the end, chunks closed."""
    known: dict[tuple[int, int], tuple[int, int]] = {}
    left, closed = [], []
    for entry in range(base + 1):
        path = [(base - entry, max(base, base - entry + 1))]
        if path[0] not in known:
            for _, close, following in _closings(ends, *path[0], budget, overlap):
                path.append((following, close + 1))
                if path[-1] in known:
                    break
            known.setdefault(path[-1], (len(ends) - 1 - path[-1][0], 0))
        end = known[path[-1]]
        for steps, state in enumerate(reversed(path)):
            known[state] = (end[0], end[1] + steps)
        left.append(known[path[0]][0])
        closed.append(known[path[0]][1])
    return left, closed


def _ends(counts) -> list[int]:
    return [0, *accumulate(int(n) for n in counts)]


def chunks(blocks: DataFrame, settings: Settings = DEFAULTS, group: int = GROUP) -> DataFrame:
    """(document_id, page, ordinal, line_start, line_end, text) of line blocks; ordinals count from 1 in a text."""
    budget, overlap = settings.chunk_max_words, settings.chunk_overlap_words
    # Every paragraph has a word; a chunk beyond the budget is a tail and one paragraph.
    open_most = max(budget, overlap + 1)
    size = max(group, open_most)
    found = _groups(paragraph_pieces(blocks), size, open_most)
    found = store.keep(found, f"{shared_dir(blocks.sparkSession)}/segments-{uuid.uuid4().hex}")
    counts = F.col("paragraphs.words")
    base = F.size(F.filter("paragraphs", lambda p: p["paragraph"] < F.col("group") * size))

    @F.pandas_udf("left array<int>, closed array<int>")
    def exits(counts: pd.Series, base: pd.Series) -> pd.DataFrame:
        rows = [_exits(_ends(c), b, budget, overlap) for c, b in zip(counts, base, strict=True)]
        return pd.DataFrame(rows, columns=["left", "closed"])

    @F.pandas_udf("entry array<int>, before array<long>")
    def entries(left: pd.Series, closed: pd.Series) -> pd.DataFrame:
        rows = []
        for lefts, closes in zip(left, closed, strict=True):
            entry, before = [0], [0]
            for to, n in zip(lefts, closes, strict=True):
                before.append(before[-1] + int(n[entry[-1]]))
                entry.append(int(to[entry[-1]]))
            rows.append((entry[:-1], before[:-1]))
        return pd.DataFrame(rows, columns=["entry", "before"])

    @F.pandas_udf("first array<int>, last array<int>")
    def bounds(counts: pd.Series, base: pd.Series, entry: pd.Series, final: pd.Series) -> pd.DataFrame:
        rows = []
        for c, b, e, f in zip(counts, base, entry, final, strict=True):
            ends, first, firsts, lasts = _ends(c), b - e, [], []
            for start, close, first in _closings(ends, first, max(b, first + 1), budget, overlap):
                firsts.append(start)
                lasts.append(close - 1)
            if f:
                firsts.append(first)
                lasts.append(len(ends) - 2)
            rows.append((firsts, lasts))
        return pd.DataFrame(rows, columns=["first", "last"])

    maps = found.select(*_TEXT, "group", exits(counts, base).alias("m")).select(*_TEXT, F.struct("group", "m").alias("m"))
    maps = maps.groupBy(*_TEXT).agg(F.array_sort(F.collect_list("m"))["m"].alias("m"))
    states = maps.select(*_TEXT, entries("m.left", "m.closed").alias("s"), F.size("m").alias("groups"))
    states = states.select(*_TEXT, "groups", F.posexplode(F.arrays_zip("s.entry", "s.before")).alias("group", "s"))
    states = states.select(
        *_TEXT,
        F.col("group").cast("long").alias("group"),
        "s.*",
        (F.col("group") == F.col("groups") - 1).alias("final"),
    )
    rows = _same(found, states, [*_TEXT, "group"])
    rows = rows.select(*_TEXT, "before", "paragraphs", bounds(counts, base, F.col("entry"), F.col("final")).alias("b"))
    rows = rows.select(*_TEXT, "before", "paragraphs", F.posexplode(F.arrays_zip("b.first", "b.last")).alias("k", "b"))
    text = F.array_join(F.slice("paragraphs.text", F.col("b.first") + 1, F.col("b.last") - F.col("b.first") + 1), " ")
    return rows.select(
        *_TEXT,
        (F.col("before") + F.col("k") + 1).alias("ordinal"),
        F.get("paragraphs", F.col("b.first"))["start_line"].alias("line_start"),
        F.get("paragraphs", F.col("b.last"))["end_line"].alias("line_end"),
        text.alias("text"),
    )
