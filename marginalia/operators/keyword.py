"""Keyword search: substring terms scored over snippet, section and document name."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from functools import reduce
from itertools import chain, islice
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from marginalia.config import DEFAULTS, Settings
from marginalia.functions import text as tx
from marginalia.operators import termbits
from marginalia.operators.termbits import HAYSTACK_POINTS, SNIPPET_POINTS
from marginalia.operators.topk import ID_TYPES, top_k_per
from marginalia.session import shared_dir
from marginalia.sources import store

MIN_TERM_CHARS = 3
#: Lists of ``queries_per_scan`` requests that one scan of the corpus answers.
SLICES = 64
#: Longest rows, and first rows, whose scores set the floors; from SEEDED requests on it pays to look at them first.
SEEDS = 384
SEEDED = 256


def query_terms(query: str) -> list[str]:
    """Distinct lower-case words longer than two characters; punctuation stays."""
    return list(dict.fromkeys(word for word in query.lower().split() if len(word) >= MIN_TERM_CHARS))


def query_terms_column(query: Column) -> Column:
    return F.array_distinct(F.filter(tx.words(F.lower(query)), lambda word: F.length(word) >= MIN_TERM_CHARS))


def match_score(terms: list[str]) -> Column:
    """2 points for a term in the snippet, else 1 for a term anywhere in name, section or snippet.

    Expects the lower-cased ``snippet_lower`` and ``label_lower`` columns. Terms hold no whitespace,
    so none can match across the joins of the haystack.
    """
    if not terms:
        return F.lit(0)
    return reduce(
        add,
        [
            F.when(F.contains("snippet_lower", F.lit(term)), SNIPPET_POINTS)
            .when(F.contains("label_lower", F.lit(term)), HAYSTACK_POINTS)
            .otherwise(0)
            for term in terms
        ],
    )


def _lowered(evidence: DataFrame) -> DataFrame:
    return evidence.withColumns(
        {
            "snippet_lower": F.lower("snippet"),
            "label_lower": F.lower(F.concat_ws(" ", "document_name", "section")),
        }
    )


def keyword_search(evidence: DataFrame, query: str, limit: int = DEFAULTS.top_k) -> DataFrame:
    """Best evidence for one query: score descending, insertion order on ties, whole-corpus limit.

    One scan with generated code for the terms and a top-k at the end (TakeOrderedAndProject): each
    task keeps ``limit`` rows. Adds ``match_score``; rows without any term are dropped.
    """
    scored = _lowered(evidence).withColumn("match_score", match_score(query_terms(query)))
    return (
        scored.filter(F.col("match_score") > 0)
        .drop("snippet_lower", "label_lower")
        .orderBy(F.col("match_score").desc(), "seq")
        .limit(limit)
    )


def in_scope(evidence: DataFrame, scope: list[str] | DataFrame | None) -> DataFrame:
    """Evidence of the given documents; no or an empty list means no restriction.

    A list becomes a pushed-down filter. A DataFrame with a document_id column becomes a semi join,
    for selections too large for a literal list.
    """
    if scope is None or (isinstance(scope, list) and not scope):
        return evidence
    if isinstance(scope, list):
        return evidence.filter(F.col("document_id").isin(scope))
    return evidence.join(scope.select("document_id").distinct(), "document_id", "left_semi")


def _finder(terms: list[str]) -> Callable[[str], Iterable[int]]:
    """Positions of the terms that occur in a text as substrings; one pass where the library allows."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [n for n, term in enumerate(terms) if term in text]
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for n, term in enumerate(terms):
        machine.add_word(term, n)
    machine.make_automaton()
    return lambda text: {n for _, n in machine.iter(text)}


def _word_finder(terms: list[str]) -> termbits.Find:
    """``_finder`` for many words at once, none of which holds white space."""
    try:
        import ahocorasick
    except ImportError:
        ahocorasick = None
    if ahocorasick is None or not terms:
        find = _finder(terms) if terms else lambda word: []

        def one_by_one(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            held = [list(find(word)) for word in words]
            return np.repeat(np.arange(len(words)), [len(own) for own in held]), np.array(sum(held, []), np.int64)

        return one_by_one
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for n, term in enumerate(terms):
        machine.add_word(term, n)
    machine.make_automaton()

    def together(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = np.fromiter(chain.from_iterable(machine.iter(" ".join(words))), np.int64).reshape(-1, 2)
        ends = np.cumsum([len(word) + 1 for word in words])
        return np.searchsorted(ends, found[:, 0], "right"), found[:, 1]

    return together


def _term_scorer(term_lists: list[list[str]]) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Scores a batch of rows for all queries: each term found in a row adds its points to the
    queries that hold the term, so the work follows the matches and not queries x terms."""
    holders: dict[str, list[int]] = {}
    for row, terms in enumerate(term_lists):
        for term in terms:
            holders.setdefault(term, []).append(row)
    queries_of = [np.asarray(rows) for rows in holders.values()]
    find = _finder(list(holders)) if holders else lambda text: []

    def score(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, len(term_lists)))
        labels = batch.column("label_lower").to_pylist()
        snippets = batch.column("snippet_lower").to_pylist()
        in_label: dict[str, dict[int, int]] = {}
        for row, (label, snippet) in enumerate(zip(labels, snippets, strict=True)):
            label = label or ""
            if label not in in_label:
                in_label[label] = dict.fromkeys(find(label), HAYSTACK_POINTS)
            found = in_label[label] | dict.fromkeys(find(snippet or ""), SNIPPET_POINTS)
            if found:
                held = [queries_of[term] for term in found]
                points = np.repeat(list(found.values()), [len(rows) for rows in held])
                out[row] = np.bincount(np.concatenate(held), weights=points, minlength=len(term_lists))
        return np.ascontiguousarray(out.T)

    return score


def bounded_rows(rows: DataFrame, bound: int) -> list[list]:
    """Split a query table into driver-side lists of at most ``bound`` rows each.

    Queries are requests, not data, yet their number is checked all the same: a table above the
    bound is split by hash of its id into as many lists as needed, each one checked again.
    """
    first = rows.limit(bound + 1).collect()
    if len(first) <= bound:
        return [first]
    parts = 2 * -(-rows.count() // bound)
    slices = []
    for n in range(parts):
        part = rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == n).limit(bound + 1).collect()
        if len(part) > bound:
            raise ValueError(f"one hash slice of the query table exceeds {bound} rows; query_id must be unique")
        slices.append(part)
    return slices


def id_type(queries: DataFrame) -> str:
    return queries.schema["query_id"].dataType.simpleString()


def finder_of(asked: termbits.Requests) -> termbits.Words:
    """The finder of a table of requests, kept by the Python worker for its next task."""
    if asked.key not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[asked.key] = termbits.Words(_word_finder(asked.terms))
    return _FINDERS[asked.key]


_FINDERS: dict[str, termbits.Words] = {}


def _slices(rows: DataFrame, terms: Callable[[Row], list[str]], bound: int) -> Iterator[termbits.Requests]:
    left = rows.toLocalIterator()
    batch = list(islice(left, bound))
    while True:
        yield termbits.requests([row["query_id"] for row in batch], [terms(row) for row in batch])
        batch = list(islice(left, bound))
        if not batch:
            return


def request_slices(queries: DataFrame, bound: int) -> Iterator[termbits.Requests]:
    """The queries (query_id, query) in slices of at most ``bound``, one after another; at least one slice."""
    return _slices(queries.select("query_id", "query"), lambda row: query_terms(row["query"] or ""), bound)


def pooled_slices(asked: DataFrame, bound: int) -> Iterator[termbits.Requests]:
    """Slices of (query_id, term): rows of one id are one request, in which a repeated term counts as often."""
    pooled = asked.filter(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.collect_list("term").alias("terms"))
    return _slices(pooled, lambda row: row["terms"], bound)


def _seeds(narrow: DataFrame) -> DataFrame:
    """The longest rows and the first ones: those that many requests rank high."""
    sized = narrow.select("seq", F.length("snippet_lower").alias("n"))
    longest = sized.orderBy(F.desc("n"), "seq").limit(SEEDS).select("seq")
    first = sized.filter(F.col("seq").isNotNull()).orderBy("seq").limit(SEEDS).select("seq")
    # At most twice SEEDS numbers.
    return narrow.join(F.broadcast(longest.unionByName(first).distinct()), "seq", "left_semi")


def set_floors(asked: termbits.Requests, rows: DataFrame, limit: int) -> termbits.Requests:
    """The requests with the scores of their k-th best among ``rows`` (seq, strong, weak), a few hundred."""
    spark = rows.sparkSession
    parts = spark.sparkContext.defaultParallelism
    shared = spark.sparkContext.broadcast(asked)
    spread = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        held: dict[int, list] = {}
        for batch in batches:
            for part, seq, strong, weak in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "strong", "weak")), strict=True):
                held.setdefault(part, []).append((seq, np.array(strong, np.int32), np.array(weak, np.int32)))
        for part, found in held.items():
            seqs, strong, weak = zip(*found, strict=True)
            block = termbits.Block(np.array(seqs, np.int64), np.zeros(0, object), list(strong), list(weak))
            slots = range(len(asked.ids) * part // parts, len(asked.ids) * (part + 1) // parts)
            floor, floor_seq = termbits.floors(asked, block, limit, slots)
            columns = [pa.array(np.arange(slots.start, slots.stop)), pa.array(floor), pa.array(floor_seq)]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "floor", "floor_seq"])

    found = spread.mapInArrow(run, "slot bigint, floor int, floor_seq bigint").toArrow()
    floor, floor_seq = asked.floor.copy(), asked.floor_seq.copy()
    floor[found["slot"].to_numpy()] = found["floor"].to_numpy()
    floor_seq[found["slot"].to_numpy()] = found["floor_seq"].to_numpy()
    shared.unpersist()
    return replace(asked, floor=floor, floor_seq=floor_seq)


def seed_rows(narrow: DataFrame, asked: termbits.Requests) -> DataFrame:
    """(seq, strong, weak) of a few rows for ``set_floors``."""
    shared = narrow.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in termbits.found_rows(batches, finder_of(shared.value), len(shared.value.terms)):
            columns = [pa.array(block.seq), *[pa.array(c, pa.list_(pa.int32())) for c in (block.strong, block.weak)]]
            yield pa.RecordBatch.from_arrays(columns, ["seq", "strong", "weak"])

    return narrow.mapInArrow(run, "seq bigint, strong array<int>, weak array<int>")


def _kept(narrow: DataFrame) -> DataFrame:
    """Narrow rows for several scans, in the shared folder: they come from whole texts, which are parsed once."""
    return store.keep(narrow, f"{shared_dir(narrow.sparkSession)}/haystack-{uuid.uuid4().hex}")


def best_of_slice(narrow: DataFrame, asked: termbits.Requests, limit: int, id_type: str) -> DataFrame:
    """Partial top-k (query_id, score, seq, id) of every task for one slice of requests."""
    if len(asked.ids) >= SEEDED:
        asked = set_floors(asked, seed_rows(_seeds(narrow), asked), limit)
    shared = narrow.sparkSession.sparkContext.broadcast(asked)
    arrow_type = ID_TYPES[id_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = termbits.Best(shared.value, limit)
        for block in termbits.found_rows(batches, finder_of(shared.value), len(shared.value.terms)):
            best.add(block)
        yield from best.batches(arrow_type)

    return narrow.mapInArrow(run, f"query_id {id_type}, score double, seq bigint, id string")


def keyword_search_batch(
    evidence: DataFrame, queries: DataFrame, limit: int = DEFAULTS.top_k, settings: Settings = DEFAULTS
) -> DataFrame:
    """``keyword_search`` for a table of queries (query_id, query): one scan per slice of ``SLICES`` lists.

    Returns query_id, rank, match_score, seq and id; join the evidence table for its other columns.
    """
    narrow = _lowered(evidence).select("id", "seq", "snippet_lower", "label_lower")
    partial = []
    for asked in request_slices(queries, SLICES * settings.queries_per_scan):
        if not partial and len(asked.ids) >= SEEDED:
            narrow = _kept(narrow)
        partial.append(best_of_slice(narrow, asked, limit, id_type(queries)))
    merged = reduce(DataFrame.unionByName, partial)
    ranked = top_k_per(merged, "query_id", [F.col("score").desc(), F.col("seq")], limit)
    return ranked.select("query_id", "rank", F.col("score").cast("int").alias("match_score"), "seq", "id")
