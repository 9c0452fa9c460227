"""Exact ranked lexical search by dual trees over items and documents.

A term's weight and a document's impact for it are integers, so a score is the inner product of the item's vector
(weight x repeats) and the document's vector (impacts). Both sides form hierarchies whose nodes hold the
maximum of every coordinate: items in groups of ``ITEMS`` and of ``ITEMS ** 2``, documents in leaves of ``LEAF``
and batches of up to ``BATCH``. The product of two nodes' maxima bounds every score between them, and a pair of nodes
is dropped, with everything below it, when that bound is under the weakest k-th score of the items in it. Equal
bounds are kept, since ties go by id. Nothing is approximated.

Passes: (1) documents become vectors over the terms of the items, one narrow pass; document frequencies and totals
are aggregates over all of them; (2) impacts, and batches of documents that resemble each other, with their maxima; (3) for
each batch the leaf of the largest bound per group of items is scored, and Spark takes the k-th best of
these scores per item: real scores, so a lower limit of the final k-th; (4) all batches go against the item tree,
starting from those limits; a task keeps k rows per item, and Spark ranks what the tasks have left.

Items are taken in blocks whose matrix (terms x items) has at most ``CELLS`` cells, or of one item; a block's matrix
and terms are all that is broadcast or collected. Rows of a hot source or of copies are rows like others: no key of
theirs is shuffled.

Defined cases: null texts have no term; documents without a term count neither in N nor in L; a document with a null id
is ranked before others of the same score; items or documents with the same id are told apart; items without a
term have no row; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.arrow import ranges, release, slices, stored, words

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
ITEMS, LEAF, BATCH = 8, 32, 1024
CELLS = 1 << 22
#: Sums of doubles are exact below this; beyond, matrices are of integers.
EXACT = 1 << 53
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_VECTORS = "doc_id long, n long, codes array<int>, tfs array<int>"
_BATCHES = "ids binary, known binary, size binary, codes binary, impacts binary, high_codes binary, high binary"
_HITS = "item int, item_id long, known boolean, doc_id long, score long"


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_LOWER))


@dataclass
class Items:
    """A block of items in the order of their tree; ``number`` is their place in the block."""

    ids: list[int | None]
    number: np.ndarray
    matrix: np.ndarray  # items x terms
    groups: np.ndarray  # maxima of groups of ITEMS
    large: np.ndarray  # maxima of groups of ITEMS ** 2


def _order(matrix: np.ndarray) -> np.ndarray:
    """Items in an order that puts those with common terms side by side: halves along the main direction."""
    size = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    unit = matrix / np.where(size > 0, size, 1)

    def halves(own: np.ndarray) -> list[np.ndarray]:
        if len(own) <= ITEMS:
            return [own]
        x = unit[own] - unit[own].mean(axis=0)
        gram = x @ x.T
        side = np.linalg.eigh(gram)[1][:, -1]
        order = own[np.argsort(side, kind="stable")]
        # Cut at a multiple of a group, so that groups do not straddle halves.
        cut = max(ITEMS, (len(own) // 2 + ITEMS - 1) // ITEMS * ITEMS)
        return [*halves(order[:cut]), *halves(order[cut:])] if cut < len(own) else [order]

    return np.concatenate(halves(np.arange(len(matrix)))) if len(matrix) else np.zeros(0, np.int64)


def _maxima(rows: np.ndarray, size: int) -> np.ndarray:
    """Coordinate maxima of every ``size`` rows."""
    return np.maximum.reduceat(rows, np.arange(0, len(rows), size), axis=0) if len(rows) else rows


def tree(ids: list[int | None], counts: list[dict[int, int]], weights: np.ndarray) -> Items:
    """The item tree of a block; ``counts`` are the repeats of each term code."""
    rows = np.zeros((len(ids), len(weights)), np.int64)
    for i, own in enumerate(counts):
        rows[i, list(own)] = [n * int(weights[c]) for c, n in own.items()]
    order = _order(rows.astype(np.float64))
    rows = rows[order]
    # An impact is at most 10 ** 6, and maxima add up to no more than the sums of their items.
    whole = int(rows.sum(axis=1).max(initial=0)) * 10**6 * ITEMS**2
    rows = rows.astype(np.float64 if whole < EXACT else np.int64)
    return Items([ids[i] for i in order], order, rows, _maxima(rows, ITEMS), _maxima(_maxima(rows, ITEMS), ITEMS))


def vectors(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, n, codes, tfs): number of terms of every document, and those of the vocabulary it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for part in slices(batches, "text", 4 << 20):
            codes, bounds, found = words(pc.ascii_lower(pc.fill_null(part["text"], "")))
            many, held, sizes = [], [], []
            for word in found.to_pylist():
                own = TERM.findall(word)
                known = [number[t] for t in own if t in number]
                many.append(len(own))
                sizes.append(len(known))
                held += known
            many, sizes, held = (np.array(x, np.int64) for x in (many, sizes, held))
            per_doc = np.concatenate(([0], np.cumsum(many[codes])))[bounds]
            begin = np.cumsum(sizes) - sizes
            taken = held[ranges(begin[codes], sizes[codes])] if len(codes) else np.zeros(0, np.int64)
            ends = np.concatenate(([0], np.cumsum(sizes[codes])))[bounds]
            owner = np.repeat(np.arange(len(part)), np.diff(ends))
            keys, tf = np.unique(owner * len(number) + taken, return_counts=True)
            own, code = (keys // len(number), keys % len(number)) if number else (keys, keys)
            cut = pa.array(np.searchsorted(own, np.arange(len(part) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(x, pa.int32())) for x in (code, tf)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(per_doc)), *lists], ["doc_id", "n", "codes", "tfs"])
            release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _VECTORS)


def _bytes(values: np.ndarray, kind: str) -> list[bytes]:
    return [np.ascontiguousarray(values, kind).tobytes()]


def batches_of(rows: DataFrame, model: Items, documents: int, length: int) -> DataFrame:
    """Batches of like documents as packed rows, with the maxima of their impacts."""
    width = model.matrix.shape[1]
    most = max(1, min(BATCH, CELLS // max(1, width)))
    mass = model.matrix.astype(np.float64).sum(axis=0)
    # A term stands where the items that hold it stand in the order of the tree.
    stand = (np.arange(len(model.matrix)) @ model.matrix.astype(np.float64)) / np.where(mass > 0, mass, 1)
    shared = rows.sparkSession.sparkContext.broadcast((mass, stand))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, stand = shared.value
        for batch in batches:
            size = np.diff(batch["codes"].offsets.to_numpy()).astype(np.int64)
            codes = batch["codes"].flatten().to_numpy().astype(np.int64)
            tf = batch["tfs"].flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(size)), size)
            m = 75 + (25 * batch["n"].to_numpy() * documents) // length
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner])
            pull = impact * mass[codes]
            total = np.bincount(owner, pull, len(size))
            place = np.bincount(owner, pull * stand[codes], len(size)) / np.where(total > 0, total, 1)
            order = np.lexsort((total, np.floor(place / max(1, ITEMS // 2))))
            begin = np.cumsum(size) - size
            ids = pc.fill_null(batch["doc_id"], 0).to_numpy()
            known = pc.is_valid(batch["doc_id"]).to_numpy(zero_copy_only=False)
            for at in range(0, len(order), most):
                own = order[at : at + most]
                flat = ranges(begin[own], size[own])
                high = np.zeros(width, np.int64)
                np.maximum.at(high, codes[flat], impact[flat])
                top = np.flatnonzero(high)
                made = (
                    _bytes(ids[own], "<i8"), _bytes(known[own], "u1"), _bytes(size[own], "<i4"), _bytes(codes[flat], "<i4"),
                    _bytes(impact[flat], "<i4"), _bytes(top, "<i4"), _bytes(high[top], "<i4"),
                )
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in made], [c.split()[0] for c in _BATCHES.split(", ")])

    return rows.filter(F.size("codes") > 0).mapInArrow(run, _BATCHES)


class _Best:
    """The k best rows of each item that a task has seen, and each item's k-th score."""

    def __init__(self, limits: np.ndarray, k: int):
        self.limits, self.k = limits.copy(), k
        self.rows = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # item, known, id, score

    def add(self, new: list[tuple[np.ndarray, ...]]) -> None:
        if not new:
            return
        item, known, ids, score = (np.concatenate([a, *b]) for a, b in zip(self.rows, zip(*new, strict=True), strict=True))
        order = np.lexsort((ids, known, -score, item))
        item, known, ids, score = item[order], known[order], ids[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item, "left")
        last = np.flatnonzero(place == self.k - 1)
        self.limits[item[last]] = np.maximum(self.limits[item[last]], score[last])
        kept = place < self.k
        self.rows = [item[kept], known[kept], ids[kept], score[kept]]


class _Batch:
    """A packed row, unpacked as far as it is asked for."""

    def __init__(self, row: dict, model: Items):
        self.row, self.model, self.kind = row, model, model.matrix.dtype
        self.high = np.zeros(model.matrix.shape[1], self.kind)
        self.high[np.frombuffer(row["high_codes"], "<i4")] = np.frombuffer(row["high"], "<i4")

    def open(self) -> None:
        size = np.frombuffer(self.row["size"], "<i4")
        self.cells = np.zeros((len(size), self.model.matrix.shape[1]), self.kind)
        owner = np.repeat(np.arange(len(size)), size)
        self.cells[owner, np.frombuffer(self.row["codes"], "<i4")] = np.frombuffer(self.row["impacts"], "<i4")
        self.ids, self.known = np.frombuffer(self.row["ids"], "<i8"), np.frombuffer(self.row["known"], "u1").astype(bool)
        self.leaves = _maxima(self.cells, LEAF)

    def hits(self, leaf: int, items: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, known, id, score) of a leaf's documents that reach the limits of these items."""
        own = slice(leaf * LEAF, (leaf + 1) * LEAF)
        scores = self.cells[own] @ self.model.matrix[items].T
        row, column = np.nonzero(scores >= np.maximum(limits[items], 1))
        return items[column], self.known[own][row], self.ids[own][row], scores[row, column].astype(np.int64)


def _members(groups: np.ndarray, n: int) -> np.ndarray:
    """The items of groups of ``ITEMS``."""
    found = (groups[:, None] * ITEMS + np.arange(ITEMS)).ravel()
    return found[found < n]


def _weakest(limits: np.ndarray, size: int) -> np.ndarray:
    """The smallest limit of every ``size`` items, one at least: only scores above 0 count."""
    return np.maximum(np.minimum.reduceat(limits, np.arange(0, len(limits), size)), 1)


def seed(batch: _Batch, best: _Best) -> None:
    """Score for each group of items the leaf that promises most."""
    batch.open()
    bounds = batch.leaves @ batch.model.groups.T
    chosen, n, new = bounds.argmax(axis=0), len(best.limits), []
    for leaf in np.unique(chosen):
        groups = np.flatnonzero((chosen == leaf) & (bounds[leaf] >= _weakest(best.limits, ITEMS)))
        if len(groups):
            new.append(batch.hits(leaf, _members(groups, n), best.limits))
    best.add(new)


def search(batch: _Batch, best: _Best) -> int:
    """All hits of a batch, node pair by node pair; returns how many leaf pairs were scored."""
    n, scored = len(best.limits), 0
    large = np.flatnonzero(batch.high @ batch.model.large.T >= _weakest(best.limits, ITEMS**2))
    if not len(large):
        return 0
    groups = (large[:, None] * ITEMS + np.arange(ITEMS)).ravel()
    groups = groups[groups < len(batch.model.groups)]
    groups = groups[batch.high @ batch.model.groups[groups].T >= _weakest(best.limits, ITEMS)[groups]]
    if not len(groups):
        return 0
    batch.open()
    bounds = batch.leaves @ batch.model.groups[groups].T
    new = []
    for leaf in np.argsort(-bounds.max(axis=1), kind="stable"):
        alive = groups[bounds[leaf] >= _weakest(best.limits, ITEMS)[groups]]
        if len(alive):
            new.append(batch.hits(leaf, _members(alive, n), best.limits))
            scored += len(alive)
            if sum(len(x[0]) for x in new) > 20_000:
                best.add(new)
                new = []
    best.add(new)
    return scored


def _run(visit, model, limits: np.ndarray, k: int):
    """A task's best rows after ``visit`` has seen all its batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = model.value
        best = _Best(limits, k)
        for rows in batches:
            for i in range(len(rows)):
                visit(_Batch(rows.slice(i, 1).to_pylist()[0], items), best)
        item, known, ids, score = best.rows
        names = pa.array([items.ids[i] for i in item], pa.int64())
        made = [pa.array(items.number[item], pa.int32()), names, pa.array(known), pa.array(ids), pa.array(score)]
        yield pa.RecordBatch.from_arrays(made, ["item", "item_id", "known", "doc_id", "score"])

    return run


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """The items with a block number, such that no block exceeds ``CELLS``, unless it is one item."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = stored(rows.withColumn("own", F.monotonically_increasing_id()), "items")
    most = F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    n = 1
    while True:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("own"), F.lit(n)))
        size = rows.groupBy("block").agg(F.count("*").alias("n"), F.sum(most).alias("m"))
        if not size.filter(F.col("n") * F.col("m") > CELLS).filter("n > 1").limit(1).count():
            return rows, n
        n *= 2


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest scores above 0, ties to the smaller id."""
    spark = docs.sparkSession
    rows, n = _blocks(items)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(n):
        own = rows.filter(F.col("block") == block).orderBy("own").select("item_id", "text").collect()
        found = [(r["item_id"], Counter(t)) for r in own if (t := terms(r["text"]))]
        if found:
            out = out.unionByName(_block(docs, found, k))
    return out


def _block(docs: DataFrame, items: list[tuple[int | None, Counter]], k: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    number: dict[str, int] = {}
    counts = [{number.setdefault(t, len(number)): n for t, n in own.items()} for _, own in items]
    held = stored(vectors(docs, number), "term-vectors")
    totals = held.filter("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    documents, length = totals["documents"], totals["length"] or 1
    df = np.zeros(len(number), np.int64)
    # One row per term of the block.
    for r in held.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect():
        df[r["code"]] = r["n"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    model = tree([i for i, _ in items], counts, weights)
    shared = context.broadcast(model)
    packed = stored(batches_of(held, model, documents, length), "batches")
    none = np.zeros(len(items), np.int64)
    best = Window.partitionBy("item").orderBy(F.desc("score"))
    seeds = packed.mapInArrow(_run(seed, shared, none, k), _HITS).select("item", "score")
    seeds = seeds.withColumn("turn", F.row_number().over(best)).filter(F.col("turn") == k)
    place = np.argsort(model.number)
    limits = none.copy()
    for r in seeds.collect():
        limits[place[r["item"]]] = r["score"]
    order = Window.partitionBy("item").orderBy(F.desc("score"), "known", "doc_id")
    hits = packed.mapInArrow(_run(search, shared, limits, k), _HITS)
    hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    doc_id = F.when(F.col("known"), F.col("doc_id")).alias("doc_id")
    return hits.select("item_id", F.col("rank").cast("int").alias("rank"), doc_id, "score")
