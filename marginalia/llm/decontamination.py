"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman scores them.

Words are runs between ASCII white space, in lower case and without marks at their ends. One pass over the
documents finds the benchmark's n-grams (``GRAM`` words) and keeps *passages*: stretches of a document in
which they lie within ``GAP`` words, with as many words around them as the longest item has. The corpus
frequency of every benchmark n-gram is counted over all documents. Every n-gram of an item is a seed, so
edits and exact copies elsewhere hide none. A passage and an item meet if they share ``SEEDS`` of them, or a
single rare one: one of the rarest ``single`` share of those of the item's n-grams that the corpus holds (ties included).
That is rarity among the item's own n-grams, so it does not change with the size of the corpus; with a share of 1 every
n-gram joins alone. They are
aligned word by word (Smith-Waterman: match 2, mismatch -1, gap -1) if enough of the item's words occur in
the passage at all to reach the threshold, which rules out no pair that would.
The score is the alignment's share of the item's best (2 per word); from ``THRESHOLD`` on it counts.

The benchmark is cut into parts of about ``PART_WORDS`` words, by a hash of the item id; only the n-grams of
one part at a time are sent to the tasks. Neither documents nor
passages are shuffled, only counts and results are.

Defined cases: null, empty, or markless texts and items have no n-grams and never match; an item shorter
than ``GRAM`` words is searched as one n-gram of its own length; repeated rows are judged alike, one result
per document id and item; null ids group together; empty tables give empty results; other columns are
ignored. Copies edited so densely that no three words of the item stay together are out of reach.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.arrow import slices, stored, words

GRAM = 3
GAP = 40
SEEDS = 2
SINGLE = 0.75
THRESHOLD = 0.5
MATCH, MISMATCH, SPACE = 2, -1, -1
PART_WORDS = 1_000_000
_PASSAGE = "doc_id long, first long, words array<string>, grams array<long>, own array<long>"


def _bare(word: str) -> str:
    """The word in lower case between its first and last letter or digit."""
    if word.isalnum():
        return word.lower()
    at = [i for i, c in enumerate(word) if c.isalnum()]
    return word[at[0] : at[-1] + 1].lower() if at else ""


def bare_words(text: str | None) -> list[str]:
    """All words of a text that have a letter or digit."""
    return [w for w in (_bare(x.decode()) for x in (text or "").encode().split()) if w]


def _hash(grams: Iterable[tuple[str, ...]]) -> list[int]:
    return [xxhash.xxh64_intdigest(" ".join(g)) - (1 << 63) for g in grams]


def item_grams(own: list[str]) -> list[int]:
    n = min(GRAM, len(own))
    return _hash(tuple(own[i : i + n]) for i in range(len(own) - n + 1)) if n else []


class _Finder:
    """Looks for the n-grams of a benchmark part in coded texts."""

    def __init__(self, items: list[list[str]]):
        self.number = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for own in items for w in own))}
        self.margin = max((len(own) for own in items), default=0)
        self.keys, self.names = {}, {}
        for n in sorted({min(GRAM, len(own)) for own in items if own}):
            same = [own for own in items if min(GRAM, len(own)) == n]
            grams = sorted({tuple(own[i : i + n]) for own in same for i in range(len(own) - n + 1)})
            key = self._key(np.array([[self.number[w] for w in g] for g in grams], np.uint64))
            order = np.argsort(key)
            self.keys[n], self.names[n] = key[order], np.array(_hash(grams), np.int64)[order]

    def _key(self, numbers: np.ndarray) -> np.ndarray:
        """A mixed key of n columns of word numbers; equal numbers give equal keys."""
        key = np.zeros(len(numbers), np.uint64)
        for column in numbers.T:
            key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        return key

    def hits(self, known: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and names of benchmark n-grams in word numbers (0: not a benchmark word)."""
        at, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, keys in self.keys.items():
            size = len(known) - n + 1
            if size <= 0:
                continue
            fits = text[:size] == text[n - 1 :]
            for i in range(n):
                fits &= known[i : i + size] > 0
            start = np.flatnonzero(fits)
            key = self._key(known[start[:, None] + np.arange(n)].astype(np.uint64))
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            found = keys[place] == key
            at.append(start[found]), names.append(self.names[n][place[found]])
        at, names = np.concatenate(at), np.concatenate(names)
        order = np.argsort(at, kind="stable")
        return at[order], names[order]


def _passages(finder: _Finder):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            codes, bounds, vocabulary = words(part["text"])
            clean = [_bare(w) for w in vocabulary.to_pylist()]
            real = np.array([bool(w) for w in clean], bool)
            kept = real[codes] if len(codes) else np.zeros(0, bool)
            bounds = np.concatenate(([0], np.cumsum(kept)))[bounds]
            codes = codes[kept]
            numbers = np.array([finder.number.get(w, 0) for w in clean], np.int64)
            text = np.repeat(np.arange(len(part)), np.diff(bounds))
            at, names = finder.hits(numbers[codes] if len(codes) else codes.astype(np.int64), text)
            cuts = np.flatnonzero((np.diff(at) > GAP) | (np.diff(text[at]) > 0)) + 1
            ids, out = part["doc_id"].to_pylist(), {k: [] for k in ("doc_id", "first", "words", "grams", "own")}
            counted = set()
            for own, name in zip(np.split(at, cuts), np.split(names, cuts), strict=True):
                if not len(own):
                    continue
                row = int(text[own[0]])
                # For the corpus frequencies each document counts each of its n-grams once.
                fresh = [g for g in dict.fromkeys(name.tolist()) if (row, g) not in counted]
                counted.update((row, g) for g in fresh)
                grams = sorted(set(name.tolist()))
                low = max(int(bounds[row]), int(own[0]) - finder.margin)
                high = min(int(bounds[row + 1]), int(own[-1]) + GRAM + finder.margin)
                out["doc_id"].append(ids[row])
                out["first"].append(low - int(bounds[row]))
                out["words"].append([clean[c] for c in codes[low:high]])
                out["grams"].append(grams)
                out["own"].append(fresh)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["doc_id"], pa.int64()),
                    pa.array(out["first"], pa.int64()),
                    pa.array(out["words"], pa.list_(pa.string())),
                    pa.array(out["grams"], pa.list_(pa.int64())),
                    pa.array(out["own"], pa.list_(pa.int64())),
                ],
                ["doc_id", "first", "words", "grams", "own"],
            )

    return run


def _best(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, last passage word + 1, last item word + 1."""
    ramp = np.arange(len(passage) + 1) * -SPACE
    row = np.zeros(len(passage) + 1, np.int64)
    top = (0, 0, 0)
    for i, word in enumerate(item):
        now = np.zeros_like(row)
        step = np.where(passage == word, MATCH, MISMATCH)
        now[1:] = np.maximum(row[:-1] + step, np.maximum(row[1:] + SPACE, 0))
        row = np.maximum.accumulate(now + ramp) - ramp
        at = int(row.argmax())
        if row[at] > top[0]:
            top = (int(row[at]), at, i + 1)
    return top


def align(item: list[str], passage: list[str]) -> tuple[float, int, int]:
    """(share of the item's best score, first and past-the-last passage word) of the best alignment."""
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    a = np.array([number[w] for w in item], np.int64)
    b = np.array([number.get(w, -1) for w in passage], np.int64)
    score, stop, used = _best(a, b)
    back, begin, _ = _best(a[:used][::-1], b[:stop][::-1])
    return (score / (MATCH * len(item)) if item else 0.0), stop - begin if back else 0, stop


def rare_grams(own: list[int], counts: dict[int, int], single: float) -> set[int]:
    """The rarest ``single`` share of an item's n-grams that some document holds, and those as rare as its last."""
    held = sorted((counts[g], g) for g in set(own) if g in counts)
    last = held[min(len(held), int(np.ceil(single * len(held)))) - 1][0] if held and single > 0 else -1
    return {g for n, g in held if n <= last}


def _judged(items: list[tuple[int, list[str]]], counts: dict[int, int], threshold: float, single: float):
    """Joins passages to the items they share seeds with, by a hash table of the part's seeds, and aligns them."""
    seeds = [sorted(set(item_grams(own))) for _, own in items]
    holders: dict[int, list[int]] = {}
    for i, own in enumerate(seeds):
        for gram in own:
            holders.setdefault(gram, []).append(i)
    least = [min(SEEDS, len(own)) for own in seeds]
    rare = [rare_grams(own, counts, single) for own in seeds]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for row in rows.itertuples():
                # A rare seed alone is enough, so it counts as many.
                shared: Counter[int] = Counter()
                for gram in row.grams:
                    for i in holders.get(gram, ()):
                        shared[i] += SEEDS if gram in rare[i] else 1
                passage = list(row.words)
                held = set(passage)
                for i, n in shared.items():
                    own = items[i][1]
                    if n >= least[i] and sum(w in held for w in own) / len(own) >= threshold:
                        score, first, stop = align(items[i][1], passage)
                        found.append((row.doc_id, items[i][0], score, row.first + first, row.first + stop - 1))
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "score", "first_word", "last_word"])

    return run


def _part(docs: DataFrame, items: list[tuple[int, list[str]]], threshold: float, single: float) -> DataFrame:
    finder = _Finder([own for _, own in items])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    passages = stored(rows.mapInArrow(_passages(finder), _PASSAGE), "passages")
    counts = passages.select(F.explode("own").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    found = {r["gram"]: r["n"] for r in counts.collect()}  # at most the n-grams of the part
    passages = passages.select("doc_id", "first", "words", "grams")
    scored = passages.mapInPandas(_judged(items, found, threshold, single), "doc_id long, item_id long, score double, first_word long, last_word long")
    best = F.max_by(F.struct("score", "first_word", "last_word"), F.struct("score", -F.col("first_word"), -F.col("last_word")))
    best = scored.filter(F.col("score") >= threshold).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return best.select("doc_id", "item_id", "b.score", "b.first_word", "b.last_word")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, single: float = SINGLE) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of every document and test item it holds."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("text is not null")
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = max(1, -(-int(size) // PART_WORDS))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    found = None
    for part in range(parts):
        own = [(r["item_id"], bare_words(r["text"])) for r in items.filter(F.col("part") == part).collect()]
        own = sorted((x for x in own if x[1]), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if own:
            made = _part(docs, own, threshold, single)
            found = made if found is None else found.unionByName(made)
    if found is None:
        schema = "doc_id long, item_id long, score double, first_word long, last_word long"
        return docs.sparkSession.createDataFrame([], schema)
    return found
