"""Language of words in code-switched text by a linear-chain conditional random field.

The states are languages, the positions the words of a line. A word's score per language is the sum of
the weights of its features: prefixes and suffixes of 1 to 4 characters, character bigrams and trigrams
with word boundaries, and the word itself with its standing in the training lexicon. Learned transition
weights tie neighbours together. Forward-backward gives each word's probability of each language; a
document gets the language with the largest expected number of words, and its share as the score.

Training takes at most ``TRAIN_DOCS`` labelled documents, evenly from all languages and chosen by a hash of
their ids. The labels are of documents, so switching is learned from sequences that join runs of words
of documents in different languages (``SWITCHES``). Everything else covers all rows: labelling is one
narrow pass, vectorised over the distinct words and over the lines of an Arrow batch.

Words are runs between ASCII white space, in lower case without the marks around them; words without a
letter are no positions. Defined cases: a null text, or one without letters, is ``und`` with score 0, and so
is every text if nothing labelled can be learned from; ties go to the language first in order; documents
with a null id are labelled but not learned from; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.arrow import slices, words

TRAIN_DOCS = 600
UNKNOWN = "und"
#: Share of training sequences that join runs of two documents.
SWITCHES = 0.3
BUCKETS = 1 << 17
ROUNDS, STEP, DECAY = 40, 0.4, 1e-6
_AFFIX = 4
#: Text that a task labels at a time.
SLICE_BYTES = 2 << 20
_CELLS = 300_000


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # feature buckets x labels
    transitions: np.ndarray  # label before x label
    lexicon: dict[str, int]  # word -> standing, 1 and up


def _cleaned(word: str) -> str:
    """The word between its first and last letter; empty if it has none."""
    if word.isalpha():
        return word
    at = [i for i, c in enumerate(word) if c.isalpha()]
    return word[at[0] : at[-1] + 1] if at else ""


def _bucket(kind: int, value: np.ndarray) -> np.ndarray:
    x = (value.astype(np.uint64) + np.uint64(kind * 0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS


def features(vocabulary: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words one after another, and where each word's begin."""
    sizes = np.array([len(w) + 2 for w in vocabulary], np.int64)
    chars = np.frombuffer("".join(f"\x02{w}\x03" for w in vocabulary).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    last = first + sizes
    word = np.repeat(np.arange(len(sizes)), sizes)
    p = np.uint64(1_000_003)
    two = chars[:-1] * p + chars[1:]
    three = two[:-1] * p + chars[2:]
    within2, within3 = word[:-1] == word[1:], word[:-2] == word[2:]
    parts = [(word[:-1][within2], _bucket(1, two[within2])), (word[:-2][within3], _bucket(2, three[within3]))]
    begin, end = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
    for n in range(1, _AFFIX + 1):
        has = np.flatnonzero(sizes - 2 >= n)
        begin[has] = begin[has] * p + chars[first[has] + n]
        end[has] = end[has] * p + chars[last[has] - 1 - n]
        parts += [(has, _bucket(10 + n, begin[has])), (has, _bucket(20 + n, end[has]))]
    whole = np.zeros(len(sizes), np.uint64)
    np.add.at(whole, word, chars * (np.arange(len(chars)).astype(np.uint64) - first[word].astype(np.uint64) + p) ** np.uint64(3))
    standing = np.array([lexicon.get(w, 0) for w in vocabulary], np.uint64)
    every = np.arange(len(sizes))
    parts += [(every, _bucket(30, whole)), (every, _bucket(31, standing)), (every, _bucket(32, standing * 0))]
    owner = np.concatenate([a for a, _ in parts])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([b for _, b in parts])[order], np.searchsorted(owner[order], every)


def emissions(model: Model, vocabulary: list[str]) -> np.ndarray:
    """Score of each word and label."""
    if not vocabulary:
        return np.zeros((0, len(model.labels)))
    buckets, begin = features(vocabulary, model.lexicon)
    return np.add.reduceat(model.weights[buckets], begin, axis=0)


def forward_backward(scores: np.ndarray, transitions: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of padded sequences, longest first (scores: position x sequence x label; size: lengths).

    Also returns the expected transitions, summed over all.
    """
    n = len(scores)
    active = np.searchsorted(-size, -np.arange(1, n + 1), "right")  # sequences that reach each position
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(transitions - transitions.max())
    alpha, beta = np.ones_like(local), np.ones_like(local)
    alpha[0] = local[0] / local[0].sum(axis=1, keepdims=True)
    for t in range(1, n):
        a = active[t]
        now = (alpha[t - 1, :a] @ step) * local[t, :a]
        alpha[t, :a] = now / now.sum(axis=1, keepdims=True)
    pairs = np.zeros_like(step)
    for t in range(n - 2, -1, -1):
        a = active[t + 1]
        ahead = local[t + 1, :a] * beta[t + 1, :a]
        now = ahead @ step.T
        norm = (alpha[t, :a] * now).sum(axis=1, keepdims=True)
        pairs += step * ((alpha[t, :a] / norm).T @ ahead)
        beta[t, :a] = now / now.sum(axis=1, keepdims=True)
    both = alpha * beta
    return both / both.sum(axis=2, keepdims=True), pairs


def _padded(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of sequences of like length: their numbers, lengths, and positions of words (padded with 0)."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    at = 0
    while at < len(order):
        longest = int(size[order[at]])
        stop = min(len(order), at + max(1, _CELLS // longest))
        # No sequence in a group is shorter than half the longest, unless it is short anyway.
        stop = max(at + 1, min(stop, int(np.searchsorted(-size[order], -min(longest // 2, longest - 8), "right"))))
        own = order[at:stop]
        place = np.arange(longest)[:, None] + bounds[own][None, :]
        yield own, size[own], np.where(np.arange(longest)[:, None] < size[own], place, 0)
        at = stop


def _posteriors(model: Model, codes: np.ndarray, bounds: np.ndarray, vocabulary: list[str]) -> np.ndarray:
    """Probability of each label for each word of ``codes``; ``bounds`` cut them into lines."""
    scores = emissions(model, vocabulary)
    out = np.zeros((len(codes), len(model.labels)))
    for _, size, place in _padded(bounds):
        found, _ = forward_backward(scores[codes[place]], model.transitions, size)
        real = np.arange(len(place))[:, None] < size
        out[place[real]] = found[real]
    return out


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Words with letters: codes, bounds of lines, bounds of texts in lines, vocabulary."""
    lines = pc.split_pattern(pc.utf8_lower(pc.fill_null(texts, "")), "\n")
    codes, bounds, vocabulary = words(lines.flatten())
    cleaned = [_cleaned(w) for w in vocabulary.to_pylist()]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for w in cleaned if w))}
    known = np.array([number.get(w, -1) for w in cleaned], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
    kept = known >= 0
    bounds = np.concatenate(([0], np.cumsum(kept)))[bounds]
    starts = lines.offsets.to_numpy().astype(np.int64)
    return known[kept], bounds, starts - starts[0], list(number)


def train(texts: list[str], languages: list[str], seed: int = 7) -> Model:
    """A model from labelled documents (bounded by the caller)."""
    labels = sorted(set(languages))
    gold = {x: i for i, x in enumerate(labels)}
    codes, bounds, owner, vocabulary = _coded(pa.array(texts, pa.string()))
    line_label = np.repeat([gold[x] for x in languages], np.diff(owner)).astype(np.int64) if texts else np.zeros(0, np.int64)
    size = np.diff(bounds)
    word_label = np.repeat(line_label, size)
    counts = np.zeros((len(vocabulary), max(1, len(labels))))
    np.add.at(counts, (codes, word_label), 1)
    share = (counts + 0.2) / (counts.sum(axis=1, keepdims=True) + 0.2 * max(1, len(labels)))
    # Standing: the likeliest language and how sure, of words seen at least three times.
    standing = 1 + counts.argmax(axis=1) * 8 + (share.max(axis=1) * 7.99).astype(np.int64)
    often = counts.sum(axis=1) >= 3
    lexicon = {w: int(s) for w, s, o in zip(vocabulary, standing, often, strict=True) if o}
    model = Model(labels, np.zeros((BUCKETS, len(labels))), np.zeros((len(labels), len(labels))), lexicon)
    if len(labels) < 2 or not len(codes):
        return model
    chance = np.random.default_rng(seed)
    full = np.flatnonzero(size)
    runs = []
    for line in chance.permutation(full):
        own = np.arange(bounds[line], bounds[line + 1])
        if chance.random() < SWITCHES:
            other = chance.choice(full)
            cut, keep = chance.integers(1, len(own) + 1), chance.integers(1, size[other] + 1)
            own = np.concatenate((own[:cut], np.arange(bounds[other], bounds[other] + keep)))
        runs.append(own)
    places = np.concatenate(runs)
    codes, target = codes[places], word_label[places]
    ends = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
    buckets, begin = features(vocabulary, lexicon)
    many = np.diff(np.append(begin, len(buckets)))
    batches = np.array_split(np.arange(len(runs)), min(len(runs), 8))
    square_w, square_t = np.full(model.weights.shape, 1e-4), np.full(model.transitions.shape, 1e-4)
    for turn in range(ROUNDS):
        chosen = batches[turn % len(batches)]
        low, high = ends[chosen[0]], ends[chosen[-1] + 1]
        own, wanted, cuts = codes[low:high], target[low:high], ends[chosen[0] : chosen[-1] + 2] - low
        scores = np.add.reduceat(model.weights[buckets], begin, axis=0)
        error = np.zeros((len(own), len(labels)))
        error[np.arange(len(own)), wanted] = 1
        moves = np.zeros_like(model.transitions)
        inner = np.ones(len(own), bool)
        inner[cuts[:-1]] = False
        later = np.flatnonzero(inner)
        np.add.at(moves, (wanted[later - 1], wanted[later]), 1)
        for _, length, place in _padded(cuts):
            found, pairs = forward_backward(scores[own[place]], model.transitions, length)
            real = np.arange(len(place))[:, None] < length
            error[place[real]] -= found[real]
            moves -= pairs
        per_word = np.stack([np.bincount(own, error[:, k], len(vocabulary)) for k in range(len(labels))], axis=1)
        spread = np.repeat(per_word, many, axis=0)
        slope = np.stack([np.bincount(buckets, spread[:, k], BUCKETS) for k in range(len(labels))], axis=1) / len(own)
        slope -= DECAY * model.weights
        moves = moves / len(own) - DECAY * model.transitions
        square_w += slope**2
        square_t += moves**2
        model.weights += STEP * slope / np.sqrt(square_w)
        model.transitions += STEP * moves / np.sqrt(square_t)
    return model


def sample(labelled: DataFrame, most: int = TRAIN_DOCS) -> tuple[list[str], list[str]]:
    """At most ``most`` texts with their languages, as many of each language, by a hash of their ids."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    each = max(1, most // len(counts))
    span = 1 << 24
    place = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    # The hash thins every language to about twice its share before rows are ranked.
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, span if n <= 4 * each else int(span * 2 * each / n))])
    rows = rows.select("lang", "text", "doc_id", place.alias("place")).filter(F.col("place") < bound[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    rows = rows.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= each)
    found = sorted((r["lang"], r["place"], r["text"]) for r in rows.select("lang", "place", "text").collect())
    return [t for *_, t in found], [x for x, *_ in found]


def _id() -> Column:
    return F.col("doc_id").cast("long").alias("doc_id")


def predicted(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, n_words) of every document, after the string columns named by ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, "text", SLICE_BYTES):
            codes, bounds, lines, vocabulary = _coded(part["text"])
            ends = bounds[lines]
            sums = np.zeros((len(part), max(1, len(model.labels))))
            if model.labels and len(codes):
                owner = np.repeat(np.arange(len(part)), np.diff(ends))
                found = _posteriors(model, codes, bounds, vocabulary)
                sums = np.stack([np.bincount(owner, found[:, k], len(part)) for k in range(len(model.labels))], axis=1)
            n = np.diff(ends)
            best, known = sums.argmax(axis=1), (n > 0) & bool(model.labels)
            score = np.where(known, sums[np.arange(len(part)), best] / np.maximum(n, 1), 0.0)
            label = [model.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            made = [pa.array(label, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(part[c] for c in names), *made], [*names, "lang_pred", "score", "n_words"])

    rows = docs.select(_id(), *[F.col(c).cast("string").alias(c) for c in dict.fromkeys(("text", *keep))])
    kept = "".join(f"{c} string, " for c in keep)
    return rows.mapInArrow(run, f"doc_id long, {kept}lang_pred string, score double, n_words long")


def labelled_runs(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, runs): the words with letters of each text as runs of one likeliest language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, "text", SLICE_BYTES):
            codes, bounds, lines, vocabulary = _coded(part["text"])
            ends = bounds[lines]
            best = _posteriors(model, codes, bounds, vocabulary).argmax(axis=1) if model.labels else None
            out = []
            for a, b in zip(ends, ends[1:], strict=False):
                own = best[a:b] if best is not None else np.zeros(0, np.int64)
                cuts = np.concatenate((np.flatnonzero(np.diff(own, prepend=-1)), [len(own)]))
                out.append([{"lang": model.labels[own[i]], "words": int(j - i)} for i, j in zip(cuts, cuts[1:], strict=False)])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(out, kind)], ["doc_id", "runs"])

    rows = docs.select(_id(), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<lang:string,words:long>>")


def fold(parts: int) -> Column:
    """crc32 of the id as text modulo ``parts`` (null for a null id)."""
    return F.crc32(F.col("doc_id").cast("string")) % parts
