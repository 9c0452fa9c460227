"""Text quality by a factorisation machine over hashed words, structure and metadata.

A document's features are buckets with values: the words it holds (``BUCKETS`` hashes of the word without marks,
weighted by the logarithm of their count), the forms of its words (case pattern and the marks around them), and
one-hot bins of structure statistics (shares of capitals, digits and marks, lengths of words and lines, repeated
words and lines) and of its declared length. The machine scores

    w0 + sum_i w_i x_i + sum_(i<j) <v_i, v_j> x_i x_j

whose last sum is, per factor, half of (sum v x) ** 2 - sum (v x) ** 2: linear in the features held. Weights and factors are
learned by AdaGrad on the logistic loss from at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of their ids (a documented
bound). Scoring is one narrow pass over whole texts; only the model is broadcast (``BUCKETS`` x (``RANK`` + 1) floats).

Language, source, id and labels are no features. Defined cases: null and empty texts have structure features only; a
null ``n_chars`` is a bin of its own; documents with several labels count as their mean, half or more being 1; labels
other than 0 and 1 and labels without id are not learned from; without labels every score is 0.5; rows of one id are
scored one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.arrow import WHITE, release, slices, words

TRAIN_ROWS = 6000
BUCKETS = 1 << 16
RANK = 8
#: Passes over the rows, but so many steps at least.
EPOCHS, STEPS, BATCH, STEP, DECAY = 8, 400, 128, 0.15, 1e-5
ACCEPT = 0.7
BINS = 12
#: Structure bins sit before the hashed buckets: ``STATISTICS`` x ``BINS``.
STATISTICS = 12
_OFFSET = STATISTICS * BINS
WIDTH = _OFFSET + BUCKETS


@dataclass
class Model:
    bias: float
    linear: np.ndarray  # WIDTH
    factors: np.ndarray  # WIDTH x RANK


def _buckets(kind: bytes, strings: pa.Array) -> np.ndarray:
    """A hashed bucket for each string; strings that repeat are hashed once."""
    coded = strings.dictionary_encode()
    own = [xxhash.xxh32_intdigest(kind + x.encode("utf-8", "surrogatepass"), 11) % BUCKETS for x in coded.dictionary.to_pylist()]
    return _OFFSET + np.array(own, np.int64)[coded.indices.to_numpy()]


def word_buckets(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each word the bucket of its lower case without marks around it (-1 if only marks), and that of its form.

    The form is the marks before and after it (four at most) and whether it is capital, capitalised, digits or else.
    """
    core = pc.utf8_trim(found, characters=string.punctuation)
    right = pc.utf8_ltrim(found, characters=string.punctuation)
    before = pc.subtract(pc.utf8_length(found), pc.utf8_length(right)).to_numpy(zero_copy_only=False)
    after = pc.subtract(pc.utf8_length(right), pc.utf8_length(core)).to_numpy(zero_copy_only=False)
    marks = [np.full(len(found), "", object), np.full(len(found), "", object)]
    for i in np.flatnonzero((before > 0) | (after > 0)):
        word = found[i].as_py()
        marks[0][i], marks[1][i] = word[: min(4, before[i])], word[len(word) - after[i] :][:4]
    kind = np.where(pc.utf8_is_upper(pc.utf8_slice_codeunits(core, 0, 1)).to_numpy(zero_copy_only=False), "Aa", "a").astype(object)
    kind[pc.utf8_is_digit(core).to_numpy(zero_copy_only=False)] = "0"
    kind[(pc.utf8_is_upper(core).to_numpy(zero_copy_only=False)) & (pc.utf8_length(core).to_numpy(zero_copy_only=False) > 1)] = "A"
    form = pa.array(marks[0] + "|" + kind + "|" + marks[1], pa.string())
    own = _buckets(b"w", pc.utf8_lower(core))
    own[pc.equal(core, "").to_numpy(zero_copy_only=False)] = -1
    return own, _buckets(b"f", form)


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[np.frombuffer(chars.encode(), np.uint8)] = 1
    return table


#: ASCII classes that are counted by byte; bytes 128 to 191 continue a character.
_CLASSES = [_class(string.ascii_uppercase), _class(string.digits), _class(string.punctuation), _class(WHITE)]
_CLASSES.append((np.arange(256) >> 6 == 2).astype(np.int64))


def _counts(text: pa.Array) -> np.ndarray:
    """Per text: characters, capitals, digits, marks and white space."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    sums = [np.diff(np.concatenate(([0], np.cumsum(table[data])))[at]) for table in _CLASSES]
    return np.stack([np.diff(at) - sums[4], *sums[:4]], axis=1).astype(np.float64)


def _bins(value: np.ndarray) -> np.ndarray:
    """Shares in [0, 1] as bins, finer towards 0."""
    return np.minimum((np.sqrt(np.clip(value, 0, 1)) * (BINS - 1)).astype(np.int64) + (value > 0), BINS - 1)


def _log_bins(value: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(value, 0) + 1).astype(np.int64), BINS - 1)


def features(texts: pa.Array, declared: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and values of all texts one after another, and the bounds of each text."""
    text = pc.fill_null(texts, "")
    lines = pc.split_pattern(text, "\n")
    at = lines.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    flat = lines.flatten().dictionary_encode()
    line_codes = flat.indices.to_numpy().astype(np.int64)
    codes, bounds, found = words(text)
    own, form = word_buckets(found)
    n, owner = len(text), np.repeat(np.arange(len(text)), np.diff(bounds))
    count, sums = np.diff(bounds).astype(np.float64), _counts(text)
    size, capitals, digits, marks, white = sums.T
    keys = owner * len(found) + codes
    distinct = np.bincount(np.unique(keys) // max(1, len(found)), minlength=n)
    line_owner = np.repeat(np.arange(n), np.diff(at))
    line_count = np.diff(at).astype(np.float64)
    different = np.bincount(np.unique(line_owner * max(1, len(flat.dictionary)) + line_codes) // max(1, len(flat.dictionary)), minlength=n)
    chars, some, lots = np.maximum(size - white, 1), np.maximum(count, 1), np.maximum(line_count, 1)
    known = pc.is_valid(declared).to_numpy(zero_copy_only=False)
    stated = pc.fill_null(declared, 0).to_numpy(zero_copy_only=False).astype(np.float64)
    bins = [
        _log_bins(count),
        _log_bins(line_count),
        _bins((chars - digits - marks) / chars),
        _bins(capitals / chars),
        _bins(digits / chars),
        _bins(marks / chars),
        np.minimum((chars / some).astype(np.int64), BINS - 1),
        _bins(1 - distinct / some),
        _bins(1 - different / lots),
        _log_bins(count / lots),
        _bins(white / np.maximum(size, 1)),
        np.where(known, np.minimum((np.log2(np.maximum(stated, 0) + 1) / 2).astype(np.int64), BINS - 2), BINS - 1),
    ]
    rows, held = np.concatenate((owner, owner)), np.concatenate((own[codes], form[codes]))
    rows, held = rows[held >= 0], held[held >= 0]
    pairs, times = np.unique(rows * WIDTH + held, return_counts=True)
    rows, held = pairs // WIDTH, pairs % WIDTH
    value = np.log1p(times.astype(np.float64))
    norm = np.sqrt(np.bincount(rows, value * value, n))
    value = value / np.where(norm > 0, norm, 1)[rows]
    # Structure bins share a weight that keeps them on the scale of the words.
    fixed = np.stack([k * BINS + b for k, b in enumerate(bins)], axis=1)
    rows = np.concatenate((rows, np.repeat(np.arange(n), STATISTICS)))
    held = np.concatenate((held, fixed.ravel()))
    value = np.concatenate((value, np.full(n * STATISTICS, 0.5)))
    order = np.argsort(rows, kind="stable")
    return held[order], value[order], np.searchsorted(rows[order], np.arange(n + 1))


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, values[:, k], n) for k in range(values.shape[1])], axis=1)


def scores(model: Model, held: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The machine's probability of label 1 for each text."""
    n, owner = len(bounds) - 1, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    vx = model.factors[held] * value[:, None]
    once = _sums(vx, owner, n)
    pairs = 0.5 * ((once * once).sum(axis=1) - np.bincount(owner, (vx * vx).sum(axis=1), n))
    raw = model.bias + np.bincount(owner, model.linear[held] * value, n) + pairs
    return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def train(held: np.ndarray, value: np.ndarray, bounds: np.ndarray, labels: np.ndarray, seed: int = 5) -> Model:
    """A machine learned from rows of features (bounded by the caller)."""
    chance = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(WIDTH), chance.normal(0, 0.02, (WIDTH, RANK)))
    n = len(labels)
    if not n:
        model.factors[:] = 0
        return model
    share = (labels.sum() + 1) / (n + 2)
    model.bias = float(np.log(share / (1 - share)))
    square_b, square_w, square_v = 1e-2, np.full(WIDTH, 1e-2), np.full((WIDTH, RANK), 1e-2)
    size = np.diff(bounds)
    for _ in range(max(EPOCHS, -(-STEPS // -(-n // BATCH)))):
        order = chance.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            flat = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
            own, x = held[flat], value[flat]
            cut = np.concatenate(([0], np.cumsum(size[rows])))
            error = (scores(model, own, x, cut) - labels[rows]) / len(rows)
            owner = np.repeat(np.arange(len(rows)), size[rows])
            names, place = np.unique(own, return_inverse=True)
            vx = model.factors[own] * x[:, None]
            once = _sums(vx, owner, len(rows))
            slope = error[owner] * x
            g_w = np.bincount(place, slope, len(names)) + DECAY * model.linear[names]
            g_v = _sums(slope[:, None] * (once[owner] - vx), place, len(names)) + DECAY * model.factors[names]
            square_b += error.sum() ** 2
            square_w[names] += g_w**2
            square_v[names] += g_v**2
            model.bias -= STEP * error.sum() / np.sqrt(square_b)
            model.linear[names] -= STEP * g_w / np.sqrt(square_w[names])
            model.factors[names] -= STEP * g_v / np.sqrt(square_v[names])
    return model


def fold(parts: int) -> Column:
    """crc32 of the id as text modulo ``parts`` (null for a null id)."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def _inputs(docs: DataFrame, *more: Column) -> DataFrame:
    text, size = F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("n_chars")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, size, *more)


def _row_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        held, value, bounds = features(part["text"], part["n_chars"])
        held, value = held.astype("<i4"), value.astype("<f4")
        cut = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        made = [pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (held, value)]
        yield pa.RecordBatch.from_arrays([part["doc_id"], part["label"], *made], ["doc_id", "label", "held", "value"])
        release()


def learned(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """A machine from at most ``most`` labelled rows, by a hash of their ids."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = usable.orderBy(order, "doc_id").limit(most)
    # At most ``most`` narrow rows.
    rows = _inputs(docs).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", "text", "n_chars", "label")
    rows = rows.mapInArrow(_row_features, "doc_id long, label int, held binary, value binary")
    found = rows.orderBy(order, "doc_id", "held", "value").limit(most).collect()
    held = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["held"], "<i4") for r in found]]).astype(np.int64)
    value = np.concatenate([np.zeros(0), *[np.frombuffer(r["value"], "<f4") for r in found]]).astype(np.float64)
    bounds = np.concatenate(([0], np.cumsum([len(r["held"]) // 4 for r in found]))).astype(np.int64)
    return train(held, value, bounds, np.array([r["label"] for r in found], np.float64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    small = Model(model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = scores(shared.value, *features(part["text"], part["n_chars"]))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(found, pa.float64())], ["doc_id", "score"])
            release()

    rows = _inputs(docs).mapInArrow(run, "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
