"""A word n-gram language model by deleted interpolation.

Words are runs between ASCII white space with A-Z lower-cased; every text ends in an end token, and its
first words follow a start symbol. The probability of a word is a mixture of its maximum-likelihood
estimates after contexts of ``ORDER`` - 1, ..., 0 words and of the uniform distribution over the vocabulary
and one unknown word. The mixture weights depend on how often the longest context occurred (buckets of a
doubling each) and are learned by expectation-maximisation on held-out counts: documents whose fold is
``HELD_FOLD`` are scored with the counts of the other training documents; then all training documents count.

Counts cover all documents. The corpus is cut into blocks of about ``BLOCK_BYTES``; a block's distinct
n-grams (by hashes) with their counts go, in slices of the hash range, to the tasks that add them up,
and the sums come back to the blocks in the same order. Everything a task holds is one block or one slice;
hashes spread evenly, so frequent words make no task large: a block sends each n-gram once.

Defined cases: a null or empty text is the end token alone; rows with a null id are scored but not trained
on; repeated rows count as often as they occur; without training documents every probability is uniform;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.arrow import release, slices, stored, words

ORDER = 2
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 12 << 20
#: Hashes of n-grams of several words have so many bits more than their number has; one n-gram in 2^20
#: meets another one. Single words have all 64 bits.
HASH_BITS = 20
HELD_FOLD = 3
TEST_FOLD = 2
ROUNDS = 30
#: Buckets of context counts: none, 1, 2-3, 4-7, ...
BUCKETS = 32
#: Estimates are binned to twelfths of a decade, down to 1e-11, for the held-out statistics.
GRID, _DECADE = 132, 12
_START, _END = np.uint64(0x5F356495C1B2A7D3), np.uint64(0x2545F4914F6CDD1D)
_BLOCK = "block long, held boolean, ids binary, folds binary, bounds binary, codes binary, hashes binary"


def _mixed(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    x = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (after + (before >> np.uint64(23)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


class _Builder:
    """Collects coded texts to one block."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.hashes, self.codes, self.sizes, self.ids, self.folds, self.bytes = [], [], [], [], [], 0

    def add(self, part: pa.RecordBatch) -> None:
        texts = pc.ascii_lower(pc.fill_null(part["text"], ""))
        codes, bounds, vocabulary = words(texts)
        own = vocabulary.cast(pa.binary()).to_pylist()
        index = np.array([self.known.setdefault(w, len(self.known)) for w in own], np.int64)
        fresh = len(self.known) - sum(map(len, self.hashes))
        if fresh:
            new = np.flatnonzero(index >= len(self.known) - fresh)
            self.hashes.append(np.array([xxhash.xxh64_intdigest(own[i], 3) for i in new], np.uint64))
        self.codes.append((index[codes] if len(codes) else codes).astype("<i4"))
        self.sizes.append(np.diff(bounds))
        self.ids.append(pc.fill_null(part["doc_id"], -(2**63)).to_numpy(zero_copy_only=False))
        self.folds.append(part["fold"].to_numpy(zero_copy_only=False))
        self.bytes += pc.sum(pc.binary_length(texts)).as_py() or 0

    def row(self, block: int, held: bool) -> pa.RecordBatch:
        data = {
            "block": [block],
            "held": [held],
            "ids": [np.concatenate(self.ids).astype("<i8").tobytes()],
            "folds": [np.concatenate(self.folds).astype("<i1").tobytes()],
            "bounds": [np.concatenate(([0], np.cumsum(np.concatenate(self.sizes)))).astype("<i8").tobytes()],
            "codes": [_planes(np.concatenate(self.codes))],
            "hashes": [np.concatenate([np.zeros(0, np.uint64), *self.hashes]).astype("<u8").tobytes()],
        }
        return pa.RecordBatch.from_pydict(data)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of coded texts; held-out documents get blocks of their own."""
    task, made, open_ = TaskContext.get().partitionId(), 0, {}
    for part in slices(batches, "text", BLOCK_BYTES // 4):
        for held in (False, True):
            own = part.filter(pc.equal(part["fold"], HELD_FOLD) if held else pc.not_equal(part["fold"], HELD_FOLD))
            if len(own):
                builder = open_.setdefault(held, _Builder())
                builder.add(own)
                if builder.bytes >= BLOCK_BYTES:
                    yield open_.pop(held).row(task << 32 | made, held)
                    made += 1
    for held, builder in open_.items():
        yield builder.row(task << 32 | made, held)
        made += 1


class _Block:
    """One stored block: its tokens' n-grams of every order."""

    def __init__(self, row, order: int, bits: int):
        self.number, self.order = int(row.block), order
        self.ids, self.folds = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.folds, "<i1")
        bounds = np.frombuffer(row.bounds, "<i8")
        codes, hashes = _whole(row.codes, "<i4"), np.frombuffer(row.hashes, "<u8")
        n = np.diff(bounds) + 1  # with the end token
        self.ends = np.cumsum(n)
        self.begins = self.ends - n
        tokens = np.insert(hashes[codes] if len(codes) else np.zeros(0, "<u8"), bounds[1:], _END)
        self.text = np.repeat(np.arange(len(n)), n)
        self.grams = [tokens]
        place = np.arange(len(tokens)) - np.repeat(self.begins, n)
        for k in range(1, order):
            earlier = np.full(len(tokens), _START, np.uint64)
            real = place >= k
            earlier[real] = tokens[np.flatnonzero(real) - k]
            self.grams.append(_mixed(earlier, self.grams[-1]))
        low = np.uint64(64 - bits)
        self.grams[1:] = [g >> low << low for g in self.grams[1:]]

    def keys(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct k-grams in order, and each token's place among them; for one word also the start."""
        own = self.grams[k - 1]
        if k == 1:
            own = np.append(own, _START)
        return np.unique(own, return_inverse=True)

    def trained(self) -> np.ndarray:
        """Whether each token's document is trained on."""
        fold = self.folds[self.text]
        return (fold >= 0) & (fold != TEST_FOLD)


def _cut(keys: np.ndarray, slices_: int) -> np.ndarray:
    """Where each slice of the hash range begins among sorted keys."""
    edges = [(i << 64) // slices_ for i in range(1, slices_)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]))


def _sent(order: int, bits: int, slices_: int):
    """Per block, order and slice: distinct n-grams with the counts of the block's training documents."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                release()
                block = _Block(row, order, bits)
                trained = block.trained()
                for k in range(1, order + 1):
                    keys, place = block.keys(k)
                    weight = np.append(trained, False) if k == 1 else trained
                    n = np.bincount(place[weight], minlength=len(keys))
                    if k == 1:
                        n[place[-1]] = len(np.unique(block.text[trained]))  # documents begin with the start
                    cut = _cut(keys, slices_)
                    yield pd.DataFrame(
                        {
                            "part": np.arange(slices_),
                            "block": block.number,
                            "k": k,
                            "held": row.held,
                            "keys": [_planes(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(cut, cut[1:], strict=False)],
                            "n": [_planes(n[a:b].astype("<u4")) for a, b in zip(cut, cut[1:], strict=False)],
                        }
                    )

    return run


def _planes(values: np.ndarray) -> bytes:
    """Integers byte by byte, high bytes together, which packs well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _whole(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """Add up one slice; answers each block with the sums of its n-grams, all and without held-out ones."""
    release()
    keys = [np.cumsum(_whole(x, "<u8"), dtype=np.uint64) for x in rows["keys"]]
    n = [_whole(x, "<u4") for x in rows["n"]]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(n), len(distinct)).astype(np.int64)
    held = np.repeat(rows["held"].to_numpy(bool), [len(x) for x in keys])
    kept = total - np.bincount(place[held], np.concatenate(n)[held], len(distinct)).astype(np.int64)
    cuts = np.cumsum([len(x) for x in keys])[:-1]
    answers = np.split(place, cuts)
    out = pd.DataFrame({"block": rows["block"].to_numpy(), "part": rows["part"].to_numpy(), "k": rows["k"].to_numpy()})
    out["n"] = [_planes(total[x].astype("<i8")) for x in answers]
    # Only held-out blocks ask for the counts without held-out documents.
    out["kept"] = [_planes(kept[x].astype("<i8")) if h else b"" for x, h in zip(answers, rows["held"], strict=True)]
    words_ = rows["k"].iloc[0] == 1
    real = distinct != _START
    total_, kept_ = total[real], kept[real]
    sums = [int(total_.sum()), int((total_ > 0).sum()), int(kept_.sum()), int((kept_ > 0).sum())] if words_ else [0] * 4
    last = pd.DataFrame({"block": [-1], "part": [0], "k": [0], "n": [np.array(sums, "<i8").tobytes()], "kept": [b""]})
    return pd.concat([out, last], ignore_index=True)


def _estimates(block: _Block, answers: pd.DataFrame, column: str, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: maximum-likelihood estimates by order (columns), the bucket, and the word's count."""
    counts = []
    for k in range(1, block.order + 1):
        own = answers[answers["k"] == k].sort_values("part")
        values = np.concatenate([_whole(x, "<i8") for x in own[column]])
        place = block.keys(k)[1]
        counts.append(values[place])
    start = int(counts[0][-1])
    counts[0] = counts[0][:-1]
    made = np.zeros((len(counts[0]), block.order))
    made[:, 0] = counts[0] / max(tokens, 1)
    context = np.full(len(counts[0]), tokens)
    for k in range(1, block.order):
        # The context's count: the (k)-gram that ends at the token before, or starts of documents.
        context = np.full(len(counts[0]), start)
        inner = np.ones(len(counts[0]), bool)
        inner[block.begins] = False
        context[inner] = counts[k - 1][np.flatnonzero(inner) - 1]
        made[:, k] = np.divide(counts[k], context, out=np.zeros(len(context)), where=context > 0)
    bucket = np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)
    return made, np.minimum(bucket, BUCKETS - 1), counts[0]


def _binned(estimates: np.ndarray) -> np.ndarray:
    """Bins of estimates: 0 for none, else twelfths of a decade from the smallest."""
    with np.errstate(divide="ignore"):
        bins = np.rint(np.log10(estimates) * _DECADE) + GRID
    return np.where(estimates > 0, np.clip(bins, 1, GRID), 0).astype(np.int64)


def _held_out(order: int, bits: int, tokens: int):
    """Counts of held-out tokens per bucket and binned estimates."""

    def run(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        release()
        block = _Block(next(blocks.itertuples()), order, bits)
        made, bucket, _ = _estimates(block, answers, "kept", tokens)
        cell = bucket
        for k in range(order):
            cell = cell * (GRID + 1) + _binned(made[:, k])
        cells, n = np.unique(cell, return_counts=True)
        return pd.DataFrame({"cell": cells, "n": n})

    return run


def learned_weights(cells: np.ndarray, n: np.ndarray, order: int, uniform: float) -> np.ndarray:
    """Mixture weights by bucket (rows): the uniform distribution, then orders 1 and up."""
    weights = np.full((BUCKETS, order + 1), 1 / (order + 1))
    weights[0, 2:] = 0  # a context that never occurred has no estimate
    weights[0] /= weights[0].sum()
    if not len(cells):
        return weights
    bins = np.zeros((len(cells), order), np.int64)
    left = cells.copy()
    for k in reversed(range(order)):
        bins[:, k], left = left % (GRID + 1), left // (GRID + 1)
    chance = np.where(bins > 0, 10.0 ** ((bins - GRID) / _DECADE), 0)
    chance = np.concatenate((np.full((len(cells), 1), uniform), chance), axis=1)
    for _ in range(ROUNDS):
        parts = weights[left] * chance
        parts *= (n / parts.sum(axis=1))[:, None]
        total = np.stack([np.bincount(left, parts[:, j], BUCKETS) for j in range(order + 1)], axis=1)
        seen = total.sum(axis=1) > 0
        # One token's worth of the present weights keeps every mixture proper.
        total = total + weights
        weights[seen] = (total / total.sum(axis=1, keepdims=True))[seen]
    return weights


def _scored(order: int, bits: int, tokens: int, distinct: int, weights: np.ndarray):
    uniform = 1 / (distinct + 1)

    def run(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        release()
        block = _Block(next(blocks.itertuples()), order, bits)
        made, bucket, known = _estimates(block, answers, "n", tokens)
        mixed = weights[bucket]
        chance = mixed[:, 0] * uniform + (mixed[:, 1:] * made).sum(axis=1)
        base = np.log10((known + 1) / (tokens + 1 * (distinct + 1)))
        at = block.begins
        return pd.DataFrame(
            {
                "doc_id": pd.array(block.ids, "Int64").copy(),
                "held_out": block.folds == TEST_FOLD,
                "n_tokens": block.ends - block.begins,
                "n_known": np.add.reduceat((known > 0).astype(np.int64), at),
                "train_tokens": tokens,
                "base_score": np.add.reduceat(base, at),
                "score": np.add.reduceat(np.log10(chance), at),
            }
        ).assign(doc_id=lambda x: x["doc_id"].mask(x["doc_id"] == -(2**63)))

    return run


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Documents of fold ``TEST_FOLD`` (crc32 of the id as text modulo 7) are not trained on.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7, F.lit(-1)).cast("byte").alias("fold")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), fold)
    blocks = stored(rows.mapInArrow(_blocks, _BLOCK), "lm-blocks")
    size = blocks.agg(F.sum(F.octet_length("codes"))).first()[0] or 0
    bits = min(64, HASH_BITS + (int(size) // 4 + 1).bit_length())
    slices_ = max(1, -(-int(size) * 2 * order // SLICE_BYTES))
    sent = blocks.mapInPandas(_sent(order, bits, slices_), "part int, block long, k int, held boolean, keys binary, n binary")
    answer = "block long, part int, k int, n binary, kept binary"
    answers = stored(sent.groupBy("part", "k").applyInPandas(_summed, answer), "lm-counts")
    sums = np.zeros(4, np.int64)
    for row in answers.filter("block = -1").select("n").toLocalIterator():  # one row per slice
        sums += np.frombuffer(row["n"], "<i8")
    tokens, distinct, kept_tokens, kept_distinct = map(int, sums)

    def together(held: str, run, schema: str) -> DataFrame:
        left = blocks.filter(held).groupBy("block")
        return left.cogroup(answers.filter("block >= 0").groupBy("block")).applyInPandas(run, schema)

    asked = answers.filter("block >= 0 and octet_length(kept) > 0")
    cells = blocks.filter("held").groupBy("block").cogroup(asked.groupBy("block"))
    cells = cells.applyInPandas(_held_out(order, bits, kept_tokens), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = learned_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64), order, 1 / (kept_distinct + 1))
    if not tokens:
        weights = np.eye(1, order + 1).repeat(BUCKETS, axis=0)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return together("true", _scored(order, bits, tokens, distinct, weights), schema)
