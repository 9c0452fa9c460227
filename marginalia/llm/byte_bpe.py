"""Byte-level BPE: encode by ranks and decode, in length-bucketed padded numpy matrices.

A text is cut by ``PATTERN``; each piece of UTF-8 bytes becomes a row of byte tokens in a matrix of rows of
about its length (padded with -1). In each round every row merges its leftmost pair of least rank. Ranks
come from an open-addressing hash table of pairs (``Ranks``); rows without a mergeable pair leave the
matrix, and merged cells are closed up. Rows longer than ``WIDE`` merge all occurrences of their least
pair in a round, left to right, unless that makes a pair of smaller rank on the way; then only the
leftmost one. Either gives the tokens that merging one pair at a time gives.

Pieces repeat, so each batch encodes its distinct pieces only, and a worker remembers up to ``REMEMBERED``
runs of them; this changes no result. The rank file is the caller's; a task reads it once from a broadcast.

Defined cases: a null text is encoded like an empty one: no tokens; very long pieces, repeated ids,
ties and empty tables need no care; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.arrow import TokenMemory, ranges, slices

WIDE = 64
REMEMBERED = 300_000
_NONE = np.int32(2**31 - 1)
_PROBE = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of lines "base64 rank" with ranks 0 to n - 1."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Ranks:
    """Pairs of token ids hashed to the id (which is the rank) of their joint token."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        rank = {token: i for i, token in enumerate(tokens)}
        self.bytes_id = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        left, right, made = [], [], []
        for token, i in rank.items():
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        keys = self._key(np.array(left, np.int64), np.array(right, np.int64))
        made = np.array(made, np.int32)
        bits = max(4, int(np.ceil(np.log2(len(keys) * 2 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.made = np.full(1 << bits, _NONE, np.int32)
        at = self._slot(keys)
        self.probes = 0
        while len(keys):
            self.probes += 1
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several rivals the last one stays
            won = self.keys[at] == keys
            self.made[at[won]] = made[won]
            keys, made, at = keys[~won], made[~won], (at[~won] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _PROBE) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joint token's id per pair, or the largest int32 where there is none."""
        keys = self._key(left, right)
        at = self._slot(keys)
        found = np.where(self.keys[at] == keys, self.made[at], _NONE)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            here, want = self.keys[at[open_]], keys[open_]
            hit = here == want
            found[open_[hit]] = self.made[at[open_[hit]]]
            open_ = open_[~hit & (here != -1)]
        return found


def _pair_ranks(ranks: Ranks, cells: np.ndarray) -> np.ndarray:
    """Rank of the pair that begins at each cell; none at the last token and beyond."""
    out = np.full(cells.shape, _NONE, np.int32)
    real = cells[:, 1:] >= 0
    out[:, :-1][real] = ranks.of(cells[:, :-1][real], cells[:, 1:][real])
    return out


def _closed(cells: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Rows without the cells marked as gone, closed up to the left."""
    stay = (cells >= 0) & ~gone
    n = stay.sum(axis=1)
    out = np.full((len(cells), max(1, int(n.max(initial=1)))), -1, np.int32)
    out[np.arange(out.shape[1]) < n[:, None]] = cells[stay]
    return out


def _merge_narrow(ranks: Ranks, cells: np.ndarray) -> list[np.ndarray]:
    """Each round: every row merges its leftmost pair of least rank. Returns tokens per row."""
    done: list[np.ndarray | None] = [None] * len(cells)
    rows = np.arange(len(cells))
    pair = _pair_ranks(ranks, cells)
    while len(cells):
        at = pair.argmin(axis=1)
        line = np.arange(len(cells))
        least = pair[line, at]
        over = least == _NONE
        if over.any():
            for i in np.flatnonzero(over):
                done[rows[i]] = cells[i][cells[i] >= 0]
            cells, pair, rows, at, least = cells[~over], pair[~over], rows[~over], at[~over], least[~over]
            line = np.arange(len(cells))
            if not len(cells):
                break
        cells[line, at] = least
        shift = np.arange(cells.shape[1] - 1) + (np.arange(cells.shape[1] - 1) > at[:, None])
        pair = np.take_along_axis(pair, shift, axis=1)
        cells = np.take_along_axis(cells, shift, axis=1)
        if cells.shape[1] == 1:
            pair[:, 0] = _NONE
            continue
        after = cells[line, np.minimum(at + 1, cells.shape[1] - 1)]
        new = np.full(len(cells), _NONE, np.int32)
        ok = (at + 1 < cells.shape[1]) & (after >= 0)
        new[ok] = ranks.of(cells[line[ok], at[ok]], after[ok])
        pair[line, at] = new
        ok = at > 0
        pair[line[ok], at[ok] - 1] = ranks.of(cells[line[ok], at[ok] - 1], cells[line[ok], at[ok]])
    return done


def _merge_wide(ranks: Ranks, row: np.ndarray) -> np.ndarray:
    """One long row: all occurrences of the least pair per round, where that equals one at a time."""
    while len(row) > 1:
        pair = ranks.of(row[:-1], row[1:])
        least = pair.min()
        if least == _NONE:
            break
        at = np.flatnonzero(pair == least)
        # Overlapping occurrences: in a run of neighbours every second one counts.
        run = np.concatenate(([0], np.cumsum(np.diff(at) != 1)))
        first = np.searchsorted(run, run, "left")
        at = at[(np.arange(len(at)) - first) % 2 == 0]
        token = np.full(len(at), least, np.int32)
        right = at + 2 < len(row)
        made = ranks.of(token[right], row[at[right] + 2]).min(initial=_NONE)
        left = at > 0
        before = row[at[left] - 1].copy()
        joined = np.isin(at[left] - 2, at)
        before[joined] = least
        made = min(made, ranks.of(before, token[left]).min(initial=_NONE))
        if made < least:
            at = at[:1]
        row = row.copy()
        row[at] = least
        row = np.delete(row, at + 1)
    return row


def encode_pieces(ranks: Ranks, pieces: list[bytes]) -> list[np.ndarray]:
    """Tokens of each piece of bytes."""
    size = np.array([len(p) for p in pieces], np.int64)
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    start = 0
    while start < len(order):
        longest = int(size[order[start]])
        if longest > WIDE:
            for i in order[start:]:
                out[i] = _merge_wide(ranks, ranks.bytes_id[np.frombuffer(pieces[i], np.uint8)])
            break
        # A bucket: rows up to a quarter longer than its first, about a million cells at most.
        stop = int(np.searchsorted(size[order], min(WIDE, longest + longest // 4), "right"))
        stop = min(stop, start + max(1, 1_000_000 // (longest + longest // 4)))
        own = order[start:stop]
        n = size[own]
        cells = np.full((len(own), int(n.max())), -1, np.int32)
        joined = np.frombuffer(b"".join([pieces[i] for i in own]), np.uint8)
        cells[np.arange(cells.shape[1]) < n[:, None]] = ranks.bytes_id[joined]
        for i, tokens in zip(own, _merge_narrow(ranks, cells), strict=True):
            out[i] = tokens
        start = stop
    return out


class Encoder:
    """Texts to ids and back; remembers the tokens of runs it has seen.

    A run begins at every space or line feed (and at the start). ``PATTERN``-like patterns never match
    across the start of a run whose left neighbour is no white space, so distinct runs are cut by the
    pattern once; texts in which a run ends in white space are cut by the pattern as a whole.
    """

    def __init__(self, tokens: list[bytes], pattern: str):
        self.ranks, self.find = Ranks(tokens), regex.compile(pattern).findall
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.joined = np.frombuffer(b"".join(tokens), np.uint8)
        self.memory = TokenMemory(self._learn, REMEMBERED)

    def _learn(self, runs: list[str]) -> tuple[list[np.ndarray], list[int]]:
        found = [self.find(x) for x in runs]
        pieces = list(dict.fromkeys(p for own in found for p in own))
        tokens = dict(zip(pieces, encode_pieces(self.ranks, [p.encode() for p in pieces]), strict=True))
        return [tokens[p] for own in found for p in own], [sum(len(tokens[p]) for p in own) for own in found]

    def _runs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Codes of the runs of each text, their bounds, and the runs."""
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", "\x1e\n"), " ", "\x1e ")
        parts = pc.split_pattern(marked, "\x1e")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        codes, runs = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        loose = np.fromiter((x[-1:].isspace() for x in runs), bool, len(runs))
        odd = np.logical_or.reduceat(np.append(loose[codes], False), bounds[:-1]) if len(texts) else np.zeros(0, bool)
        odd |= pc.match_substring(texts, "\x1e").to_numpy(zero_copy_only=False)
        if odd.any():
            at = {x: i for i, x in enumerate(runs)}
            own = np.split(codes, bounds[1:-1])
            for i in np.flatnonzero(odd):
                pieces = self.find(texts[int(i)].as_py())
                own[i] = np.array([at.setdefault(p, len(at)) for p in pieces], codes.dtype)
            codes, runs = np.concatenate(own), list(at)
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in own])))
        return codes, bounds, runs

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts one after another, and the bounds of each text."""
        codes, bounds, runs = self._runs(texts)
        ids, at = self.memory.tokens(codes, runs)
        return ids, at[bounds]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        return self.joined[ranges(self.starts[ids], self.lengths[ids])].tobytes() if len(ids) else b""


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(tokens: list[bytes], pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = (len(tokens), pattern, hashlib.sha256(b"\0".join(tokens)).digest())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokens, pattern)
    return _ENCODERS[key]


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids: little-endian unsigned 32-bit integers, decoded: bytes) per document."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for part in slices(batches, "text", 4 << 20):
            ids, bounds = encoder.encode(pc.fill_null(part["text"], ""))
            own = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    pa.array([x.astype("<u4").tobytes() for x in own], pa.binary()),
                    pa.array([encoder.decode(x) for x in own], pa.binary()),
                ],
                ["doc_id", "ids", "decoded"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the encoded rows."""
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
