"""Exact top-k of many requests over rows of terms, on bitmaps.

A row scores ``SNIPPET_POINTS`` for every term of a request that its snippet holds (strong) and ``HAYSTACK_POINTS`` for
one that only its label holds (weak). Rows come in blocks; a block keeps one bitmap of rows for every term.

Every request has a floor, the score and ``seq`` of its k-th best row among some rows looked at first (the longest, and
the first ones). A row has to reach it, hence to hold a number of the request's terms; so it holds at least ``SIFT`` of any
choice that leaves out ``SIFT`` terms less than that number. Terms that no row of a block holds are left out first, then the
commonest: a few bitmap operations leave some hundredths of the words of rows, and only in those all terms are counted, 64
rows at a time. Nothing is approximated: a floor is the score of a real row, and where there is none every row with a term counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a block: bounds the bitmaps to terms x BLOCK / 8 bytes.
BLOCK = 2048
#: Requests taken together: bounds the pairs of requests and rows that are open at a time.
CHUNK = 512
#: Rarest terms of which a row has to hold so many before all are counted.
SIFT = 3
#: Bytes of text that are words at a time, and words that a finder remembers.
PART_BYTES = 1 << 22
REMEMBERED = 1 << 19
#: Pairs of requests and rows that wait to be ranked.
PENDING = 1 << 20
SNIPPET_POINTS = 2
HAYSTACK_POINTS = 1
FIRST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

#: Finds terms in a list of words: the places of the words, and the numbers of the terms that they hold.
Find = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


@dataclass
class Requests:
    """Requests as rows of term numbers; slot n has the terms ``tid[ptr[n]:ptr[n + 1]]``."""

    ids: list
    terms: list[str]
    ptr: np.ndarray
    tid: np.ndarray
    floor: np.ndarray = field(default=None)
    floor_seq: np.ndarray = field(default=None)
    key: str = ""

    def __post_init__(self) -> None:
        self.key = self.key or uuid.uuid4().hex
        if self.floor is None:
            self.floor = np.ones(len(self.ids), np.int32)
            self.floor_seq = np.full(len(self.ids), LAST, np.int64)


def requests(ids: list, term_lists: Iterable[list[str]]) -> Requests:
    """Requests of the given ids and lists of different terms."""
    numbers: dict[str, int] = {}
    flat, ptr = [], [0]
    for terms in term_lists:
        flat += [numbers.setdefault(term, len(numbers)) for term in terms]
        ptr.append(len(flat))
    return Requests(ids, list(numbers), np.array(ptr, np.int64), np.array(flat, np.int32))


@dataclass
class Block:
    """Some rows: their ``seq``, ids, and numbers of the terms that each holds strongly and weakly."""

    seq: np.ndarray
    ids: np.ndarray
    strong: list[np.ndarray]
    weak: list[np.ndarray]


def _different(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``size`` of them, one run after another."""
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat((first - (ends - size)).astype(np.int32), size) + np.arange(total, dtype=np.int32)


def held_terms(find: Find, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different terms of each word: word n has ``terms[ptr[n]:ptr[n + 1]]``."""
    word, term = find(words)
    most = int(term.max(initial=0)) + 1
    word, term = np.divmod(_different(word.astype(np.int64) * most + term), most)
    return np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))], term.astype(np.int32)


class Words:
    """The numbers of the terms in words, looked up once per word. No term holds white space, so a text holds the terms of
    its words."""

    def __init__(self, find: Find) -> None:
        self.find = find
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ptr, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        ptr, term = held_terms(self.find, words)
        self.number |= zip(words, range(len(self.number), len(self.number) + len(words)), strict=True)
        self.ptr = np.concatenate([self.ptr, self.ptr[-1] + ptr[1:]])
        self.flat = np.concatenate([self.flat, term])

    def of_texts(self, texts: pa.Array, terms: int) -> np.ndarray:
        """Sorted keys text x terms + term of the different terms in each text, or list of words."""
        # Words are forgotten between parts only, so that the numbers of one part stay valid.
        if len(self.number) > REMEMBERED:
            self._forget()
        kind = np.uint32 if len(texts) * terms < 1 << 32 else np.uint64
        lists = texts if pa.types.is_list(texts.type) else pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten().dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = list(map(self.number.get, known))
        if new := [word for word, n in zip(known, number, strict=True) if n is None]:
            fresh = iter(range(len(self.number), len(self.number) + len(new)))
            self._learn(new)
            number = [next(fresh) if n is None else n for n in number]
        number = np.array(number, np.int64)
        row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        pair = _different(row * max(len(known), 1) + words.indices.to_numpy(zero_copy_only=False))
        row, word = np.divmod(pair, max(len(known), 1))
        first = self.ptr[number[word]]
        size = self.ptr[number[word] + 1] - first
        return _different(np.repeat((row * terms).astype(kind), size) + self.flat[_spread(first, size)].astype(kind))


def _sizes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text or list of words; a list that is missing has none."""
    if not pa.types.is_list(texts.type):
        return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    edges = np.r_[0, np.cumsum(pc.binary_length(texts.flatten()).to_numpy(zero_copy_only=False), dtype=np.int64)]
    size = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    return edges[ends] - edges[ends - size]


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most 512 rows and at most ``PART_BYTES`` bytes, but one row at least."""
    for whole in batches:
        size = np.cumsum(_sizes(whole.column("snippet_lower")).astype(np.int64))
        start = 0
        while start < whole.num_rows:
            before = size[start - 1] if start else 0
            end = max(int(np.searchsorted(size, before + PART_BYTES, "right")), start + 1)
            end = min(end, start + 512)
            yield whole.slice(start, end - start)
            start = end


def found_rows(batches: Iterable[pa.RecordBatch], words: Words, terms: int) -> Iterator[Block]:
    """Blocks of rows of (id, seq, snippet_lower, label_lower), as texts or lists of words. A missing ``seq`` comes before all others."""
    seqs, ids, strong, weak = [], [], [], []
    terms = max(terms, 1)
    for part in _parts(batches):
        seqs += pc.fill_null(part.column("seq"), int(FIRST)).to_pylist()
        ids += part.column("id").to_pylist()
        own = words.of_texts(part.column("snippet_lower"), terms).astype(np.int64)
        labels = part.column("label_lower")
        if pa.types.is_list(labels.type):
            labels = pc.binary_join(labels, " ")
        labels = pc.fill_null(labels, "").dictionary_encode()
        named = words.of_texts(labels.dictionary, terms).astype(np.int64)
        edges = np.searchsorted(named, np.arange(len(labels.dictionary) + 1) * terms)
        at = labels.indices.to_numpy(zero_copy_only=False)
        size = np.diff(edges)[at]
        named = np.repeat(np.arange(len(at)), size) * terms + named[_spread(edges[at], size)] % terms
        if len(own):
            named = named[own[np.minimum(np.searchsorted(own, named), len(own) - 1)] != named]
        for keys, rows in ((own, strong), (named, weak)):
            cuts = np.searchsorted(keys, np.arange(1, part.num_rows) * terms)
            rows += np.split((keys % terms).astype(np.int32), cuts)
        if len(seqs) >= BLOCK:
            yield Block(np.array(seqs, np.int64), np.array(ids, object), strong, weak)
            seqs, ids, strong, weak = [], [], [], []
    if seqs:
        yield Block(np.array(seqs, np.int64), np.array(ids, object), strong, weak)


def _bitmaps(rows: list[np.ndarray], terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows per term, its line in the bitmaps (0, an empty one, if no row holds it), and the bitmaps."""
    words = -(-len(rows) // 64)
    tid = np.concatenate(rows)
    count = np.bincount(tid, minlength=terms)
    present = np.flatnonzero(count)
    line = np.zeros(terms, np.int32)
    line[present] = np.arange(1, len(present) + 1)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    key = np.sort(line[tid].astype(np.int64) * (words * 64) + at)
    word, bit = key >> 6, np.uint64(1) << (key & 63).astype(np.uint64)
    bits = np.zeros((len(present) + 1) * words, np.uint64)
    if len(key):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        bits[word[starts]] = np.bitwise_or.reduceat(bit, starts)
    return count, line, bits.reshape(-1, words)


def _lines(lines: np.ndarray, ptr: np.ndarray, slots: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first ``size`` lines of each slot, filled up with the empty one."""
    width = np.arange(max(int(size.max(initial=0)), 1))
    at = np.minimum(ptr[slots][:, None] + width, max(len(lines) - 1, 0))
    return np.where(width < size[:, None], lines[at] if len(lines) else 0, 0)


def _bit(octets: np.ndarray, line: np.ndarray, row: np.ndarray) -> np.ndarray:
    return (octets[line, row >> 3] >> (row & 7).astype(np.uint8)) & np.uint8(1)


@dataclass
class _Lines:
    """Bitmaps, and the lines of them that each request has: those of slot n are ``lines[ptr[n]:ptr[n + 1]]``."""

    ptr: np.ndarray
    lines: np.ndarray
    bits: np.ndarray

    def of(self, slots: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
        """The first ``size`` lines of each slot (all, if not given), filled up with the empty one."""
        return _lines(self.lines, self.ptr, slots, self.ptr[slots + 1] - self.ptr[slots] if size is None else size)


def _counted(words: Iterable[np.ndarray]) -> list[np.ndarray]:
    """How many of the bitmaps have each bit, as binary digits: bit i of plane n is digit n of the count of bit i."""
    planes: list[np.ndarray] = []
    for carry in words:
        for n, plane in enumerate(planes):
            planes[n], carry = plane ^ carry, plane & carry
        if carry.any():
            planes.append(carry)
    return planes


def _at_least(planes: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """Bitmaps of the counts of ``_counted`` that reach ``least`` (per bitmap)."""
    zero, ones = np.uint64(0), ~np.uint64(0)
    above, equal = np.zeros(len(least), np.uint64), np.full(len(least), ones)
    for n in range(len(planes) - 1, -1, -1):
        digit = np.where((least >> n) & 1 > 0, ones, zero)
        above |= equal & planes[n] & ~digit
        equal &= ~(planes[n] ^ digit)
    reached = np.where(least >> len(planes) > 0, zero, above | equal)
    return np.where(least <= 0, ones, reached)


class Best:
    """The k best rows (score descending, ``seq`` ascending) of every request among the blocks added."""

    def __init__(self, asked: Requests, k: int) -> None:
        self.asked, self.k = asked, k
        self.ptr, self.tid = asked.ptr, asked.tid
        self.size = np.diff(asked.ptr)
        self.slot_of = np.repeat(np.arange(len(asked.ids)), self.size)
        self.floor, self.floor_seq = asked.floor.copy(), asked.floor_seq.copy()
        self.ordered = False
        self.kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)]
        self.pending: list[list[np.ndarray]] = []
        self.waiting = 0
        #: Pairs of requests and terms' rows in the blocks, pairs of requests and rows met, and those that reached a floor.
        self.every = self.taken = self.completed = 0

    def _held(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lines of each request's terms that some row of a block holds: where each request's begin, and the lines."""
        lines = line[self.tid]
        there = lines > 0
        return np.r_[0, np.cumsum(there)][self.ptr], lines[there]

    def add(self, block: Block) -> None:
        # Rows with many terms side by side, so that candidates share words of the bitmaps.
        order = np.argsort([-len(r) for r in block.strong], kind="stable")
        seq, ids = block.seq[order], block.ids[order]
        terms = len(self.asked.terms)
        count, line, bits = _bitmaps([block.strong[n] for n in order], terms)
        _, weak_line, weak_bits = _bitmaps([block.weak[n] for n in order], terms)
        if not self.ordered:
            # Rarest first; any order that is kept is right.
            self.tid = self.tid[np.lexsort((count[self.tid], self.slot_of))]
            self.ordered = True
        self.every += int(count[self.tid].sum())
        strong = _Lines(*self._held(line), bits)
        named = _Lines(*self._held(weak_line), weak_bits)
        held, weak = np.diff(strong.ptr), np.diff(named.ptr)
        least = self.floor + (seq.min() > self.floor_seq)
        need = -(-(least - HAYSTACK_POINTS * weak) // SNIPPET_POINTS)
        live = np.flatnonzero((need <= held) & (held + weak > 0))
        chosen = np.where(need >= SIFT, held - need + SIFT, held)
        live = live[np.argsort(chosen[live], kind="stable")]
        for start in range(0, len(live), CHUNK):
            part = live[start : start + CHUNK]
            mask = self._candidates(part, chosen[part], need[part], strong, named)
            self._score(part, need[part], least, mask, strong, named, seq, ids)
        if self.waiting > max(PENDING, len(self.kept[0])):
            self._rank()

    def _candidates(self, part, chosen, need, strong, named) -> np.ndarray:
        """Bitmaps of the rows that may reach the floors of the slots ``part``."""
        own = strong.of(part, chosen).T.copy()
        some = [np.zeros((len(part), strong.bits.shape[1]), np.uint64) for _ in range(SIFT)]
        more, both = np.empty_like(some[0]), np.empty_like(some[0])
        for n in range(len(own)):
            np.take(strong.bits, own[n], axis=0, out=more, mode="clip")
            for high in range(min(SIFT - 1, n), 0, -1):
                np.bitwise_and(some[high - 1], more, out=both)
                some[high] |= both
            some[0] |= more
        mask = some[0]
        for high in range(1, SIFT):
            mask = np.where((need > high)[:, None], some[high], mask)
        open_ = np.flatnonzero(need <= 0)
        if len(open_):
            own = named.of(part[open_])
            for n in range(own.shape[1]):
                mask[open_] |= named.bits[own[:, n]]
        return mask

    def _score(self, part, need, least, mask, strong, named, seq, ids) -> None:
        q, word = np.nonzero(mask)
        if not len(q):
            return
        open_ = mask[q, word]
        self.taken += int(np.bitwise_count(open_).sum())
        own = strong.of(part)
        planes = _counted([strong.bits[own[q, n], word] for n in range(own.shape[1])])
        open_ &= _at_least(planes, need[q])
        pair, bit = np.nonzero(np.unpackbits(open_.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        if not len(pair):
            return
        points = np.zeros(len(pair), np.int32)
        for n, plane in enumerate(planes):
            points += ((plane[pair] >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.int32) << n
        points *= SNIPPET_POINTS
        q, row = q[pair], word[pair] * 64 + bit
        own = named.of(part)
        at = np.flatnonzero((own > 0).any(axis=1)[q])
        if len(at):
            octets = named.bits.view(np.uint8)
            for n in range(own.shape[1]):
                points[at] += HAYSTACK_POINTS * _bit(octets, own[q[at], n], row[at])
        slot = part[q]
        floor = self.floor[slot]
        stay = (points >= least[slot]) & ((points > floor) | (seq[row] <= self.floor_seq[slot]))
        self.pending.append([slot[stay], points[stay].astype(np.int64), seq[row[stay]], ids[row[stay]]])
        self.waiting += int(np.count_nonzero(stay))
        self.completed += int(np.count_nonzero(stay))
        if self.waiting > max(PENDING, len(self.kept[0])):
            self._rank()

    def _rank(self) -> None:
        slot, points, seq, ids = (np.concatenate(c) for c in zip(self.kept, *self.pending, strict=True))
        order = np.lexsort((seq, -points, slot))
        own = slot[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        place = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
        order = order[place < self.k]
        self.kept = [c[order] for c in (slot, points, seq, ids)]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.floor[self.kept[0][last]] = self.kept[1][last]
        self.floor_seq[self.kept[0][last]] = self.kept[2][last]
        self.pending, self.waiting = [], 0

    def batches(self, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """query_id, score, seq and id of what is kept."""
        if self.pending:
            self._rank()
        slot, points, seq, ids = self.kept
        for start in range(0, max(len(slot), 1), 1 << 16):
            part = slice(start, start + (1 << 16))
            own = [self.asked.ids[n] for n in slot[part].tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own, type=id_type),
                    pa.array(points[part].astype(np.float64)),
                    pa.array(seq[part]),
                    pa.array(ids[part].tolist(), type=pa.string()),
                ],
                names=["query_id", "score", "seq", "id"],
            )


def floors(asked: Requests, rows: Block, k: int, slots: range) -> tuple[np.ndarray, np.ndarray]:
    """Score and ``seq`` of the k-th best of a few rows, for each of the slots; (1, LAST) where fewer have a term."""
    floor, floor_seq = np.ones(len(slots), np.int32), np.full(len(slots), LAST, np.int64)
    n = len(rows.seq)
    if n < k:
        return floor, floor_seq
    order = np.argsort(rows.seq, kind="stable")
    terms = len(asked.terms)
    _, line, bits = _bitmaps([rows.strong[i] for i in order], terms)
    _, weak_line, weak_bits = _bitmaps([rows.weak[i] for i in order], terms)
    lines, weak_lines = line[asked.tid], weak_line[asked.tid]
    size = np.diff(asked.ptr)

    def held(bits: np.ndarray, own: np.ndarray) -> np.ndarray:
        total = np.zeros((len(own), n), np.uint8 if own.shape[1] < 256 else np.uint32)
        for i in range(own.shape[1]):
            total += np.unpackbits(bits[own[:, i]].view(np.uint8), axis=1, count=n, bitorder="little")
        return total.astype(np.int64)

    for start in range(0, len(slots), CHUNK):
        part = np.arange(slots.start + start, min(slots.start + start + CHUNK, slots.stop))
        points = SNIPPET_POINTS * held(bits, _lines(lines, asked.ptr, part, size[part]))
        own = -np.sort(-_lines(weak_lines, asked.ptr, part, size[part]), axis=1)
        points += HAYSTACK_POINTS * held(weak_bits, own[:, : max(int((own > 0).sum(axis=1).max()), 1)])
        ranked = np.partition(points * n + np.arange(n - 1, -1, -1), n - k, axis=1)[:, n - k]
        real = ranked >= n
        at = start + np.flatnonzero(real)
        floor[at] = ranked[real] // n
        floor_seq[at] = rows.seq[order][n - 1 - ranked[real] % n]
    return floor, floor_seq
