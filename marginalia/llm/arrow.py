"""Helpers shared by the operators: bounded Arrow slices, word codes, and tables in the shared folder."""

from __future__ import annotations

import ctypes
import ctypes.util
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from marginalia.session import shared_dir

#: The white space of the operators' contracts: space and the controls 9 to 13.
WHITE = " \t\n\x0b\x0c\r"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back, which cuts the lineage for good."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


_LIBC = ctypes.CDLL(ctypes.util.find_library("c") or None)


def release() -> None:
    """Hand freed memory back to the system; Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of at most ``limit`` bytes of text each, or of one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
            release()


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: a code per word, the bounds of each text, and the vocabulary.

    A null text has no words. The vocabulary may hold an empty string that no code refers to.
    """
    parts = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    bounds = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:
        kept = codes != empty
        bounds = np.concatenate(([0], np.cumsum(kept)))[bounds]
        codes = codes[kept]
    return codes, bounds - bounds[0], coded.dictionary


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin[i] to begin[i] + size[i], one range after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class TokenMemory:
    """Token ids of strings, computed once and kept for up to ``limit`` strings.

    ``learn`` gets strings and returns arrays of ids, which joined are all their ids, and the number of
    ids of each string. Forgetting changes no result, only the time.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[list[np.ndarray], list[int] | np.ndarray]], limit: int):
        self.learn, self.limit = learn, limit
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.begin, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def tokens(self, codes: np.ndarray, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings[codes] one after another, and where each code's ids begin (with the end)."""
        missing = [x for x in strings if x not in self.known]
        if len(self.known) + len(missing) > self.limit:
            self._forget()
            missing = strings
        own, size = self.learn(missing)
        self.known.update(zip(missing, range(len(self.known), len(self.known) + len(missing)), strict=True))
        self.pool = np.concatenate([self.pool, *own]).astype(np.uint32)
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(np.asarray(size, np.int64))))
        index = np.fromiter(map(self.known.__getitem__, strings), np.int64, len(strings))
        begin, size = self.begin[index], self.begin[index + 1] - self.begin[index]
        return self.pool[ranges(begin[codes], size[codes])], np.concatenate(([0], np.cumsum(size[codes])))
