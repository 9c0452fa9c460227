"""Bounded top-k: a per-task partial pass for whole query batches, and the final ranking.

A batch of queries is scored against each Arrow batch of rows with one matrix product. Every task
keeps only the k best rows per query, so what is shuffled is bounded by tasks x queries x k however
large, or however skewed, the corpus is; no pair of query and row is ever materialised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows scored at once; bounds the score matrix to BLOCK x queries.
BLOCK = 512

#: Types a query id may have; anything else is to be cast to string by the caller.
ID_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}

#: Builds, once per task, a function from an Arrow batch to a (queries x rows) score matrix.
ScorerFactory = Callable[[], Callable[[pa.RecordBatch], np.ndarray]]


class _Best:
    """The k best (score desc, seq asc) rows per query seen so far by one task."""

    def __init__(self, queries: int, k: int, digits: int | None = None) -> None:
        self.k, self.digits = k, digits
        self.score = np.full((queries, k), -np.inf)
        self.seq = np.full((queries, k), np.iinfo(np.int64).max, dtype=np.int64)
        self.id = np.full((queries, k), None, dtype=object)

    def add(self, score: np.ndarray, seq: np.ndarray, ids: np.ndarray, floor: float) -> None:
        # Most queries gain nothing from a block, which one comparison shows; rounding adds half of the last digit at most.
        slack = 0.0 if self.digits is None else 10.0**-self.digits
        hit = score >= np.maximum(self.score[:, -1:], floor) - slack
        hits = np.count_nonzero(hit)
        if not hits:
            return
        if hits < score.size // 8:
            self._merge(score, *np.nonzero(hit), seq, ids, floor)
            return
        live = np.flatnonzero(hit.any(axis=1))
        order = np.argsort(seq, kind="stable")
        score, seq, ids = score[live][:, order], seq[order], ids[order]
        if self.digits is not None:
            score = np.round(score, self.digits)
        worst, worst_seq = self.score[live, -1:], self.seq[live, -1:]
        better = (score >= floor) & ((score > worst) | ((score == worst) & (seq[None, :] < worst_seq)))
        some = better.any(axis=1)
        live, score, better = live[some], score[some], better[some]
        if live.size == 0:
            return
        score = np.where(better, score, -np.inf)
        k = min(self.k, score.shape[1])
        cut = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        above = score > cut
        # Ties on the cut value are filled in seq order, which is the column order here.
        tied = score == cut
        room = k - above.sum(axis=1, keepdims=True)
        keep = above | (tied & (np.cumsum(tied, axis=1) <= room))
        picked = np.nonzero(keep)[1].reshape(live.size, k)
        score = np.concatenate([self.score[live], np.take_along_axis(score, picked, axis=1)], axis=1)
        new_seq = np.concatenate([self.seq[live], seq[picked]], axis=1)
        new_id = np.concatenate([self.id[live], ids[picked]], axis=1)
        rank = np.lexsort((new_seq, -score), axis=1)[:, : self.k]
        self.score[live] = np.take_along_axis(score, rank, axis=1)
        self.seq[live] = np.take_along_axis(new_seq, rank, axis=1)
        self.id[live] = np.take_along_axis(new_id, rank, axis=1)

    def _merge(self, score: np.ndarray, query: np.ndarray, at: np.ndarray, seq: np.ndarray, ids: np.ndarray, floor: float) -> None:
        """``add`` for the few scores of (query, at), in order of the queries."""
        found, place = score[query, at], seq[at]
        if self.digits is not None:
            found = np.round(found, self.digits)
        worst, worst_seq = self.score[query, -1], self.seq[query, -1]
        stay = (found >= floor) & ((found > worst) | ((found == worst) & (place < worst_seq)))
        query, at, found, place = query[stay], at[stay], found[stay], place[stay]
        if not len(query):
            return
        live, own = np.unique(query, return_inverse=True)
        own = np.concatenate([np.repeat(np.arange(live.size), self.k), own])
        found = np.concatenate([self.score[live].ravel(), found])
        place = np.concatenate([self.seq[live].ravel(), place])
        names = np.concatenate([self.id[live].ravel(), ids[at]])
        order = np.lexsort((place, -found, own))
        # Every query has at least the k entries that it had.
        first = np.searchsorted(own[order], np.arange(live.size))
        order = order[first[:, None] + np.arange(self.k)]
        self.score[live], self.seq[live], self.id[live] = found[order], place[order], names[order]

    def batch(self, query_ids: list, id_type: pa.DataType) -> pa.RecordBatch:
        query, slot = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([query_ids[q] for q in query.tolist()], type=id_type),
                pa.array(self.score[query, slot]),
                pa.array(self.seq[query, slot]),
                pa.array(self.id[query, slot].tolist(), type=pa.string()),
            ],
            names=["query_id", "score", "seq", "id"],
        )


def best_per_task(
    rows: DataFrame, factory: ScorerFactory, query_ids: list, k: int, floor: float, id_type: str = "string", digits: int | None = None
) -> DataFrame:
    """Partial top-k of every task: query_id, score, seq, id.

    ``rows`` needs ``id`` and ``seq`` beside what the scorer reads; row n of a score matrix belongs
    to ``query_ids[n]``. Scores are rounded to ``digits``, if given; rows scoring below ``floor`` are dropped.
    """
    arrow_type = ID_TYPES[id_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = factory()
        best = _Best(len(query_ids), k, digits)
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                part = whole.slice(start, BLOCK)
                seq = part.column("seq").to_numpy(zero_copy_only=False)
                ids = np.asarray(part.column("id").to_pylist(), dtype=object)
                best.add(score_of(part), seq, ids, floor)
        yield best.batch(query_ids, arrow_type)

    return rows.mapInArrow(run, f"query_id {id_type}, score double, seq bigint, id string")


def top_k_per(rows: DataFrame, key: str | list[str], order: list[Column], k: int, into: str = "rank") -> DataFrame:
    """Rows ranked 1..k per key.

    A rank filter on a window lets Spark trim each map task to k rows per key before the shuffle,
    so a key that owns a large part of the table still reaches the reducer as k rows per task.
    """
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn(into, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(into) <= k)
