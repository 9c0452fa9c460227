"""Exact top-k search by inner product through distributed histogram selection.

Vectors become integers floor(256 x). Vectors and queries are packed into binary chunks and blocks; every
tile (a query block and a few chunks) scores all its pairs with one matrix product. For each query the
k-th highest score is located by refinement: every level cuts the query's interval of scores into
``BINS`` bins, tiles count scores per bin, Spark adds the counts up, and the bin that holds the k-th value
is the next interval, until it is one integer wide. A last pass keeps what exceeds that value, and of the
ties the smallest ids. A tile reports no bin below the one of its own k-th score, which cannot hold the
global k-th value, and no more than k ties; so what leaves a tile is bounded by k per query.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows
without an id; vectors of different length are not compared; a query is compared with every row but
those of its own id; repeated rows are rows; fewer than k candidates are all returned; scores beyond
2^61 count as 2^61 (no overflow); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.arrow import stored

BINS = 4096
SCALE = 256
#: Vectors in a chunk, queries in a block, chunks in a tile.
CHUNK, BLOCK, TILE = 2048, 1024, 4
_LIMIT = 2**61
_PACKED = "number long, width int, ids binary, cells binary, most double"


def _packer(rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            lists = batch["vector"]
            size = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate(([0], np.cumsum(size)))
            ids = batch["vec_id"].to_numpy()
            with np.errstate(over="ignore", invalid="ignore"):
                cells = np.floor(values * SCALE)
            for width in np.unique(size):
                own = np.flatnonzero(size == width)
                for first in range(0, len(own), rows):
                    chosen = own[first : first + rows]
                    block = cells[at[chosen][:, None] + np.arange(width)] if width else np.zeros((len(chosen), 0))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "number": [part << 32 | made],
                            "width": pa.array([int(width)], pa.int32()),
                            "ids": [ids[chosen].astype("<i8").tobytes()],
                            "cells": [block.astype("<f8").tobytes()],
                            "most": [float(np.abs(block).max(initial=0.0))],
                        }
                    )
                    made += 1

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector: array of double) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite)


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    bound = queries.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0))
    if bound < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(queries) @ whole(vectors).T, -_LIMIT, _LIMIT).astype(np.int64)


def _tiles(blocks: pd.DataFrame, chunks: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk: scores, which pairs count, the candidates' ids, the queries' positions."""
    for b in blocks.itertuples():
        own = np.frombuffer(b.ids, "<i8")
        queries = np.frombuffer(b.cells, "<f8").reshape(len(own), -1)
        for c in chunks.itertuples():
            ids = np.frombuffer(c.ids, "<i8")
            vectors = np.frombuffer(c.cells, "<f8").reshape(len(ids), -1)
            if vectors.shape[1] == queries.shape[1]:
                yield _scores(queries, vectors), own[:, None] != ids[None, :], ids, own


def _count(k: int, width: int, inner: int):
    """Counts per bin of ``inner`` scores inside each query's interval of ``width`` scores."""

    def run(blocks: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for scores, counts, _, _ in _tiles(blocks, chunks):
            low = np.frombuffer(blocks["low"].iloc[0], "<i8")[:, None]
            counts &= (scores >= low) & (scores - low < width)
            bins = np.where(counts, (scores - low) // inner, -1)
            least = np.partition(bins, -k, axis=1)[:, -k] if bins.shape[1] > k else np.full(len(bins), 0)
            row, column = np.nonzero(counts & (bins >= least[:, None]))
            keys, n = np.unique(row * (BINS + 1) + bins[row, column], return_counts=True)
            out.append(pd.DataFrame({"at": keys // (BINS + 1), "bin": keys % (BINS + 1), "n": n}))
        made = pd.concat(out) if out else pd.DataFrame({"at": [], "bin": [], "n": []})
        made = made.groupby(["at", "bin"], as_index=False)["n"].sum().astype("int64")
        return made.assign(block=blocks["block"].iloc[0] if len(blocks) else 0)[["block", "at", "bin", "n"]]

    return run


def _take(k: int):
    def run(blocks: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for scores, counts, ids, own in _tiles(blocks, chunks):
            low = np.frombuffer(blocks["low"].iloc[0], "<i8")[:, None]
            row, column = np.nonzero(counts & (scores >= low))
            out.append(pd.DataFrame({"at": row, "query_id": own[row], "vec_id": ids[column], "score": scores[row, column]}))
        made = pd.concat(out) if out else pd.DataFrame({"at": [], "query_id": [], "vec_id": [], "score": []})
        made = made.sort_values(["at", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        made = made.groupby("at").head(k).astype("int64")
        return made.assign(block=blocks["block"].iloc[0] if len(blocks) else 0)[["block", "at", "query_id", "vec_id", "score"]]

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest scores, ties to the smaller id."""
    chunks = stored(usable(vectors).mapInArrow(_packer(CHUNK), _PACKED), "chunks")
    largest = chunks.agg(F.max("most")).first()[0] or 0.0
    rows = usable(queries)
    n = max(1, -(-rows.count() // BLOCK))
    blocks = stored(rows.repartition(n, "vec_id").mapInArrow(_packer(BLOCK), _PACKED), "blocks")
    # Numbers in sequence for tiles: one narrow row per chunk and block.
    order = Window.orderBy("number")
    groups = max(1, -(-chunks.count() // TILE))
    chunks = chunks.join(
        chunks.select("number", ((F.row_number().over(order) - 1) % groups).alias("tile")), "number"
    ).drop("most")
    named = blocks.select("number", (F.row_number().over(order) - 1).alias("block"))
    blocks = stored(blocks.join(named, "number").drop("number"), "named-blocks")
    chunks = stored(chunks.drop("number"), "tiled-chunks")
    total = blocks.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = blocks.agg(F.max("most"), F.max("width")).first()
    bound = min(_LIMIT, int(size[1]) * int(size[0]) * int(largest))
    tiles = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(total - 1)))).groupBy("block", "tile")
    spread = blocks.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def against(state: DataFrame, run, schema: str) -> DataFrame:
        return spread.join(state, "block").groupBy("block", "tile").cogroup(tiles).applyInPandas(run, schema)

    width = 2 * bound + 1
    base = blocks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), (F.octet_length("ids") / 8).cast("long") - 1)).alias("at"))
    base = base.select("block", "at", F.lit(-bound).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))
    while width > 1:
        inner = -(-width // BINS)
        counted = against(_state(base), _count(k, width, inner), "block long, at long, bin long, n long")
        counted = counted.groupBy("block", "at", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("block", "at").orderBy(F.desc("bin"))
        counted = counted.withColumn("above", F.sum("n").over(above) - F.col("n")).join(base.select("block", "at", "need"), ["block", "at"])
        # The lowest bin that is reached with fewer than ``need`` scores above it holds the k-th value.
        found = counted.filter(F.col("above") < F.col("need")).groupBy("block", "at")
        found = found.agg(F.min_by(F.struct("bin", "above"), "bin").alias("b"))
        base = base.join(found, ["block", "at"], "left").select(
            "block",
            "at",
            (F.col("low") + F.coalesce("b.bin", F.lit(0)) * F.lit(inner)).alias("low"),
            (F.col("need") - F.coalesce("b.above", F.lit(0))).alias("need"),
        )
        base = stored(base, "intervals")
        width = inner
    best = against(_state(base), _take(k), "block long, at long, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _state(base: DataFrame) -> DataFrame:
    """Per block the lower ends of its queries' intervals as one binary column."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        low = rows.sort_values("at")["low"].to_numpy(np.int64)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "low": [low.astype("<i8").tobytes()]})

    return base.select("block", "at", "low").groupBy("block").applyInPandas(run, "block long, low binary")
