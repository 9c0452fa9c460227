"""Cell index over stored vectors: exact cosine top-k that scores only the vectors which can be hits.

``build_cells`` puts every vector into the cell of the nearest of ``cells`` k-means centres and writes, below a folder,

* ``members``: cell, block, angle to the centre, id, seq, document_id and the unit vector, sorted by cell and angle;
  a block is a run of at most ``BLOCK`` members of one cell, so a cell with a third of all rows is many blocks,
* ``blocks``: cell, block, their number of members, the smallest and the largest angle,
* ``centres``: cell, unit vector, and the same figures of the whole cell.

Angles on the sphere obey the triangle inequality: no member of a block whose angles lie in [low, high] is nearer to a
query at angle t from the centre than max(0, t - high, low - t). A search scores the most promising blocks of each
query first, takes the k-th score found there as the query's limit, and then scores all blocks whose bound reaches that
limit. Results equal ``vector_search_batch`` on the same vectors: nothing is approximated, the centres decide the work only.

Requests are a table like any other. They meet the centres in the tasks (at most ``cells`` rows, a parameter), blocks by an
equi-join on narrow rows, and vectors by a shuffle on stretches of 2 ** ``STRETCH_BITS`` blocks: a query's vector is sent
once per stretch with the list of its blocks there, and a task holds one stretch at a time.

Defined cases: null vectors and those with a null or NaN component take no part, as rows or as queries; a zero vector has
a cell of its own (``ZERO``) and score 0 with everything; vectors of different length raise; query ids are unique; an
empty table gives an empty index and no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.config import DEFAULTS
from marginalia.operators.keyword import in_scope
from marginalia.operators.topk import top_k_per
from marginalia.operators.vector import SCORE_DIGITS

CELLS = 64
#: Vectors per cell that the centres are fitted on: those with the smallest hashes of their ids.
FITTED = 64
#: A block holds at most 2 ** BLOCK_BITS members.
BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS
#: Blocks that are dealt together, as a power of two, and the tasks that share the queries of such a stretch.
STRETCH_BITS = 5
SHARES = 4
#: Blocks of a query whose scores set its limit.
SEEDS = 2
#: The cell of zero vectors.
ZERO = -1
#: Queries scored at once against a block.
QUERIES = 256
#: Added to bounds, since the arc cosine near 1 is good to eight digits only.
SLACK = 1e-6

CENTRES = "cell int, centre array<double>, n bigint, low double, high double"
BLOCKS = "cell int, block bigint, n bigint, low double, high double"
MEMBERS = "cell int, block bigint, angle double, id string, seq bigint, document_id string, unit array<double>"


def _usable(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))


def _units(column: pa.Array, width: int | None) -> np.ndarray:
    """The vectors of a list column at length one; zero vectors stay zero."""
    lengths = np.diff(column.offsets.to_numpy())
    if width is None:
        width = int(lengths[0]) if lengths.size else 0
    if (lengths != width).any():
        raise ValueError(f"every embedding must have dimension {width}")
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), np.finfo(np.float64).tiny)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def _fit(vectors: DataFrame, cells: int) -> np.ndarray:
    """At most ``cells`` unit centres, from at most ``cells * FITTED`` vectors."""
    sample = vectors.filter(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(cells * FITTED)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x))
    sample = sample.select("embedding", norm.alias("norm"))
    sample = sample.select(array_to_vector(F.transform("embedding", lambda x: x / F.col("norm"))).alias("features")).cache()
    first = sample.first()
    if first is None:
        return np.zeros((0, 0))
    found = np.asarray(KMeans(k=max(cells, 2), maxIter=8, seed=7).fit(sample).clusterCenters())
    sample.unpersist()
    norms = np.linalg.norm(found, axis=1)
    found = found[norms > 1e-9] / norms[norms > 1e-9, None]
    return found if len(found) else np.asarray([first[0].toArray()])


def build_cells(vectors: DataFrame, root: str, cells: int = CELLS) -> None:
    """Write the index of ``vectors`` (id, seq, embedding, document_id) below ``root``; writing it again replaces it.

    The centres are written last, and a search reads them first: a build that was cut off is no index.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors).select("id", "seq", "document_id", F.col("embedding").cast("array<double>").alias("embedding"))
    centres = _fit(rows, cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = centres.shape[1] or None
        for batch in batches:
            units = _units(batch["embedding"], width)
            width = units.shape[1]
            zero = ~units.any(axis=1)
            cell, angle = np.full(len(units), ZERO), np.zeros(len(units))
            if len(centres) and len(units):
                angles = _angles(units, centres)
                cell = np.where(zero, ZERO, angles.argmin(axis=1))
                angle = np.where(zero, 0.0, angles.min(axis=1))
            kept = [batch["id"], batch["seq"], batch["document_id"]]
            made = [pa.array(cell.astype(np.int32)), pa.array(angle), *kept, _lists(units)]
            yield pa.RecordBatch.from_arrays(made, ["cell", "angle", "id", "seq", "document_id", "unit"])

    placed = rows.mapInArrow(place, "cell int, angle double, id string, seq bigint, document_id string, unit array<double>")
    ordered = placed.repartitionByRange("cell", "angle", "seq", "id").sortWithinPartitions("cell", "angle", "seq", "id")
    # Row numbers inside a partition start at a multiple of BLOCK, so that no block spans two partitions.
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block")
    names = [part.split()[0] for part in MEMBERS.split(", ")]
    ordered.select("*", block).select(*names).write.mode("overwrite").parquet(f"{root}/members")
    figures = F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")
    members = spark.read.schema(MEMBERS).parquet(f"{root}/members")
    members.groupBy("cell", "block").agg(*figures).write.mode("overwrite").parquet(f"{root}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{root}/blocks")
    whole = blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    named = spark.createDataFrame([(n, c.tolist()) for n, c in enumerate(centres)], "cell int, centre array<double>")
    whole.join(F.broadcast(named), "cell", "left").select("cell", "centre", "n", "low", "high").write.mode("overwrite").parquet(
        f"{root}/centres"
    )


def _met(queries: DataFrame, cells: list, limit: int, first: bool) -> DataFrame:
    """(query_id, ask, least, cell, angle): the cells of each query, whose angle is null where a side is a zero vector.

    At first these are the nearest cells which hold ``limit`` members, then all whose bound reaches ``least``.
    """
    kept = [c for c in cells if c["centre"] is not None]
    centres = np.asarray([c["centre"] for c in kept])
    numbers = np.asarray([c["cell"] for c in kept] + [c["cell"] for c in cells if c["centre"] is None], dtype=np.int32)
    sizes = np.asarray([c["n"] for c in kept] + [c["n"] for c in cells if c["centre"] is None])
    low, high = (np.asarray([c[name] for c in kept]) for name in ("low", "high"))
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(numbers):
                continue
            units = _units(batch["embedding"], centres.shape[1] if len(kept) else None)
            least = batch["least"].to_numpy()
            angles = np.full((len(units), len(numbers)), np.nan)
            bounds = np.zeros(angles.shape)
            if len(kept):
                angles[:, : len(kept)] = _angles(units, centres)
                gap = np.maximum(angles[:, : len(kept)] - high, low - angles[:, : len(kept)])
                bounds[:, : len(kept)] = np.cos(np.maximum(gap, 0.0))
            zero = ~units.any(axis=1)
            angles[zero], bounds[zero] = np.nan, 0.0
            wanted = bounds + SLACK >= least[:, None]
            if first:
                order = np.argsort(np.nan_to_num(angles, nan=np.pi / 2), axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                near = np.zeros(angles.shape, dtype=bool)
                np.put_along_axis(near, order, before < limit, axis=1)
                wanted &= near
            row, column = np.nonzero(wanted)
            angle = angles[row, column]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["query_id"].take(pa.array(row)),
                    batch["ask"].take(pa.array(row)),
                    pa.array(least[row]),
                    pa.array(numbers[column]),
                    pa.array(angle, mask=np.isnan(angle)),
                ],
                ["query_id", "ask", "least", "cell", "angle"],
            )

    return queries.mapInArrow(run, f"query_id {kind}, ask bigint, least double, cell int, angle double")


def _asked(queries: DataFrame) -> DataFrame:
    """The usable queries (query_id, ask, embedding); ``ask`` tells queries that share an id, or have none, apart."""
    asked = _usable(queries.select("query_id", "embedding"))
    asked = asked.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return asked.select("query_id", F.xxhash64("query_id", "embedding").alias("ask"), "embedding")


def _with_units(queries: DataFrame) -> DataFrame:
    """The different queries (query_id, ask, unit)."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch["query_id"], batch["ask"], _lists(_units(batch["embedding"], None))], ["query_id", "ask", "unit"])

    return queries.dropDuplicates(["query_id", "ask"]).mapInArrow(run, f"query_id {kind}, ask bigint, unit array<double>")


def _bound() -> Column:
    """The highest score a block can hold for a query."""
    gap = F.greatest(F.col("angle") - F.col("high"), F.col("low") - F.col("angle"), F.lit(0.0))
    return F.when(F.col("angle").isNull(), 0.0).otherwise(F.cos(gap)) + SLACK


def _scored(pairs: DataFrame, queries: DataFrame, members: DataFrame, limit: int) -> DataFrame:
    """(query_id, score, seq, id): of every pair (query_id, ask, least, cell, block) the best members that reach ``least``.

    Members and ``queries`` (query_id, ask, unit) are dealt by stretch and sorted, members first: a task holds one stretch and a
    slice of a share of its queries.
    """
    kind = pairs.schema["query_id"].dataType.simpleString()
    stretch = F.shiftright("block", STRETCH_BITS).alias("stretch")
    needed = members.join(pairs.select("cell", "block").distinct(), ["cell", "block"], "left_semi")
    shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    needed = needed.select(stretch, shares, F.lit(0).alias("side"), "cell", "block", "seq", "id", "unit")
    lists = pairs.groupBy("query_id", "ask", "least", stretch).agg(F.collect_list(F.struct("cell", "block")).alias("blocks"))
    share = F.pmod(F.xxhash64("query_id"), F.lit(SHARES)).cast("int").alias("share")
    units = queries.withColumnRenamed("query_id", "own_id")
    lists = lists.join(units, "ask").filter(F.col("query_id").eqNullSafe(F.col("own_id"))).select("stretch", share, F.lit(1).alias("side"), "query_id", "least", "unit", "blocks")
    rows = needed.unionByName(lists, allowMissingColumns=True)

    def best(asked: pa.RecordBatch, units: np.ndarray, seq: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        score = np.round(_flat(asked["unit"], units.shape[1]) @ units.T, SCORE_DIGITS)
        wanted = score >= asked["least"].to_numpy()[:, None]
        if score.shape[1] > limit:
            wanted &= score >= -np.partition(-score, limit - 1, axis=1)[:, limit - 1 : limit]
        row, column = np.nonzero(wanted)
        order = np.lexsort((seq[column], -score[row, column], row))
        row, column = row[order], column[order]
        starts = np.searchsorted(row, row)
        top = np.arange(len(row)) - starts < limit
        row, column = row[top], column[top]
        return pa.RecordBatch.from_arrays(
            [
                asked["query_id"].take(pa.array(row)),
                pa.array(score[row, column]),
                pa.array(seq[column]),
                pa.array(ids[column].tolist(), pa.string()),
            ],
            ["query_id", "score", "seq", "id"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int] | None = None
        parts: list[pa.RecordBatch] = []
        blocks: dict | None = None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("stretch", "share", "side")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if start == end:
                    continue
                key, part = (int(keys[0, start]), int(keys[1, start])), batch.slice(start, end - start)
                if key != held:
                    held, parts, blocks = key, [], None
                if keys[2, start] == 0:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if blocks is None:
                    blocks = by_block(parts)
                for at in range(0, part.num_rows, QUERIES):
                    asked = part.slice(at, QUERIES)
                    wanted = asked["blocks"].flatten()
                    owner = pc.list_parent_indices(asked["blocks"]).to_numpy()
                    pairs = np.stack([wanted.field("cell").to_numpy().astype(np.int64), wanted.field("block").to_numpy()])
                    asked = asked.select(["query_id", "least", "unit"])
                    for block, members in blocks.items():
                        own = owner[(pairs == np.array(block)[:, None]).all(axis=0)]
                        if own.size:
                            yield best(asked.take(pa.array(own)), *members)

    def by_block(parts: list[pa.RecordBatch]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The members (unit, seq, id) of every block of a stretch, which are sorted by block."""
        width = len(parts[0]["unit"][0])
        units = np.concatenate([_flat(p["unit"], width) for p in parts])
        cell, block, seq = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("cell", "block", "seq"))
        ids = np.asarray([i for p in parts for i in p["id"].to_pylist()], dtype=object)
        starts = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])))
        runs = [slice(a, b) for a, b in zip(starts, np.append(starts[1:], len(seq)), strict=True)]
        return {(int(cell[r.start]), int(block[r.start])): (units[r], seq[r], ids[r]) for r in runs}

    dealt = rows.repartition("stretch", "share").sortWithinPartitions("stretch", "share", "side", "cell", "block")
    return dealt.mapInArrow(run, f"query_id {kind}, score double, seq bigint, id string")


def _flat(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def wanted_blocks(
    spark: SparkSession,
    root: str,
    queries: DataFrame,
    limit: int = DEFAULTS.top_k,
    min_similarity: float = DEFAULTS.min_similarity,
    scope: list[str] | DataFrame | None = None,
) -> DataFrame:
    """(query_id, ask, least, cell, block, n): the blocks of n members that may hold a hit scoring ``least`` or more."""
    cells = spark.read.schema(CENTRES).parquet(f"{root}/centres").orderBy("cell").collect()  # at most CELLS + 1 rows
    blocks = spark.read.schema(BLOCKS).parquet(f"{root}/blocks")
    members = in_scope(spark.read.schema(MEMBERS).parquet(f"{root}/members"), scope)
    asked = _asked(queries)

    floor = asked.withColumn("least", F.lit(float(min_similarity)))
    seeds = _met(floor, cells, limit, first=True).join(blocks, "cell").withColumn("bound", _bound())
    seeds = top_k_per(seeds, "query_id", [F.col("bound").desc(), F.col("cell"), F.col("block")], SEEDS)
    found = top_k_per(_scored(seeds, _with_units(asked), members, limit), "query_id", [F.col("score").desc(), F.col("seq")], limit)
    limits = found.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("kth"))
    limits = limits.filter(F.col("found") >= limit).select("query_id", "kth")
    known = asked.join(limits, "query_id", "left").select(
        "query_id", "ask", "embedding", F.coalesce("kth", F.lit(float(min_similarity))).alias("least")
    )
    pairs = _met(known, cells, limit, first=False).join(blocks, "cell").filter(_bound() >= F.col("least"))
    return pairs.select("query_id", "ask", "least", "cell", "block", "n")


def cell_search_batch(
    spark: SparkSession,
    root: str,
    queries: DataFrame,
    limit: int = DEFAULTS.top_k,
    min_similarity: float = DEFAULTS.min_similarity,
    scope: list[str] | DataFrame | None = None,
) -> DataFrame:
    """Nearest stored vectors per query (query_id, embedding), as ``vector_search_batch`` ranks them.

    A scope restricts the rows before the limit. Returns query_id, rank, score (at most 1), seq and id.
    """
    pairs = wanted_blocks(spark, root, queries, limit, min_similarity, scope)
    members = in_scope(spark.read.schema(MEMBERS).parquet(f"{root}/members"), scope)
    ranked = top_k_per(_scored(pairs, _with_units(_asked(queries)), members, limit), "query_id", [F.col("score").desc(), F.col("seq")], limit)
    return ranked.select("query_id", "rank", F.least("score", F.lit(1.0)).alias("score"), "seq", "id")
