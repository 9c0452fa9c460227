"""Exact search over the cell index against all pairs."""

import numpy as np
import pytest

from marginalia.operators import cells
from marginalia.operators.vector import vector_search_batch


def vectors(spark, matrix):
    rows = [(f"ev_{n}", n, f"doc_{n % 3}", None if v is None else [float(x) for x in v]) for n, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "id string, seq bigint, document_id string, embedding array<float>").repartition(5)


def asked(spark, matrix):
    rows = [(n, None if v is None else [float(x) for x in v]) for n, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "query_id int, embedding array<double>")


def rows_of(hits):
    return sorted((r.query_id, r.rank, r.seq, r.id, round(r.score, 9)) for r in hits.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 16))
    matrix = centres[rng.integers(0, 12, 4000)] + rng.normal(size=(4000, 16)) * 0.15
    matrix = matrix.astype(np.float32)
    matrix[1000:2400] = matrix[5]  # a third are copies of one vector: more than one block of one cell
    matrix[[7, 3000]] = 0
    return matrix


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("cells"))
    cells.build_cells(vectors(spark, clustered), root, cells=16)
    return root


@pytest.mark.parametrize("floor", [0.35, -1.0])
@pytest.mark.parametrize("scope", [None, ["doc_1"]])
def test_equals_the_full_scan(spark, clustered, index, floor, scope):
    wanted = [*clustered[[5, 6, 7, 11, 2500, 3999]].astype(np.float64), np.zeros(16), -clustered[8].astype(np.float64), None]
    queries = asked(spark, wanted)
    got = rows_of(cells.cell_search_batch(spark, index, queries, min_similarity=floor, scope=scope))
    full = vector_search_batch(vectors(spark, clustered), queries.filter("embedding is not null"), min_similarity=floor, scope=scope)
    assert got == rows_of(full)
    assert {q for q, *_ in got} >= {0, 1, 3, 4, 5}


def test_brute_force_order_with_ties(spark, clustered, index):
    query = clustered[5].astype(np.float64)
    wide = clustered.astype(np.float64)
    norms = np.maximum(np.linalg.norm(wide, axis=1), 1e-300)
    cosine = np.round(wide @ query / norms / np.linalg.norm(query), 12)
    order = np.lexsort((np.arange(len(wide)), -cosine))[:12].tolist()
    assert [s for _, _, s, _, _ in rows_of(cells.cell_search_batch(spark, index, asked(spark, [query])))] == order


def test_most_vectors_are_never_scored(spark, clustered, index):
    queries = asked(spark, clustered[2500:2600].astype(np.float64))
    scored = cells.wanted_blocks(spark, index, queries).agg({"n": "sum"}).first()[0]
    assert scored < 0.5 * 100 * len(clustered)


def test_blocks_are_bounded_and_split_a_hot_cell(spark, index):
    blocks = spark.read.parquet(f"{index}/blocks").collect()
    assert max(b.n for b in blocks) <= cells.BLOCK and sum(b.n for b in blocks) == 4000
    assert max(sum(b.cell == c for b in blocks) for c in {b.cell for b in blocks}) > 1
    assert [b.n for b in blocks if b.cell == cells.ZERO] == [2]


def test_few_null_zero_and_no_vectors(spark, tmp_path):
    few = vectors(spark, [[1.0, 0.0], None, [float("nan"), 1.0], [0.0, 2.0], [1.0, 0.0]])
    cells.build_cells(few, str(tmp_path / "few"))
    queries = asked(spark, [[2.0, 0.0], [0.0, 0.0]])
    got = rows_of(cells.cell_search_batch(spark, str(tmp_path / "few"), queries, min_similarity=0.0))
    assert [(q, s) for q, _, s, _, _ in got] == [(0, 0), (0, 4), (0, 3), (1, 0), (1, 3), (1, 4)]
    cells.build_cells(vectors(spark, [[0.0, 0.0]] * 3), str(tmp_path / "zero"))
    got = rows_of(cells.cell_search_batch(spark, str(tmp_path / "zero"), queries, min_similarity=0.0))
    assert [(q, s) for q, _, s, _, _ in got] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    cells.build_cells(few.limit(0), str(tmp_path / "none"))
    assert cells.cell_search_batch(spark, str(tmp_path / "none"), queries).count() == 0
    assert cells.cell_search_batch(spark, str(tmp_path / "few"), queries.limit(0)).count() == 0


def test_other_lengths_raise(spark, index):
    with pytest.raises(Exception, match="dimension 16"):
        cells.cell_search_batch(spark, index, asked(spark, [[1.0, 2.0]])).collect()
