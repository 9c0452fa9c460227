"""Steps whose work must grow no faster than their input, and the fingerprints of the near-copy stage."""

import itertools

import numpy as np

from marginalia.llm import line_dedup, near_copies, simhash


def test_later_batches_fit_the_first_ones_filters(spark, tmp_path):
    docs = [(i, "\n".join(f"line {i} number {n}" for n in range(40))) for i in range(300)]
    store = line_dedup.LineStore.create(spark, str(tmp_path), len(docs), 3)
    for low in (0, 100, 200):
        store.insert(spark.createDataFrame(docs[low : low + 100], "doc_id long, text string"))
    for version in (2, 3):
        changed = spark.read.schema(line_dedup.FILTER).parquet(f"{tmp_path}/v{version:06d}/changed")
        assert changed.count() == 4 and changed.filter("cells is null").isEmpty()


def test_close_fingerprints_are_candidates(spark):
    base = " ".join(f"w{n}" for n in range(101))
    more = " ".join(f"x{n}" for n in range(40))
    docs = [(1, " ".join([base] * 30)), (2, " ".join([base] * 30 + [more])), (3, more)]
    prints = np.array([simhash.fingerprint(t.encode()) for _, t in docs], np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(i, x) for (i, _), x in zip(docs, prints, strict=True)], "node long, print long")
    assert {frozenset(r) for r in near_copies.fingerprint_links(nodes).collect()} == {frozenset((1, 2))}


def test_prefixes_of_a_pair_share_a_shingle():
    chance = np.random.default_rng(4)
    sets = [set(range(40)) - set(chance.choice(40, chance.integers(0, 9), replace=False).tolist()) for _ in range(100)]
    near = 0
    for a, b in itertools.combinations(sets, 2):
        if len(a & b) >= near_copies.LEAST * len(a | b):
            near += 1
            least = int(np.ceil(near_copies.LEAST / (1 + near_copies.LEAST) * (len(a) + len(b)) - 1e-9))
            assert set(sorted(a)[: len(a) - least + 1]) & set(sorted(b)[: len(b) - least + 1])
    assert 0 < near < 4950
