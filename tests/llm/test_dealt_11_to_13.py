"""Lexical search by dual trees, the factorisation machine and the manifest, against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import dual_tree, factor_machine, manifest
from marginalia.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, item string, tree string, label string, rank string"
ROWS = [
    (1, "Alpha beta gamma, beta-ALPHA; delta 42", "en", "a"),
    (2, "alpha beta", "en", "a"),
    (2, "alpha beta", "en", "a"),
    (3, None, None, None),
    (4, "", "fr", "x"),
    (None, "alpha beta", None, None),
    (5, " \t\n.,;", "de", "y"),
    (6, "Été été ÉTÉ straße gamma", "fr", "y"),
    (7, "gamma " * 30_000, "en", "z"),
    (8, "x" * 40_000, "de", "z"),
    (9, "日本語 alpha \x1e a\x00b", None, "z"),
    *[(i, "alpha gamma " + "delta " * (i % 5), "en", "b") for i in range(20, 60)],
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["clash"] * 4) for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# Ranked lexical search


def brute_ranks(docs, items, k):
    """Every item's best documents, as a bag of (item_id, rank, score) and of (item_id, doc_id, score)."""
    found = [(i, Counter(re.findall("[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+", lowered(t)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        asked = re.findall("[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+", lowered(text))
        scored = []
        for i, c in found:
            m = 75 + 25 * sum(c.values()) * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t in asked
                if c[t]
            )
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = "item_id long, text string, doc_id string"
ASKED = [(1, "alpha alpha beta", "c"), (1, "gamma", "c"), (2, None, "c"), (3, "", "c"), (None, "ÉTÉ delta", "c"), (4, "nowhere", "c")]
ASKED += [(10 + i, f"{'alpha beta gamma delta'.split()[i % 4]} été {i}", "c") for i in range(30)]


@pytest.mark.parametrize(("leaf", "batch", "cells", "exact"), [(2, 8, 1 << 22, 1 << 53), (32, 1024, 1 << 22, 1), (3, 5, 1200, 1 << 53)])
def test_ranked_search_against_brute_force(spark, edges, monkeypatch, leaf, batch, cells, exact):
    for name, value in (("LEAF", leaf), ("BATCH", batch), ("CELLS", cells), ("EXACT", exact)):
        monkeypatch.setattr(dual_tree, name, value)
    got = dual_tree.ranked(edges, spark.createDataFrame(ASKED, ITEMS), 5).collect()
    assert sorted(map(tuple, got), key=repr) == brute_ranks([r[:2] for r in ROWS], [a[:2] for a in ASKED], 5)


def test_ranked_search_of_nothing(spark, edges, nothing):
    asked = spark.createDataFrame(ASKED, ITEMS)
    assert dual_tree.ranked(nothing, asked).count() == 0
    assert dual_tree.ranked(edges, asked.filter("false")).count() == 0
    assert dual_tree.ranked(edges.filter("text is null"), asked).count() == 0


def test_bounds_leave_batches_out(spark):
    """With limits of real scores, nodes that cannot reach them are not scored."""
    counts = [{c: 1} for c in range(64)]
    model = dual_tree.tree(list(range(64)), counts, np.full(64, 1000))
    assert sorted(model.number) == list(range(64)) and len(model.groups) == 8 and len(model.large) == 1
    best = dual_tree._Best(np.full(64, 10**9), 5)
    rows = [{"high_codes": np.array([3], "<i4").tobytes(), "high": np.array([10], "<i4").tobytes()}]
    assert dual_tree.search(dual_tree._Batch(rows[0], model), best) == 0


# Quality


def test_machine_equals_the_sum_over_all_pairs():
    chance = np.random.default_rng(3)
    model = factor_machine.Model(0.3, chance.normal(size=factor_machine.WIDTH), chance.normal(size=(factor_machine.WIDTH, 3)))
    held = chance.choice(factor_machine.WIDTH, 12, replace=False)
    value = chance.normal(size=12)
    bounds = np.array([0, 5, 5, 12])
    want = []
    for a, b in itertools.pairwise(bounds):
        raw = model.bias + sum(model.linear[held[i]] * value[i] for i in range(a, b))
        raw += sum(model.factors[held[i]] @ model.factors[held[j]] * value[i] * value[j] for i in range(a, b) for j in range(i + 1, b))
        want.append(1 / (1 + math.exp(-raw)))
    assert np.allclose(factor_machine.scores(model, held, value, bounds), want)


def test_features_of_words_and_structure():
    texts = ["The the THE!! word### 12", "", None, "word### word###"]
    held, value, bounds = factor_machine.features(pa.array(texts), pa.array([5, None, 0, 10], pa.int64()))
    rows = [dict(zip(held[a:b], value[a:b], strict=True)) for a, b in itertools.pairwise(bounds)]
    hashed = [{k: v for k, v in r.items() if k >= factor_machine._OFFSET} for r in rows]
    # the, word, 12; and the forms Aa, a, A with two marks, a with three marks, 0.
    assert [len(h) for h in hashed] == [8, 0, 0, 2]
    assert all(len(r) - len(h) == factor_machine.STATISTICS for r, h in zip(rows, hashed, strict=True))
    assert math.isclose(sum(v * v for v in hashed[0].values()), 1)
    own, form = factor_machine.word_buckets(pa.array(["The", "the###", "THE", "###"]))
    assert own[0] == own[1] == own[2] and own[3] == -1 and len(set(form)) == 4


def test_quality_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = QUERIES["op12_factor_machine"](spark, sf_dir).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r["score"] for r in found if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.7 for s in good]) > 0.95 and np.mean([s >= 0.7 for s in bad]) < 0.2
    assert all(r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)


def test_quality_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, 0), (None, 1), (7, None), (9, 5)], "doc_id long, quality int")
    model = factor_machine.learned(edges, labels)
    rows = factor_machine.scored(edges, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    empty = factor_machine.learned(edges, labels.filter("false"))
    assert {r["score"] for r in factor_machine.scored(edges, empty).collect()} == {0.5}
    assert factor_machine.scored(nothing, model).count() == 0
    assert factor_machine.learned(edges, labels, most=1).bias > 0


# Manifest


def brute_manifest(rows, changed):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, lang, source, n_chars) rows."""

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(i, text, lang, source, n):
        return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)])

    def climb(nodes):
        """Root, and for each node its siblings by level (before, after)."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
            for k, i in enumerate(at):
                run, place = runs[i // 8], i % 8
                paths[k].append(("".join(run[:place]), "".join(run[place + 1 :])))
                at[k] = i // 8
            nodes = [h(*r) for r in runs]
        return nodes[0], paths

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    out, tops = [], []
    for lang in sorted(trees, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(trees[lang], key=lambda x: x[:3])
        top, paths = climb([x[2] for x in own])
        tops.append((top, own, paths))
    root, high = climb([t for t, _, _ in tops]) if tops else (None, [])
    for (top, own, paths), above in zip(tops, high, strict=True):
        for (_, _, digest, r), path in zip(own, paths, strict=True):
            found = leaf(*changed(r))
            for a, b in path + above:
                found = h(a, found, b)
            out.append((r[0], digest, top, root, h(*[x for p in path + above for x in p]), found, found == root))
    return sorted(out, key=repr)


def lower_a_third(r):
    return (r[0], lowered(r[1]) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[1], *r[2:])


@pytest.mark.parametrize("n", [1, 8, 9, 300])
def test_manifest_against_brute_force(spark, tmp_path, edges, n):
    more = [(100 + i % (n - n // 3), f"Text {i}", f"l{i % 2}" if i % 5 else None, "s", 7) for i in range(n)]
    rows = [(*r, None if r[1] is None else len(r[1])) for r in ROWS] + more
    docs = spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == brute_manifest(rows, lower_a_third)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_nothing(spark, nothing):
    one = spark.createDataFrame([(1, "A", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    row = manifest.verified(manifest.manifest(one)).collect()[0]
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"]
    assert row["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    assert manifest.verified(manifest.manifest(nothing)).count() == 0


# Near copies in a crowd


def crowd_of(copies, words, edits, seed):
    chance = np.random.default_rng(seed)
    base = [f"w{x}" for x in chance.integers(0, 10**6, words)]
    out = []
    for i in range(copies):
        own = list(base)
        for at in chance.choice(words, edits, replace=False):
            own[at] = f"e{chance.integers(0, 10**6)}"
        out.append((i, " ".join(own)))
    return out


def exact_survivors(rows):
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for _, t in rows]
    names = {s: n for n, s in enumerate(set().union(*sets))}
    cells = np.zeros((len(rows), len(names)), np.float32)
    for i, s in enumerate(sets):
        cells[i, [names[x] for x in s]] = 1
    both, size = cells @ cells.T, cells.sum(axis=1)
    link = both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-6
    left, kept = set(range(len(rows))), set()
    while left:
        first = min(left)
        reached, new = {first}, [first]
        while new:
            new = [int(j) for i in new for j in np.flatnonzero(link[i]) if j not in reached and not reached.add(int(j))]
        kept.add(rows[first][0])
        left -= reached
    return kept, int((link.sum() - len(rows)) // 2)


@pytest.mark.parametrize(("words", "edits"), [(200, 3), (60, 1)])
def test_links_in_a_crowd_of_near_copies_are_whole(spark, words, edits):
    from marginalia.llm import near_copies

    rows = crowd_of(600 if words == 200 else 150, words, edits, 1)
    want, links = exact_survivors(rows)
    assert links > 1000 and len(want) < 100
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in near_copies.kept(docs).collect()} == want
