"""Merkle manifest of a data set: hashes of rows, trees, root, and each row's proof, by nested intervals.

A row's leaf is the SHA-256 of its fields (``-`` for null, else byte count, ``:`` and value). The leaves of a
tree (here a language) have ranks in the order of id and leaf; a node of level ``l`` covers an interval of up to
``FANOUT ** l`` ranks and is the hash of the up to ``FANOUT`` nodes inside it, joined left to right. A tree of one
node is finished. The trees' last nodes are in the same way the leaves of the tree of trees, whose last node is the root.

Every node carries its interval [lo, hi). Going up, a level groups its nodes by the interval they fall into.
Going down, a node is joined with the node above that contains its interval, by the number of that interval at
the upper level (so the join is an equi-join); its siblings are what the upper interval holds besides its own,
left and right of it. Only nodes above the leaves are joined: the leaves of a node sit in its row. So what is
shuffled after the ranking is one row per node of eight leaves, and no key holds more than eight rows. Ranks come
from one range partitioning by (tree, id, leaf, place) with prefix sums over one row per partition and tree, so
neither a large tree nor repeated ids land in one task. Texts are hashed where they are read and never shuffled.

Defined cases: a null tree comes first, null ids come first in their tree, rows of the same id are ordered by leaf
(equal rows have equal leaves, each with its own place); rows without id count as untouched; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.arrow import stored

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<before:string,after:string>>"


def digest(fields: Sequence[Column]) -> Column:
    """The leaf of a row with these fields."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _tree(name: str) -> Column:
    """A key that is never null, in the order of the names with null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """The rows (with a column ``tree``) with ``lo`` and ``hi``: their rank in their tree by ``order``, and one more."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order, "place"]
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("part", F.shiftright("place", 33)), "ranked")
    parts = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    lo = F.col("place") + F.col("shift")
    return placed.join(parts, ["tree", "part"]).select(*rows.columns, lo.alias("lo"), (lo + 1).alias("hi"))


def _bucket(level: int) -> Column:
    """The number of the interval of ``level`` that holds a node."""
    return F.floor(F.col("lo") / F.lit(FANOUT**level)).cast("long")


def _parents(nodes: DataFrame, level: int, *keep: str) -> DataFrame:
    """The nodes of ``level`` with the nodes below inside them, which carry ``keep`` along."""
    kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest", *keep))).alias("kids")
    rows = nodes.groupBy("tree", _bucket(level).alias("bucket")).agg(kids)
    joined = F.sha2(F.array_join(F.col("kids.digest"), ""), 256)
    return rows.select(
        "tree",
        F.col("kids")[0]["lo"].alias("lo"),
        F.element_at("kids", -1)["hi"].alias("hi"),
        F.when(_finished(F.col("kids")), F.col("kids")[0]["digest"]).otherwise(joined).alias("digest"),
        "kids",
    )


def _finished(kids: Column) -> Column:
    """Whether these are all nodes of their tree, and only one."""
    return (F.size(kids) == 1) & (kids[0]["lo"] == 0)


def _step(kids: Column, lo: Column, hi: Column) -> Column:
    """The siblings of [lo, hi) inside a node, as text before and after it; no step in a finished tree."""
    before = F.array_join(F.transform(F.filter(kids, lambda x: x["hi"] <= lo), lambda x: x["digest"]), "")
    after = F.array_join(F.transform(F.filter(kids, lambda x: x["lo"] >= hi), lambda x: x["digest"]), "")
    own = F.array(F.struct(before.alias("before"), after.alias("after")))
    return F.when(_finished(kids), F.array().cast(_STEP)).otherwise(own)


def levels(leaves: DataFrame, *keep: str) -> list[DataFrame]:
    """Every level above the leaves (tree, lo, hi, digest), up to the one where each tree has one node."""
    out, level = [], 1
    below = leaves
    while True:
        below = stored(_parents(below, level, *(keep if level == 1 else ())), f"level-{level}")
        out.append(below)
        if not below.filter("lo > 0").limit(1).count():
            return out
        level += 1


def proofs(up: list[DataFrame], tops: DataFrame, *keep: str) -> DataFrame:
    """The leaves (tree, digest, ``keep``) with their path to the root.

    ``tops`` has a path, subroot and root per tree. A path is the siblings before and after, from the leaf up.
    """
    above = up[-1].join(tops, "tree")
    for level in range(len(up) - 1, 0, -1):
        a = above.select(F.col("tree").alias("t"), F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("kids").alias("held"), "path", "subroot", "root")
        a = a.withColumn("at", F.floor(F.col("a") / F.lit(FANOUT ** (level + 1))).cast("long"))
        below = up[level - 1].withColumn("bucket", _bucket(level + 1))
        inside = (F.col("tree") == F.col("t")) & (F.col("bucket") == F.col("at")) & (F.col("a") <= F.col("lo")) & (F.col("hi") <= F.col("b"))
        path = F.concat(_step(F.col("held"), F.col("lo"), F.col("hi")), "path").alias("path")
        above = below.join(a, inside).select("tree", "lo", "hi", "kids", path, "subroot", "root")
    rows = above.select("tree", "kids", "path", "subroot", "root", F.explode("kids").alias("leaf"))
    path = F.concat(_step(F.col("kids"), F.col("leaf.lo"), F.col("leaf.hi")), "path").alias("path")
    return rows.select("tree", "leaf.digest", *[f"leaf.{c}" for c in keep], path, "subroot", "root")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda acc, x: F.sha2(F.concat(x["before"], acc, x["after"]), 256))


def manifest(docs: DataFrame, found: DataFrame | None = None, by: str = "lang") -> DataFrame:
    """(doc_id, leaf, path, subroot, root, found) of every row; ``found`` is the leaf to be verified.

    ``docs`` has the columns ``FIELDS`` and may have ``found_digest``, the digest of what is held now; without it, or where it
    is null, the leaf itself stands in.
    """
    own = F.col("found_digest") if "found_digest" in docs.columns else F.lit(None).cast("string")
    leaves = docs.select(
        _tree(by).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), digest([F.col(c) for c in FIELDS]).alias("digest"), own.alias("found")
    )
    up = levels(ranked(stored(leaves, "leaves"), "doc_id", "digest"), "doc_id", "found")
    trees = stored(up[-1].select(F.col("tree").alias("name"), "digest", F.lit("").alias("tree")), "trees")
    high = levels(ranked(trees, "name"), "name")
    root = high[-1].select("tree", F.array().cast(_STEP).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    tops = proofs(high, root, "name").select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    rows = proofs(up, stored(tops, "tops"), "doc_id", "found")
    return rows.select("doc_id", F.col("digest").alias("leaf"), "path", "subroot", "root", F.coalesce("found", "digest").alias("found"))


def verified(rows: DataFrame) -> DataFrame:
    """Proof digest, folded root and verdict for the rows of ``manifest``."""
    path = F.col("path")
    siblings = F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "")
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("found"), path).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
