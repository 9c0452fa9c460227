"""Near copies by SimHash fingerprints and MinHash bands, which join candidates; exact Jaccard similarities link them.

Texts whose fingerprints differ in at most two bits are candidates as in ``simhash``. Fingerprints of texts with a few edited
words differ in more bits, so bands add the rest.

Words are those of ``simhash``; a text is the set of its shingles of ``SHINGLE`` words (fewer words make one,
none make the empty set). Texts of the same words are one node. Nodes are linked from a Jaccard similarity of
``LEAST`` on; components of linked nodes are near copies of each other.

Candidates agree on one of ``BANDS`` bands, each a pair of MinHash values; a pair of similarity 0.8 agrees on
none with a chance of 0.36 ** ``BANDS`` (1e-9). Bands of up to ``CROWD`` nodes are paired within themselves. A band that
more nodes share (a crowd) is taken in two steps, so that it costs no pairs among those already known to be alike: its
members meet its node of the smallest id and, in the first ``LEADING`` bands, one chosen by a hash; then each
member outside the crowd's largest component meets, by an exact prefix-filter join, every member of any crowd.
What two members of one component might still share adds nothing, and every other link has an end outside the largest
component, so components are those of all pairs. A prefix is the rarest fifth of a text's shingles: two sets of similarity 0.8
share a shingle there under any order that is the same for all; the order here is by counters of fixed number
(``COUNTERS``), summed over the crowds' texts and broadcast. Two sets that share at least a number of shingles share one among
the rarest (size - number + 1) of each, so the join takes no shingle of a pair beyond these.

Defined cases: null and empty texts are one node, without a text close to it; rows of one id with different
texts, and rows without id, are told apart by ``row``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import simhash
from marginalia.llm.arrow import slices, stored
from marginalia.llm.components import components

SHINGLE = 5
LEAST = 0.8
BANDS = 20
CROWD = 64
LEADING = 4
COUNTERS = 1 << 20
_MIX = np.random.default_rng(17).integers(1, 2**63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The different hashes of a lower-cased text's shingles."""
    own = text.split()
    if not own:
        return np.zeros(0, np.uint64)
    n = max(1, len(own) - SHINGLE + 1)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(own[i : i + SHINGLE])) for i in range(n)], np.uint64))


def bands(own: np.ndarray) -> list[int]:
    """One value for each band of a set of shingles; none for the empty set."""
    if not len(own):
        return []
    least = np.full(2 * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1 << 12):
        mixed = own[at : at + (1 << 12), None] * _MIX
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    return [xxhash.xxh64_intdigest(least[2 * b : 2 * b + 2].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def _lowered(part: pa.RecordBatch) -> list[bytes]:
    return pc.ascii_lower(pc.fill_null(part["text"], "")).cast(pa.binary()).to_pylist()


def _node(text: bytes) -> int:
    return xxhash.xxh64_intdigest(b" ".join(text.split())) - (1 << 63)


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        texts = _lowered(part)
        nodes = pa.array([_node(t) for t in texts], pa.int64())
        prints = pa.array(np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64))
        keys = pa.array([bands(shingles(t)) for t in texts], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([part["doc_id"], part["row"], nodes, prints, keys], ["doc_id", "row", "node", "print", "bands"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        own = [shingles(t).view(np.int64) for t in _lowered(part)]
        yield pa.RecordBatch.from_arrays([part["node"], pa.array(own, pa.list_(pa.int64()))], ["node", "own"])


def with_row(docs: DataFrame) -> DataFrame:
    """The rows with ``row``, a hash that tells rows of the same id, or of none, apart."""
    return docs.withColumn("row", F.xxhash64("text", "lang", "source"))


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) between nodes (node, print): all of one fingerprint with its smallest, and those of close fingerprints."""
    classes = stored(nodes.groupBy("print").agg(F.min("node").alias("least")), "classes")
    same = nodes.join(classes, "print").filter("node != least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    close = simhash.links(classes.select("print")).withColumnsRenamed({"u": "a", "v": "b"})
    close = close.join(classes.select(F.col("print").alias("a"), F.col("least").alias("u")), "a")
    close = close.join(classes.select(F.col("print").alias("b"), F.col("least").alias("v")), "b")
    return same.unionByName(close.select("u", "v"))


def banded(nodes: DataFrame) -> DataFrame:
    """(key, band, node, n, least, other) of the nodes (node, first, bands) that share a band: its size and leaders."""
    keyed = nodes.select("node", "first", F.posexplode("bands").alias("band", "key"))
    order = F.xxhash64("node", "band")
    size = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min(F.struct("first", "node"))["node"].alias("least"), F.min(F.struct(order, "node"))["node"].alias("other")
    )
    return stored(keyed.join(size.filter("n > 1"), "key").select("key", "band", "node", "n", "least", "other"), "bands")


def candidates(keyed: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, to be compared: all within small bands, members with leaders in crowds."""
    few = keyed.filter(F.col("n") <= CROWD)
    pairs = few.select("key", F.col("node").alias("u")).join(few.select("key", F.col("node").alias("v")), "key").select("u", "v")
    many = keyed.filter(F.col("n") > CROWD)
    led = many.select(F.col("least").alias("u"), F.col("node").alias("v"))
    led = led.unionByName(many.filter(F.col("band") < LEADING).select(F.col("other").alias("u"), F.col("node").alias("v")))
    led = led.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return pairs.unionByName(led).filter("u < v").distinct()


def _slots(own: np.ndarray) -> np.ndarray:
    return own & (COUNTERS - 1)


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        total += np.bincount(_slots(batch["own"].flatten().to_numpy()), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])


def _prefixes(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for node, outer, component, own in zip(
                batch["node"].to_pylist(), batch["outer"].to_pylist(), batch["component"].to_pylist(), batch["own"], strict=True
            ):
                own = own.values.to_numpy()
                size = len(own) - int(np.ceil(LEAST * len(own) - 1e-9)) + 1 if len(own) else 0
                found = own[np.lexsort((own, counts[_slots(own)]))[:size]]
                fixed = [pa.array([x] * size) for x in (node, outer, component, len(own))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), *fixed, pa.array(np.arange(size))], ["shingle", "node", "outer", "component", "size", "at"]
                )

    return run


def crowd_candidates(keyed: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Pairs of crowd members of which one is outside the largest component of a crowd; None if there is none."""
    many = keyed.filter(F.col("n") > CROWD).select("key", "node").join(found, "node", "left")
    many = stored(many.select("key", "node", F.coalesce("component", "node").alias("component")), "crowds")
    main = many.groupBy("key", "component").count().groupBy("key").agg(F.max(F.struct("count", "component"))["component"].alias("main"))
    members = many.join(main, "key").groupBy("node", "component").agg(F.max(F.col("component") != F.col("main")).alias("outer"))
    members = stored(members, "members")
    if members.filter("outer").isEmpty():
        return None
    sets = texts.join(members.select("node"), "node", "left_semi").mapInArrow(_sets, "node long, own array<long>")
    sets = stored(sets, "crowd-shingles")
    counts = np.zeros(COUNTERS, np.int64)
    for row in sets.mapInArrow(_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["slot"]] = row["n"]
    shared = keyed.sparkSession.sparkContext.broadcast(counts)
    rows = sets.join(members, "node").select("node", "outer", "component", "own")
    rows = rows.mapInArrow(_prefixes(shared), "shingle long, node long, outer boolean, component long, size long, at long")
    rows = stored(rows, "prefixes")
    own = [F.col("node"), F.col("component"), F.col("size"), F.col("at")]
    a = rows.filter("outer").select("shingle", *[c.alias(n) for c, n in zip(own, ("a", "ca", "na", "pa"), strict=True)])
    b = rows.select("shingle", *[c.alias(n) for c, n in zip(own, ("b", "cb", "nb", "pb"), strict=True)])
    near = (F.col("na") >= LEAST * F.col("nb")) & (F.col("nb") >= LEAST * F.col("na"))
    # The shingles that both must hold, and the places at which the first common one can be.
    least = F.ceil(LEAST / (1 + LEAST) * (F.col("na") + F.col("nb")) - 1e-9)
    near = near & (F.col("pa") + least <= F.col("na")) & (F.col("pb") + least <= F.col("nb"))
    pairs = a.join(b, "shingle").filter((F.col("ca") != F.col("cb")) & near)
    return pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose texts (node, text) are similar enough."""
    used = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    sets = stored(texts.join(used, "node", "left_semi").mapInArrow(_sets, "node long, own array<long>"), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
    near = (F.size("a") >= LEAST * F.size("b")) & (F.size("b") >= LEAST * F.size("a"))
    both = both.filter(near).withColumn("n", F.size(F.array_intersect("a", "b")))
    return both.filter(F.col("n") >= LEAST * (F.size("a") + F.size("b") - F.col("n"))).select("u", "v")


def kept(docs: DataFrame) -> DataFrame:
    """One row (columns of ``docs``) per component: that of the smallest id; rows without an id come last."""
    keyed = with_row(docs)
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "row", F.col("text").cast("string").alias("text"))
    rows = stored(rows.mapInArrow(_signed, "doc_id long, row long, node long, print long, bands array<long>"), "signed")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    one = [F.min(first).alias("first"), F.first("print").alias("print"), F.first("bands").alias("bands")]
    nodes = stored(rows.groupBy("node").agg(*one), "nodes")
    keyed_bands = banded(nodes)
    pairs = candidates(keyed_bands).unionByName(fingerprint_links(nodes.select("node", "print"))).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = stored(pairs.distinct(), "candidates")

    def texts_of(asked: DataFrame) -> DataFrame:
        named = nodes.join(asked, "node", "left_semi").select("node", F.col("first.doc_id").alias("own_id"), F.col("first.row").alias("row"))
        texts = keyed.select("doc_id", "row", "text").join(named, "row").filter(F.col("doc_id").eqNullSafe(F.col("own_id")))
        return texts.select("node", "text").dropDuplicates(["node"])

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()

    links = stored(linked(pairs, texts_of(ends(pairs))), "links")
    found = components(links)
    crowded = keyed_bands.filter(F.col("n") > CROWD).select("node").distinct()
    more = crowd_candidates(keyed_bands, found, texts_of(crowded))
    if more is not None:
        more = stored(more, "crowd-candidates")
        found = components(links.unionByName(linked(more, texts_of(ends(more)))))
    named = nodes.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    winners = stored(named.select(F.col("first.doc_id").alias("own_id"), F.col("first.row").alias("row")), "winners")
    stay = keyed.join(winners, "row").filter(F.col("doc_id").eqNullSafe(F.col("own_id")))
    one = stay.groupBy("doc_id", "row").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("d"))
    return one.select("doc_id", "d.*").select(*docs.columns)
