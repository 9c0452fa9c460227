"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified Hamming distances, components.

Fingerprints: words are runs without ASCII white space, A-Z lower-cased; every shingle of ``SHINGLE``
words, repeats included, is joined by spaces and hashed (XXH64, seed 42); fewer words make one shingle,
none make the fingerprint zero. A bit is set if over half the hashes have it.

Links: fingerprints within ``DISTANCE`` = 2 bits are cut into ``BLOCKS`` = 5 blocks; two changed bits touch
two blocks at most, so close pairs agree on some three of the five. They meet in a join on (choice of
blocks, their bits) and are verified there. The join runs over distinct fingerprints. A block shared by
more than ``CROWD`` of them is not paired within itself: its members meet through copies with one bit
flipped outside the block (two fingerprints are within two bits if such copies agree), in groups that
hold at most one fingerprint per bit. Both ways are exact.

Defined cases: null and empty texts have fingerprint zero and link like any other; rows that repeat an
id or a text each get a row; a null id takes part but is never a component's id unless all its ids are
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.arrow import slices, stored
from marginalia.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
BLOCKS = 5
CROWD = 64
_STEP = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one lower-cased UTF-8 text."""
    words = text.split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    starts = starts[:n].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        bits = np.unpackbits(hashes[at : at + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        texts = pc.ascii_lower(pc.fill_null(part["text"], "")).cast(pa.binary())
        prints = np.array([fingerprint(x.as_py()) for x in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(prints)], ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print): the fingerprint's 64 bits as a long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, print long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks() -> list[int]:
    """One mask per choice of blocks that a close pair may share."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(BLOCKS), BLOCKS - DISTANCE)]


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def links(prints: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints (column ``print``) within two bits."""
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks())])
    keyed = prints.select("print", F.explode(choices).alias("c"))
    keyed = keyed.select("print", "c.choice", "c.mask", F.col("print").bitwiseAND(F.col("c.mask")).alias("block"))
    shared = keyed.groupBy("choice", "block").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = stored(keyed.join(shared, ["choice", "block"]), "blocks")
    few = keyed.filter(F.col("n") <= CROWD).select("choice", "block", "print")
    pairs = few.select("choice", "block", F.col("print").alias("u")).join(
        few.select("choice", "block", F.col("print").alias("v")), ["choice", "block"]
    )
    pairs = pairs.filter((F.col("u") < F.col("v")) & _near("u", "v")).select("u", "v")
    # Crowded blocks: each member and its copies with one other bit flipped meet on the copy.
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    many = keyed.filter(F.col("n") > CROWD).select("print", "mask", "choice", F.explode(flips).alias("flip"))
    many = many.filter(F.col("flip").bitwiseAND(F.col("mask")) == 0)
    many = many.select("choice", "print", F.col("print").bitwiseXOR(F.col("flip")).alias("copy"))
    met = many.select("choice", "copy", F.col("print").alias("u")).join(
        many.select("choice", "copy", F.col("print").alias("v")), ["choice", "copy"]
    )
    met = met.filter((F.col("u") < F.col("v")) & _near("u", "v")).select("u", "v")
    return pairs.unionByName(met).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id: the smallest doc_id reachable)."""
    rows = stored(fingerprints(docs), "fingerprints")
    classes = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    found = components(links(classes.select("print")))
    named = classes.join(found.withColumnRenamed("node", "print"), "print", "left")
    named = named.withColumn("component", F.coalesce("component", "print"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select("print", "component_id")
    return rows.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
