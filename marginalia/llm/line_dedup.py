"""Incremental line dedup that can be undone: sharded cuckoo filters before exact reference tables.

A line's key is the line without ASCII white space at its ends, with A-Z lower-cased. Keys of at least
``MIN_CHARS`` code points that two or more documents hold keep their lines only in the smallest document
id that holds them.

The store is a folder of versions. Each version appends *references* (key, document, +1 or -1), which are
exact, and writes the *filters*: per shard of the key space a cuckoo filter of the keys with a reference.
A batch of documents asks the filters first; only keys that a filter may hold are looked up in the
references. Deleting a document appends its references with -1 and takes keys that nobody holds any
longer out of their filter, so a later decision is what it would have been without that document.

``deduplicated`` inserts documents in ``BATCHES`` batches of ascending ids. The smallest id of a key is then always in
the store when a later document asks, so a batch is decided by itself and what the filters and references say.

Hot keys are counted by aggregates that combine in the map tasks. The keys that are held most (at most ``HOT_KEYS``, since
each is held by more than that share of all references) reach their documents by broadcast, the others by a shuffle;
no task ever holds all documents of a hot key.

Defined cases: a null or empty text is one empty line; documents with a null id keep every line and count
for nobody; rows that repeat an id are one document as holders, and each row gets that id's decision;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.arrow import WHITE, shared_path, slices, stored
from marginalia.llm.cuckoo import CuckooFilter, filled

MIN_CHARS = 10
#: Documents per shard that a store is made for; shards are fixed when the store is made.
SHARD_DOCUMENTS = 16_384
BATCHES = 3
HOT_KEYS = 50_000
#: Room of a filter that is built anew, and room to spare for batches that hold more keys than the first, by its keys.
GROWTH = 2
SPARE = 1.25

REFERENCE = "shard int, hi long, lo long, doc_id long, held int"
FILTER = "shard int, cells binary"
KEY = ["shard", "hi", "lo"]


def _keys(lines: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Normalised lines as bytes, and which of them are long enough to have a key."""
    lines = pc.ascii_lower(pc.ascii_trim(lines, WHITE))
    return lines, pc.greater_equal(pc.utf8_length(lines), MIN_CHARS).to_numpy(zero_copy_only=False)


def _digests(lines: pa.Array) -> np.ndarray:
    data = b"".join(xxhash.xxh3_128_digest(x) for x in lines.cast(pa.binary()).to_pylist())
    return np.frombuffer(data, "<i8").reshape(-1, 2)


def _references(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        part = part.filter(pc.is_valid(part["doc_id"]))
        lines = pc.split_pattern(pc.fill_null(part["text"], ""), "\n")
        owner = pc.list_parent_indices(lines).to_numpy()
        flat, long = _keys(lines.flatten())
        keys = _digests(flat.filter(pa.array(long)))
        rows = pd.DataFrame({"at": owner[long], "hi": keys[:, 0], "lo": keys[:, 1]}).drop_duplicates()
        ids = part["doc_id"].take(pa.array(rows["at"].to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(rows["hi"]), pa.array(rows["lo"]), ids], ["hi", "lo", "doc_id"])


def references(docs: DataFrame) -> DataFrame:
    """One row (hi, lo, doc_id) per document and key."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_references, "hi long, lo long, doc_id long").distinct()


class LineStore:
    """The versions below ``root``; ``shards`` is fixed for the life of the store.

    The first batch's filters have room for ``batches`` times its keys, so that batches like it do not fill them.
    """

    def __init__(self, spark: SparkSession, root: str, shards: int, batches: int = 1):
        self.spark, self.root, self.shards, self.batches, self.version = spark, root.rstrip("/"), shards, batches, 0

    @classmethod
    def create(cls, spark: SparkSession, root: str, documents: int, batches: int = 1) -> LineStore:
        """A new store for about this many documents, of which the first batch is one of ``batches``."""
        return cls(spark, root, max(4, -(-documents // SHARD_DOCUMENTS)), batches)

    def _path(self, name: str, version: int | None = None) -> str:
        return f"{self.root}/v{version or self.version:06d}/{name}"

    def _shard(self) -> Column:
        return F.pmod(F.col("hi"), F.lit(self.shards)).cast("int").alias("shard")

    def history(self) -> DataFrame:
        """All references ever added (held = 1) or taken back (held = -1)."""
        paths = [self._path("references", v) for v in range(1, self.version + 1)]
        if not paths:
            return self.spark.createDataFrame([], REFERENCE)
        return self.spark.read.schema(REFERENCE).parquet(*paths)

    def live(self) -> DataFrame:
        """References in force, one row per key and document."""
        total = self.history().groupBy(*KEY, "doc_id").agg(F.sum("held").alias("held"))
        return total.filter("held > 0").drop("held")

    def counts(self, rows: DataFrame | None = None) -> DataFrame:
        """The exact reference counts: documents per key and the smallest of them."""
        rows = self.live() if rows is None else rows
        return rows.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))

    def filters(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], FILTER)
        return self.spark.read.schema(FILTER).parquet(self._path("filters"))

    def probe(self, keys: DataFrame) -> DataFrame:
        """The keys with a column ``perhaps``: whether their shard's filter may hold them."""
        if not self.version:
            return keys.withColumn("perhaps", F.lit(False))
        joined = keys.select(*KEY).groupBy("shard").cogroup(self.filters().groupBy("shard"))
        return joined.applyInPandas(_probe, "shard int, hi long, lo long, perhaps boolean")

    def insert(self, docs: DataFrame) -> DataFrame:
        """Add documents; ids that are in the store keep what they hold. Returns counts of the batch's keys."""
        batch = references(docs).select(self._shard(), "hi", "lo", "doc_id")
        if self.version:
            batch = batch.join(self.live(), [*KEY, "doc_id"], "left_anti")
        batch = batch.withColumn("held", F.lit(1))
        version = self.version + 1
        batch.write.mode("overwrite").parquet(self._path("references", version))
        batch = self.spark.read.schema(REFERENCE).parquet(self._path("references", version))
        found = self.counts(batch)
        if not self.version:
            new, total = found, found
        else:
            asked = found.join(self.probe(found).filter("perhaps").select(*KEY), KEY, "left_semi")
            known = self.counts(self.live().join(asked.select(*KEY), KEY, "left_semi"))
            new = found.join(known.select(*KEY), KEY, "left_anti")
            total = found.unionByName(known).groupBy(*KEY)
            total = total.agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"))
        self._filters(version, new.select(*KEY), _grown)
        self.version = version
        return total

    def delete(self, ids: DataFrame) -> None:
        """Take back all documents whose ``doc_id`` is among ``ids``."""
        gone = ids.select(F.col("doc_id").cast("long")).filter("doc_id is not null").distinct()
        taken = self.live().join(gone, "doc_id", "left_semi").select(*KEY, "doc_id", F.lit(-1).alias("held"))
        version = self.version + 1
        taken.write.mode("overwrite").parquet(self._path("references", version))
        before = self.version
        self.version = version
        free = self.spark.read.schema(REFERENCE).parquet(self._path("references", version)).select(*KEY).distinct()
        free = free.join(self.live().join(free, KEY, "left_semi").select(*KEY).distinct(), KEY, "left_anti")
        self.version = before
        self._filters(version, free, _shrunk)
        self.version = version

    def _filters(self, version: int, keys: DataFrame, change) -> None:
        if self.version:
            made = keys.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(change, FILTER)
            made.write.mode("overwrite").parquet(self._path("changed", version))
            made = self.spark.read.schema(FILTER).parquet(self._path("changed", version))
            full = made.filter("cells is null").select("shard")
            if not full.isEmpty():
                # Shards without room are built anew, twice as large, from the exact references.
                keys = self.live().select(*KEY).unionByName(keys).join(full, "shard", "left_semi").distinct()
                made = made.filter("cells is not null").unionByName(keys.groupBy("shard").applyInPandas(_built_for(GROWTH), FILTER))
        else:
            made = keys.groupBy("shard").applyInPandas(_built_for(self.batches * SPARE if self.batches > 1 else 1), FILTER)
        made.write.mode("overwrite").parquet(self._path("filters", version))

    def dropped(self, docs: DataFrame, totals: DataFrame) -> DataFrame:
        """Per document id the keys whose lines go: another document before it holds them."""
        shared = stored(totals.filter("n_docs > 1"), "shared-lines")
        held = shared.agg(F.sum("n_docs")).first()[0] or 0
        # Keys held more often than this are at most HOT_KEYS.
        often = F.col("n_docs") > held // HOT_KEYS + 1
        hot, other = shared.filter(often).drop("n_docs"), shared.filter(~often).drop("n_docs")
        rows = docs if {"hi", "lo"} <= set(docs.columns) else references(docs).select(self._shard(), "hi", "lo", "doc_id")
        rows = rows.select(*KEY, "doc_id").join(F.broadcast(hot), KEY, "left")
        found = rows.filter("first_doc is not null")
        rows = found.unionByName(rows.filter("first_doc is null").drop("first_doc").join(other, KEY)).filter("doc_id > first_doc")
        return rows.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("gone"))

    def batch(self, version: int | None = None) -> DataFrame:
        """References that a version added."""
        return self.spark.read.schema(REFERENCE).parquet(self._path("references", version)).filter("held > 0")


def _array(rows: pd.DataFrame) -> np.ndarray:
    return rows["lo"].to_numpy(np.int64).view(np.uint64)


def _probe(keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    perhaps = CuckooFilter.from_bytes(old["cells"].iloc[0]).contains(_array(keys)) if len(old) else np.zeros(len(keys), bool)
    return keys[["shard", "hi", "lo"]].assign(perhaps=perhaps)


def _built_for(times: float):
    """Builds a shard's filter with room for that many times its keys."""

    def built(keys: pd.DataFrame) -> pd.DataFrame:
        made = filled(_array(keys), int(times * len(keys)))
        return pd.DataFrame({"shard": keys["shard"].iloc[:1], "cells": [made.to_bytes()]})

    return built


def _grown(keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """The shard's filter with these keys; null cells if they do not fit."""
    if not len(old):
        return _built_for(GROWTH)(keys)
    if not len(keys):
        return old
    made = CuckooFilter.from_bytes(old["cells"].iloc[0])
    cells = None
    if made.items + len(keys) <= made.capacity:
        try:
            made.insert(_array(keys))
            cells = made.to_bytes()
        except OverflowError:
            pass
    return pd.DataFrame({"shard": old["shard"].iloc[:1], "cells": [cells]})


def _shrunk(keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    made = CuckooFilter.from_bytes(old["cells"].iloc[0])
    made.delete(_array(keys))
    return pd.DataFrame({"shard": old["shard"].iloc[:1], "cells": [made.to_bytes()]})


def _rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        texts = pc.fill_null(part["text"], "")
        lines = pc.split_pattern(texts, "\n")
        total = pc.list_value_length(lines).to_numpy()
        gone = part["gone"].to_pylist()
        kept, dropped = texts.to_pylist(), np.zeros(len(part), np.int64)
        for i, keys in enumerate(gone):
            if keys:
                drop = {(k["hi"], k["lo"]) for k in keys}
                own = lines[i].values
                flat, long = _keys(own)
                hashed = iter(_digests(flat.filter(pa.array(long))).tolist())
                stay = [not (has and tuple(next(hashed)) in drop) for has in long]
                kept[i] = "\n".join(x for x, s in zip(own.to_pylist(), stay, strict=True) if s)
                dropped[i] = len(stay) - sum(stay)
        others = [c for c in part.schema.names if c not in ("text", "gone")]
        made = [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(dropped)]
        yield pa.RecordBatch.from_arrays([*(part[c] for c in others), *made], [*others, "kept", "n_lines", "n_dropped"])


def rewritten(docs: DataFrame, dropped: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Texts without the dropped lines: doc_id, the string columns ``keep``, kept, n_lines (before), n_dropped."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", *keep)])
    others = "".join(f"{c} string, " for c in keep)
    schema = f"doc_id long, {others}kept string, n_lines long, n_dropped long"
    # Rows without id lose nothing and need not meet in one task.
    without = rows.filter("doc_id is null").withColumn("gone", F.lit(None).cast(dropped.schema["gone"].dataType))
    return rows.filter("doc_id is not null").join(dropped, "doc_id", "left").unionByName(without).mapInArrow(_rewrite, schema)


def deduplicated(docs: DataFrame, store: LineStore | None = None, keep: tuple[str, ...] = (), batches: int = BATCHES) -> DataFrame:
    """Insert documents into a store (a new one by default) and return what stays of their lines.

    A store that holds documents already takes them as one batch.
    """
    spark = docs.sparkSession
    if store is not None and store.version:
        totals = store.insert(docs)
        return rewritten(docs, store.dropped(store.batch(), totals), keep)
    store = store or LineStore.create(spark, shared_path(spark, "lines"), docs.count(), batches)
    ids = F.col("doc_id").cast("long")
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set(docs.select(ids.cast("double").alias("id")).approxQuantile("id", shares, 0.01))) if shares else []
    gone = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = F.lit(True) if low is None else ids > int(low)
        inside = inside if high is None else inside & (ids <= int(high))
        totals = store.insert(docs.filter(inside))
        own = store.dropped(store.batch(), totals)
        gone = own if gone is None else gone.unionByName(own)
    return rewritten(docs, gone, keep)


def digest(rows: DataFrame) -> DataFrame:
    """The result with a hash in place of the text."""
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
