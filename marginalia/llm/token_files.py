"""Token ids in flat binary files with 64-bit document offsets.

A data set is a folder of shards in ascending document order. Shard ``s`` has three files:
``<s>.bin``, all ids one after another as little-endian unsigned integers of 16 or 32 bits (32 only if the
vocabulary needs it); ``<s>.idx``, signed 64-bit offsets into them, one per document and the end;
``<s>.doc``, signed 64-bit document ids. The Parquet table ``shards`` names each shard with its counts and
its bases: the documents and ids of all shards before it, by a prefix sum over one row per shard.

Documents are range-partitioned and sorted by id, so a shard is written by one task as a stream; only its
offsets stay in memory. A task writes under a name of its own attempt and renames at the end, so a
repeated or doubled task leaves whole files. Shards on a local or mounted file system are memory-mapped;
other stores are read whole, shard by shard.

Defined cases: a null text has the end id only; null document ids come first and are stored as the least
64-bit integer; repeated ids, and null ones, are ordered by a hash of
their text and by text (so they do not all meet in one shard); an empty table gives no shard; other columns are
ignored. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm.arrow import ranges, slices, words

REMEMBERED = 800_000
NO_ID = -(2**63)
_OUT = "shard int, name string, documents long, tokens long"
#: Words that the library encodes in one call.
_TOGETHER = 16_384


def parted(found: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words as stems and the full stops and commas after them, which tokens never join.

    Stems in ASCII are lower-cased, as the tokenizer does; a word whose stem does not end in a letter stays whole.
    """
    stem = pc.utf8_rtrim(found, characters=".,")
    whole = pc.invert(pc.utf8_is_alpha(pc.utf8_slice_codeunits(stem, -1)))
    cut = pc.utf8_length(stem).to_numpy(zero_copy_only=False)
    size = pc.utf8_length(found).to_numpy(zero_copy_only=False)
    stem = pc.if_else(pc.string_is_ascii(stem), pc.ascii_lower(stem), stem)
    cut = np.where(whole.to_numpy(zero_copy_only=False), size, cut)
    marks = pc.if_else(pa.array(size - cut == 1), pc.utf8_slice_codeunits(found, -1), "")
    longer = np.flatnonzero(size - cut > 1)
    if len(longer):
        marks = pc.replace_with_mask(marks, pa.array(size - cut > 1), pa.array([found[i].as_py()[cut[i] :] for i in longer], pa.string()))
    return pc.if_else(whole, found, stem), marks


class WordMemory:
    """Token ids of strings, computed once and kept for up to ``limit`` strings, in arrays that grow by doubling.

    ``learn`` gets strings and returns their ids one after another and how many each has. Forgetting changes no
    result, only the time.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.learn, self.limit, self.turn = learn, limit, 0
        self._forget()

    def _forget(self) -> None:
        self.turn += 1
        self.known: dict[str, int] = {}
        self.ends, self.pool = np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    @staticmethod
    def _room(values: np.ndarray, size: int) -> np.ndarray:
        if size <= len(values):
            return values
        grown = np.zeros(max(size, 2 * len(values)), values.dtype)
        grown[: len(values)] = values
        return grown

    def places(self, strings: list[str]) -> np.ndarray:
        """The entry of each of these different strings."""
        index = np.fromiter(map(self.known.get, strings, repeat(-1)), np.int64, len(strings))
        missing = np.flatnonzero(index < 0)
        if not len(missing):
            return index
        if len(self.known) + len(missing) > self.limit:
            self._forget()
            missing = np.arange(len(strings))
        n, new = len(self.known), [strings[i] for i in missing.tolist()]
        ids, size = self.learn(new)
        # Entry i ends at ends[i + 1].
        self.ends, end = self._room(self.ends, n + len(new) + 1), self.ends[n]
        self.ends[n + 1 : n + len(new) + 1] = end + np.cumsum(size)
        self.pool = self._room(self.pool, end + len(ids))
        self.pool[end : end + len(ids)] = ids
        self.known.update(zip(new, range(n, n + len(new)), strict=True))
        index[missing] = np.arange(n, n + len(new))
        return index


class WordEncoder:
    """Ids by the tokenizers library of texts whose tokenizer never joins words across ASCII white space.

    Every distinct word is encoded once by the library; a text's ids are those of its words.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.memory = WordMemory(self._learn, REMEMBERED)

    def _learn(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(strings), _TOGETHER):
            own = [e.ids for e in self.tokenizer.encode_batch_fast(strings[at : at + _TOGETHER], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, own), np.int64, len(own)))
            out.append(np.fromiter(chain.from_iterable(own), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(out), np.concatenate(sizes)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with ``end_id`` after each text, and the bounds of each text."""
        codes, bounds, found = words(texts)
        stems, marks = (x.dictionary_encode() for x in parted(found))
        mark_list = marks.dictionary.to_pylist()
        mark = self.memory.places(mark_list)
        turn = self.memory.turn
        stem = self.memory.places(stems.dictionary.to_pylist())
        if turn != self.memory.turn:
            mark = self.memory.places(mark_list)
        # The ids of every distinct word, and of the end as one more.
        own = np.stack((stem[stems.indices.to_numpy()], mark[marks.indices.to_numpy()]), axis=1).ravel()
        begin, many = self.memory.ends[own], self.memory.ends[own + 1] - self.memory.ends[own]
        pool = np.append(self.memory.pool[ranges(begin, many)], np.uint32(end_id))
        size = np.append(many.reshape(-1, 2).sum(axis=1), 1).astype(np.int32)
        first = (np.cumsum(size) - size).astype(np.int32)
        # Every text's words and its end.
        codes = np.insert(codes, bounds[1:], len(found))
        many = size[codes]
        ends = np.cumsum(many)
        ids = pool[np.repeat(first[codes] - (ends - many).astype(np.int32), many) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        return ids, np.concatenate(([0], ends[bounds[1:] + np.arange(len(bounds) - 1)]))


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(definition: str) -> WordEncoder:
    if definition not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[definition] = WordEncoder(definition)
    return _ENCODERS[definition]


def write(docs: DataFrame, root: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the documents' ids below ``root`` and return the table of shards."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    vocabulary = Tokenizer.from_str(definition).get_vocab_size()
    kind = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(definition)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(shared.value), TaskContext.get().partitionId()
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        own = f"{folder}/{uuid.uuid4().hex}"
        offsets, ids, total, out = [np.zeros(1, "<i8")], [np.zeros(0, "<i8")], 0, None
        for part in slices(batches, "text", 4 << 20):
            out = out or store.open_output_stream(f"{own}.bin")
            tokens, bounds = encoder.encode(pc.fill_null(part["text"], ""), end_id)
            out.write(np.ascontiguousarray(tokens, kind))
            offsets.append((total + bounds[1:]).astype("<i8"))
            ids.append(pc.fill_null(part["doc_id"], NO_ID).to_numpy(zero_copy_only=False).astype("<i8"))
            total += len(tokens)
        if out is None:
            return
        out.close()
        for kind_, parts in (("idx", offsets), ("doc", ids)):
            with store.open_output_stream(f"{own}.{kind_}") as file:
                file.write(np.concatenate(parts))
        name = f"shard-{shard:06d}"
        for kind_ in ("bin", "idx", "doc"):
            store.move(f"{own}.{kind_}", f"{folder}/{name}.{kind_}")
        made = [shard], [name], [sum(map(len, ids))], [total]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(made, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)],
            ["shard", "name", "documents", "tokens"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    rows.mapInArrow(run, _OUT).write.mode("overwrite").parquet(f"{root}/written")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.schema(_OUT).parquet(f"{root}/written")
    shards = shards.select(
        "*",
        F.coalesce(F.sum("documents").over(before), F.lit(0)).alias("first_document"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first_token"),
        F.lit(kind).alias("kind"),
    )
    shards.write.mode("overwrite").parquet(f"{root}/shards")
    return spark.read.parquet(f"{root}/shards")


def _file(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if store.get_file_info(path).size else np.zeros(0, kind)
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)


def read(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian unsigned 32-bit integers) from the files of a data set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            for shard in batch.to_pylist():
                base = f"{folder}/{shard['name']}"
                ids, offsets, docs = (_file(store, f"{base}.{x}", k) for x, k in (("bin", shard["kind"]), ("idx", "<i8"), ("doc", "<i8")))
                at = 0
                while at < len(docs):
                    stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (2 << 20), "right")) - 1)
                    own = offsets[at : stop + 1]
                    values = ids[own[0] : own[-1]].astype("<u4")
                    cut = ((own - own[0]) * 4).astype(np.int32)
                    data = pa.Array.from_buffers(pa.binary(), stop - at, [None, pa.py_buffer(cut), pa.py_buffer(values)])
                    name = pa.array(docs[at:stop], pa.int64(), mask=docs[at:stop] == NO_ID)
                    start = pa.array(own[:-1] + shard["first_token"], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [name, start, pa.array(np.diff(own), pa.int64()), data], ["doc_id", "start", "n_tokens", "ids"]
                    )
                    at = stop

    if sys.byteorder != "little":
        raise OSError("token files are little-endian")
    shards = spark.read.parquet(f"{root}/shards")
    shards = shards.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
