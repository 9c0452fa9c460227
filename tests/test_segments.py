"""Chunks of long texts, folded in segments, against the fold inside one row."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.config import Settings
from marginalia.operators import chunking, segments

TEXT = "document_id string, page int, text string"


def rows(frame):
    names = ("document_id", "page", "ordinal", "line_start", "line_end", "text")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def in_one_row(texts, settings):
    found = chunking.page_chunks(F.col("text"), settings.chunk_max_words, settings.chunk_overlap_words)
    one = texts.filter("text is not null").select("document_id", "page", F.posexplode(found).alias("k", "c"))
    return one.select("document_id", "page", (F.col("k") + 1).alias("ordinal"), "c.*")


def random_text(rng, lines):
    made = []
    for _ in range(lines):
        kind = rng.random()
        made.append("" if kind < 0.35 else " " if kind < 0.4 else " ".join(["wort"] * rng.choice([1, 1, 2, 3, 9, 30])))
    return "\n".join(made)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    data = [(f"doc_{i}", p, random_text(rng, rng.choice([1, 7, 60, 400]))) for i in range(12) for p in (1, 2)]
    # Null, empty and blank texts, one paragraph over many blocks, one line, no id, lines of one word.
    data += [
        ("a", 1, None),
        ("b", 1, ""),
        ("c", 1, " \n\n\t\n"),
        ("d", 1, "\n".join(["x y"] * 100)),
        ("e", 1, "word " * 500),
        (None, 1, "one\n\ntwo\n\n" + "three " * 40),
        ("f", None, "\n\n".join("abcdefg" * 20)),
    ]
    return spark.createDataFrame(data, TEXT)


@pytest.mark.parametrize(("budget", "overlap", "size"), [(12, 4, 3), (10, 10, 5), (3, 7, 4), (20, 0, 2), (1, 1, 1)])
def test_segments_equal_the_fold_in_one_row(texts, budget, overlap, size):
    settings = Settings(chunk_max_words=budget, chunk_overlap_words=overlap)
    got = segments.chunks(segments.line_blocks(texts, size), settings, group=size)
    want = rows(in_one_row(texts, settings))
    assert len(want) > 100
    assert rows(got) == want


def test_other_columns_and_empty_tables(spark, texts):
    extra = texts.select("*", F.lit(1).alias("block"), F.lit("x").alias("lines"), F.lit(2).alias("group"))
    assert rows(segments.chunks(segments.line_blocks(extra))) == rows(segments.chunks(segments.line_blocks(texts)))
    assert segments.chunks(segments.line_blocks(spark.createDataFrame([], TEXT))).count() == 0


def test_file_read_by_many_splits(spark, tmp_path):
    rng = random.Random(6)
    text = "﻿" + "\r\n".join(f"{n} ü {random_text(rng, 1)}" if rng.random() < 0.7 else "" for n in range(4000)) + " tail\n"
    (tmp_path / "big.txt").write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        blocks = segments.file_blocks(spark, str(tmp_path), 50)
        assert blocks.select("block.start").distinct().count() > 5
        got = rows(segments.chunks(blocks, group=1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    name = got[0][0]
    one = spark.createDataFrame([(name, 1, text.removeprefix("﻿"))], TEXT)
    assert name.endswith("/big.txt")
    assert got == rows(in_one_row(one, Settings()))
