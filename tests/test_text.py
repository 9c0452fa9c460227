import sys

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import text as tx

BLANKS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())
LETTERS = st.text(alphabet="aZ9é.!? \t\n\r\x0b\x1c\x1f\x85\xa0  　-'", max_size=40)


def test_whitespace_set_is_the_unicode_one():
    assert set(tx.WHITESPACE_CHARS) == set(BLANKS)


def test_pattern_agrees_with_the_set(spark):
    rows = spark.createDataFrame([(chr(c),) for c in range(0x3100) if not 0xD800 <= c < 0xE000], "c string")
    hits = rows.filter(F.rlike("c", F.lit(rf"\A[{tx.WHITESPACE}]\z"))).collect()
    assert {r.c for r in hits} == set(BLANKS)


@settings(max_examples=5, deadline=None)
@given(st.lists(LETTERS, min_size=200, max_size=300))
def test_functions_match_python(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    v = F.col("v")
    got = rows.select(
        "v",
        tx.strip(v).alias("strip"),
        tx.collapse(v).alias("collapse"),
        tx.collapsed_prefix(v, 5).alias("prefix"),
        tx.word_count(v).alias("n"),
        tx.has_words(v, 3).alias("three"),
        tx.words(v).alias("words"),
        tx.lines(v).alias("lines"),
        tx.ascii_alnum_count(v).alias("alnum"),
        tx.has_ascii_alnum(v, 3).alias("enough"),
    ).collect()
    for r in got:
        assert r.strip == r.v.strip()
        assert r.collapse == " ".join(r.v.split())
        assert r.prefix == " ".join(r.v.split())[:5]
        assert r.n == len(r.v.split())
        assert r.three == (len(r.v.split()) >= 3)
        assert r.words == r.v.split()
        want = [line.strip() for line in r.v.splitlines()]
        assert r.lines[: len(want)] == want and not any(r.lines[len(want) :])
        count = sum(c.isascii() and c.isalnum() for c in r.v)
        assert r.alnum == count
        assert r.enough == (count >= 3)


def test_sentences(spark):
    row = spark.createDataFrame([("One. Two!  Three?\nFour.Five",)], "v string").select(tx.sentences(F.col("v"))).first()
    assert row[0] == ["One.", "Two!", "Three?", "Four.Five"]


def test_long_texts_without_words_are_read_once(spark):
    rows = spark.createDataFrame([("x" * 400_000,), ("." * 400_000,)], "v string")
    got = rows.select(tx.has_words(F.col("v"), 5).alias("w"), tx.has_ascii_alnum(F.col("v"), 20).alias("a")).collect()
    assert [(r.w, r.a) for r in got] == [(False, True), (False, False)]
