"""Text column functions with Unicode whitespace rules, all JVM-side.

Java's ``\\s`` and SQL ``trim`` only know ASCII blanks, so the whitespace and line-break sets are
spelled out here once and reused by every operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters treated as whitespace, and those that end a line.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Inside a regular-expression class; the property is many times faster than a list of ranges.
WHITESPACE = r"\p{IsWhite_Space}\x1c-\x1f"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SENTENCE_BREAK = rf"(?<=[.!?])[{WHITESPACE}]+"
WORD_TOKEN = r"[a-z][a-z'-]+"
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable so that ``body`` may use it many times.

    Catalyst may inline a column that is referenced once into a higher-order function, where it
    would be evaluated again for every element; a lambda variable is evaluated exactly once.
    """
    return F.transform(F.array(value), body)[0]


def strip(value: Column) -> Column:
    """Remove Unicode whitespace from both ends."""
    return F.btrim(value, F.lit(WHITESPACE_CHARS))


def collapse(value: Column) -> Column:
    """Whitespace runs become one space; ends are stripped.

    Splitting and joining is many times faster than a regular-expression replacement per blank.
    """
    return F.array_join(F.split(strip(value), rf"[{WHITESPACE}]+"), " ")


def collapsed_prefix(value: Column, chars: int) -> Column:
    """``collapse(value)`` cut to ``chars``: that many words always hold enough characters, so the
    rest of a long text is not split."""
    parts = F.split(strip(value), rf"[{WHITESPACE}]+", chars + 2)
    return F.substring(F.array_join(F.slice(parts, 1, chars + 1), " "), 1, chars)


def word_count(value: Column) -> Column:
    """Number of whitespace-separated words (0 for a blank string)."""

    def gaps(body: Column) -> Column:
        return F.when(body == "", 0).otherwise(F.size(F.split(body, rf"[{WHITESPACE}]+")))

    return let(strip(value), gaps)


def has_words(value: Column, minimum: int) -> Column:
    """At least ``minimum`` words; reads no further than the last one needed."""
    # Anchored, so that a long text with too few words is read once and not from every position.
    word, blank = rf"[^{WHITESPACE}]", rf"[{WHITESPACE}]"
    return F.rlike(value, F.lit(rf"\A{blank}*+(?:{word}++{blank}++){{{minimum - 1}}}{word}"))


def words(value: Column) -> Column:
    """Whitespace-separated words, without empty strings."""
    return F.filter(F.split(value, rf"[{WHITESPACE}]+"), lambda word: word != "")


def lines(value: Column) -> Column:
    """Lines of a text, stripped; a trailing line break may add one blank entry."""
    return F.transform(F.split(value, LINE_BREAK), strip)


def sentences(value: Column) -> Column:
    """Non-blank sentences: split after ``.``, ``!`` or ``?`` followed by whitespace."""
    return F.filter(F.transform(F.split(value, SENTENCE_BREAK), strip), lambda part: part != "")


def word_tokens(value: Column) -> Column:
    """Lower-case Latin word tokens of at least two characters."""
    return F.regexp_extract_all(F.lower(value), F.lit(WORD_TOKEN), F.lit(0))


def ascii_alnum_count(value: Column) -> Column:
    return F.length(F.array_join(F.regexp_extract_all(value, F.lit("[A-Za-z0-9]+"), F.lit(0)), ""))


def has_ascii_alnum(value: Column, minimum: int) -> Column:
    """At least ``minimum`` ASCII letters or digits; reads no further than the last one needed."""
    return F.rlike(value, F.lit(rf"\A[^A-Za-z0-9]*+(?:[A-Za-z0-9][^A-Za-z0-9]*+){{{minimum}}}"))


def clean_control(value: Column) -> Column:
    """Each run of control characters (tab, newline and return excepted) becomes one space."""
    return F.regexp_replace(value, CONTROL_CHARS, " ")
