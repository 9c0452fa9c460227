"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame and SQL only.

Candidates inside the words of a text (between ASCII white space) are runs of at least ``LEAST`` letters,
digits, ``+``, ``/``, ``_`` and ``-`` with a digit among them; and, with or without digits and whatever other
signs it holds, the value of at least ``LEAST_VALUE`` characters that is assigned to a telling name
("password=...", "api_key : ..."). A value stands for the runs inside it. Their features: length; transitions
between letters, digits and cases; vowels after consonants; other signs; how much of the candidate dictionary
words cover; the path the document came from (length, digits, words such as test or example); and the
neighbours: an assignment before it, a telling word before that, quotes around it.

The dictionary is counted over all documents: purely alphabetic lower-case words of 3 to 12 letters in at
least ``DICTIONARY_DOCS`` of them; only the words that some candidate contains are joined back.

The forest is trained on labelled findings (doc_id, place, finding, secret), at most ``TRAIN_FINDINGS`` of
them, chosen by a hash. ``weak_labels`` makes such labels where a format decides by itself: hexadecimal keys of
either case in quotes after an assignment, keys with a known prefix, web tokens and mixed base64 values of
telling names are secrets; runs without letters, runs that dictionary words cover to three quarters,
paths and dates are none, unless they are assigned to a telling name. The forest never sees these rules' verdict, only
the features.

Defined cases: null and empty texts have no candidates; repeated rows are findings each; without labels of
both kinds every score is the known kind's, or 0.5 without labels; empty tables give an empty result; other
columns are ignored, also those of labels; a document without a path has an empty one.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import let
from marginalia.llm.arrow import stored

LEAST, LEAST_VALUE = 12, 8
DICTIONARY_DOCS = 5
TRAIN_FINDINGS = 20_000
TREES, DEPTH, SEED = 20, 6, 11
_RUN = "[A-Za-z0-9+/_-]"
#: A run with a digit, from its first character, so that long words are read once.
CANDIDATE = rf"(?<!{_RUN})(?=[A-Za-z+/_-]*+[0-9]){_RUN}{{{LEAST},}}+"
TELLING = r"(?i)(token|secret|passw|pwd|api|key|auth|credential|bearer)"
#: A telling name before an assignment, in one word; and over up to two blanks, to find texts worth splitting.
_NAMED = r"(?i)(?:token|secret|passw|pwd|api|key|auth|credential|bearer)[^=:\x20\x09-\x0D]{0,64}+"
_VALUE = rf"([^\"'`,;()<>\x20\x09-\x0D]{{{LEAST_VALUE},}})"
IN_WORD = rf"{_NAMED}[=:]++[\"'`]*+{_VALUE}"
NAMED_TEXT = rf"{_NAMED}[\x20\x09-\x0D]{{0,2}}+[=:]"
ASSIGNING = r"[=:][\"'`]*$"
SAMPLE_PATH = r"(?i)(test|example|sample|fixture|mock|doc)"

FEATURES = (
    "length digits uppers letter_digit digit_letter case_changes vowel_turns signs covered path_length path_digits path_sample "
    "assigned telling quoted word_rest"
).split()


def _value(word: Column, before: Column, ahead: Column) -> Column:
    """The value that a word assigns to a telling name, or that the words before it do; '' for none."""
    here = F.regexp_extract(word, IN_WORD, 1)
    named = before.rlike(ASSIGNING) & (before.rlike(TELLING) | ((F.length(before) <= 2) & ahead.rlike(TELLING)))
    there = F.regexp_extract(word, rf"^[\"'`(<]*+{_VALUE}", 1)
    return F.when(here != "", here).when(named, there).otherwise("")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, path, place, word, before, ahead, finding): a row per candidate; place counts words from 0."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"),
        F.col("text").cast("string").alias("text"),
    ).filter(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(NAMED_TEXT))

    def found(words: Column) -> Column:
        def neighbour(i: Column, back: int) -> Column:
            return F.when(i >= back, F.get(words, i - back)).otherwise("")

        marked = F.transform(
            words,
            lambda word, i: F.struct(
                i.alias("place"),
                word.alias("word"),
                neighbour(i, 1).alias("before"),
                neighbour(i, 2).alias("ahead"),
                _value(word, neighbour(i, 1), neighbour(i, 2)).alias("value"),
            ),
        )
        return F.filter(marked, lambda x: (x["value"] != "") | x["word"].rlike(CANDIDATE))

    words = F.split("text", r"[\x20\x09-\x0D]+")
    rows = rows.select("doc_id", "path", F.explode(let(words, found)).alias("c")).select("doc_id", "path", "c.*")
    runs = F.filter(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0)), lambda run: ~F.contains("value", run))
    whole = F.when(F.col("value") != "", F.array("value")).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", "path", "place", "word", "before", "ahead", F.explode(F.concat(whole, runs)).alias("finding"))


def dictionary(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """Those of the words ``parts`` (part) that enough documents hold."""
    own = F.array_distinct(F.split(F.lower(F.col("text").cast("string")), r"[^a-z]+"))
    own = docs.select(F.explode(own).alias("part")).filter(F.length("part").between(3, 12))
    counted = own.groupBy("part").agg(F.count("*").alias("docs")).filter(F.col("docs") >= DICTIONARY_DOCS)
    return counted.join(parts.select("part").distinct(), "part", "left_semi").select("part")


def featured(docs: DataFrame) -> DataFrame:
    """Candidates with their features, all doubles."""
    found = stored(candidates(docs).withColumn("row", F.monotonically_increasing_id()), "candidates")
    parts = found.select("row", F.explode(F.regexp_extract_all(F.lower("finding"), F.lit("[a-z]{3,12}"), F.lit(0))).alias("part"))
    known = parts.join(dictionary(docs, parts), "part").groupBy("row").agg(F.sum(F.length("part")).alias("covered"))
    size = F.length("finding")

    def share(pattern: str) -> Column:
        return F.regexp_count("finding", F.lit(pattern)) / size

    before, ahead = F.coalesce("before", F.lit("")), F.coalesce("ahead", F.lit(""))
    return found.join(known, "row", "left").select(
        "doc_id",
        "place",
        "finding",
        "word",
        before.alias("before"),
        size.cast("double").alias("length"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("uppers"),
        share("[A-Za-z](?=[0-9])").alias("letter_digit"),
        share("[0-9](?=[A-Za-z])").alias("digit_letter"),
        share("[a-z](?=[A-Z])").alias("case_changes"),
        share("(?i)[b-df-hj-np-tv-z](?=[aeiou])").alias("vowel_turns"),
        share(r"[^A-Za-z0-9]").alias("signs"),
        (F.coalesce("covered", F.lit(0)) / size).alias("covered"),
        F.length("path").cast("double").alias("path_length"),
        F.regexp_count("path", F.lit("[0-9]")).cast("double").alias("path_digits"),
        F.col("path").rlike(SAMPLE_PATH).cast("double").alias("path_sample"),
        (before.rlike(ASSIGNING) | F.col("word").rlike("[=:]")).cast("double").alias("assigned"),
        (before.rlike(TELLING) | ahead.rlike(TELLING) | F.col("word").rlike(TELLING)).cast("double").alias("telling"),
        F.col("word").rlike("[\"'`]").cast("double").alias("quoted"),
        (F.length("word") - size).cast("double").alias("word_rest"),
    )


#: Published forms of keys that their first characters give away.
PREFIXED = (
    "(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|AIza[A-Za-z0-9_-]{35}"
    "|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{20,}"
)
WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"


def weak_labels(found: DataFrame) -> DataFrame:
    """Candidates whose format decides by itself, with ``secret`` 1 or 0."""
    finding = F.col("finding")
    named = (F.col("assigned") == 1) & (F.col("telling") == 1)
    quoted = (F.col("quoted") == 1) & (F.col("assigned") == 1)
    hexadecimal = (finding.rlike("^(?:[0-9a-f]{40}|[0-9A-F]{40})$") & quoted) | (
        finding.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") & quoted & named
    )
    mixed = finding.rlike("[a-z]") & finding.rlike("[A-Z]") & finding.rlike("[0-9]") & (F.col("covered") < 0.3)
    base64 = finding.rlike("^[A-Za-z0-9+/]{20,}={0,2}$") & mixed & quoted & named
    # A part of a web token counts by the word around it.
    token = finding.rlike("^[A-Za-z0-9._-]+$") & F.col("word").rlike(WEB_TOKEN)
    secret = hexadecimal | base64 | token | finding.rlike(f"^(?:{PREFIXED})$")
    path = finding.rlike("/[^/]+/") & (F.col("covered") >= 0.5)
    date = finding.rlike("^[12][0-9]{3}-[01][0-9]-[0-3][0-9](?:$|T)")
    none = (~finding.rlike("[A-Za-z]") | (F.col("covered") >= 0.75) | path | date) & ~named
    labelled = found.withColumn("secret", F.when(secret, 1.0).when(none, 0.0))
    return labelled.filter("secret is not null")


def judged(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """Candidates with ``score`` (the forest's probability of a secret) and ``is_secret``."""
    kinds = {r["secret"]: r["n"] for r in labelled.groupBy("secret").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return found.withColumn("score", F.lit(next(iter(kinds), 0.5))).withColumn("is_secret", F.col("score") > 0.5)
    span = 1 << 24
    place = F.pmod(F.xxhash64("doc_id", "place", "finding"), F.lit(span))
    # Half of the sample for each kind; the hash thins it to the bound.
    bound = F.create_map(*[F.lit(x) for k, n in kinds.items() for x in (k, int(span * min(1, TRAIN_FINDINGS / 2 / n)))])
    labelled = labelled.filter(place < bound[F.col("secret")])
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(labelCol="secret", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    model = forest.fit(gather.transform(labelled.select("secret", *FEATURES)))
    scored = model.transform(gather.transform(found))
    scored = scored.withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("is_secret", F.col("score") > 0.5).drop("features", "rawPrediction", "probability", "prediction")


def secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, place, finding, score, is_secret) of every candidate.

    ``labelled`` holds findings with labels: doc_id, place, finding, secret (0 or 1); by default weak ones.
    """
    found = stored(featured(docs), "findings")
    if labelled is None:
        known = weak_labels(found)
    else:
        known = found.join(labelled.select("doc_id", "place", "finding", F.col("secret").cast("double")), ["doc_id", "place", "finding"])
    return judged(found, known).select("doc_id", "place", "finding", "score", "is_secret")
