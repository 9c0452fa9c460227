"""Every operator against brute force, SQL, exact round trips or held-out accuracy, on edge cases and the corpus."""

import hashlib
import html as entities
import itertools
import random
import re
import time
import zlib

import numpy as np
import oracle
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marginalia.llm import (
    byte_bpe,
    decontamination,
    html_templates,
    interpolation,
    language_crf,
    line_dedup,
    secrets,
    simhash,
    token_files,
    topk,
)
from marginalia.llm.arrow import shared_path
from marginalia.llm.components import components
from marginalia.llm.cuckoo import CuckooFilter, filled
from marginalia.llm.queries import END_ID, QUERIES, SQL, WORD_TOKENIZER

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hi string, print string, row string, gone string, fold string"
WORDS = "[^\\x20\\x09-\\x0d]+"

#: Nulls in every column, empty and very long texts, ties, repeated rows, odd white space.
EDGES = [
    (1, "The first line stays here.\n  the FIRST line stays here.\t\nshort\nAnother line entirely", "en", "src0/a"),
    (2, "the first line stays here.\nshort\nAnother line entirely\n\n", "en", "src0/a"),
    (2, "the first line stays here.\nshort\nAnother line entirely\n\n", "en", "src0/a"),
    (3, None, None, None),
    (4, "", "fr", "x"),
    (None, "the first line stays here.\nelle est là", None, None),
    (5, " \t\x0b\n \x0c\r\n", "de", "test/doc"),
    (6, "Été ÀÉÎ straße élan vital déjà vu ici là", "fr", "y"),
    (7, "lang " * 30_000, "en", "z"),
    (8, "x" * 40_000, "de", "z"),
    (9, "日本語のテキスト <|endoftext|> it's we'll 12345 +-*/ \x1e a\x00b", None, "z"),
    (10, 'my token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and 9807915762804490', "en", "src/test_x"),
    (11, 'the token = "14dbebab91ab85687d33eeaaf9ac699e1188f963" or 1807915762804491 abc-123-def-456', "en", "src/x"),
]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, x, s, None if t is None else len(t), *["clash"] * 5) for i, t, x, s in EDGES]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def bag(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    assert oracle.difference(spark, oracle.connect(sf_dir), QUERIES[name], SQL[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op7_decontamination"}))
def test_query_gives_whole_result(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir)
    n = rows.count()
    if name.startswith(("op2_", "op8_")):
        assert n
    else:
        assert n == spark.read.parquet(f"{sf_dir}/{'pages' if name.startswith('op5_') else 'documents'}.parquet").count()


# Language


def test_language_held_out_accuracy(spark, sf_dir, corpus):
    found = QUERIES["op1_language_crf"](spark, sf_dir)
    rows = found.join(corpus.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    fold = {r["doc_id"]: r["held_out"] for r in found.collect()}
    assert all(held == (zlib.crc32(str(i).encode()) % 5 == 0) for i, held in fold.items())


@pytest.fixture(scope="module")
def model(corpus):
    return language_crf.train(*language_crf.sample(corpus, 200))


def test_language_edges(edges, nothing, model):
    found = {(r["doc_id"], r["lang_pred"]): r for r in language_crf.predicted(edges, model).collect()}
    ids = {i: lang for i, lang in found}
    assert ids[3] == ids[4] == ids[5] == "und" and found[3, "und"]["score"] == 0
    assert all(ids[i] in model.labels for i in (1, 2, 6, 7, 8, 9, 10))
    assert found[7, ids[7]]["n_words"] == 30_000
    assert language_crf.predicted(nothing, model).count() == 0
    empty = language_crf.train(*language_crf.sample(nothing))
    assert {r["lang_pred"] for r in language_crf.predicted(edges, empty).collect()} == {"und"}
    assert language_crf.train(["a b", "c"], ["en", "en"]).labels == ["en"]


def test_language_runs_follow_code_switching(spark, corpus, model):
    rows = corpus.filter("lang in ('de', 'fr') and n_chars > 400").orderBy("doc_id").collect()
    de = next(r["text"] for r in rows if r["lang"] == "de").split()[:30]
    fr = next(r["text"] for r in rows if r["lang"] == "fr").split()[:30]
    mixed = spark.createDataFrame([(1, " ".join(de + fr))], "doc_id long, text string")
    runs = language_crf.labelled_runs(mixed, model).first()["runs"]
    assert sum(r["words"] for r in runs if r["lang"] == "de") >= 20
    assert sum(r["words"] for r in runs if r["lang"] == "fr") >= 20
    assert len(runs) <= 12


def test_forward_backward_sums_over_all_paths():
    chance = np.random.default_rng(0)
    scores, moves = chance.normal(size=(4, 2, 3)), chance.normal(size=(3, 3))
    got, pairs = language_crf.forward_backward(scores, moves, np.array([4, 2]))
    want, want_pairs = np.zeros((4, 2, 3)), np.zeros((3, 3))
    for i, n in enumerate((4, 2)):
        paths = list(itertools.product(range(3), repeat=n))
        weight = np.array([np.exp(sum(scores[t, i, s] for t, s in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        for p, w in zip(paths, weight / weight.sum()):
            for t, s in enumerate(p):
                want[t, i, s] += w
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w
    np.testing.assert_allclose(got[:, 0], want[:, 0], atol=1e-9)
    np.testing.assert_allclose(got[:2, 1], want[:2, 1], atol=1e-9)
    np.testing.assert_allclose(pairs, want_pairs, atol=1e-9)


# Secrets


NAMES = "(?:token|secret|passw|pwd|api|key|auth|credential|bearer)"


def brute_findings(text):
    """(place, finding) by hand: runs with digits, and values assigned to telling names in place of their runs."""
    words, found = re.split("[\x20\x09-\x0d]+", text or ""), []
    for place, word in enumerate(words):
        before = words[place - 1] if place else ""
        ahead = words[place - 2] if place > 1 else ""
        stop = "\"'`,;()<>"
        value = ""
        here = re.search(f"(?i){NAMES}[^=:]{{0,64}}[=:]+[\"'`]*([^{stop}]{{8,}})", word)
        telling = re.search(f"(?i){NAMES}", before) or (len(before) <= 2 and re.search(f"(?i){NAMES}", ahead))
        if here:
            value = here[1]
        elif telling and before.rstrip("\"'`")[-1:] in ("=", ":"):
            there = re.match(f"[\"'`(<]*([^{stop}]{{8,}})", word)
            value = there[1] if there else ""
        runs = [x for x in re.findall("[A-Za-z0-9+/_-]+", word) if len(x) >= 12 and re.search("[0-9]", x)]
        found += [(place, x) for x in [value] * bool(value) + [x for x in runs if x not in value]]
    return found


def planted_secrets(spark):
    """Documents with keys of self-deciding formats, keys of other formats, and look-alikes, all marked by kind."""
    rng, letters, digits = random.Random(3), "abcdefghijklmnopqrstuvwxyz", "0123456789"
    words = ["".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(80)]

    def draw(signs, n):
        return "".join(rng.choices(signs, k=n))

    mixed = letters + letters.upper() + digits + "+/"
    known = [
        lambda: f'token = "{draw("0123456789abcdef", 40)}"',
        lambda: f"SECRET_KEY='{draw('0123456789ABCDEF', 64)}'",
        lambda: f"auth: {'AKIA' + draw(letters.upper() + digits, 16)}",
        lambda: f"use ghp_{draw(letters + digits, 36)} here",
        lambda: f"Bearer: eyJ{draw(mixed[:62], 20)}.eyJ{draw(mixed[:62], 40)}.{draw(mixed[:62], 30)}",
        lambda: f'api_key = "{draw(mixed, 32)}"',
    ]
    other = [
        lambda: f'password = "{draw(letters + letters.upper(), 14)}"',
        lambda: f"PASSWORD={draw(letters, 6)}!{draw(letters, 5)}$%{draw(letters.upper(), 4)}",
        lambda: f"secret: {draw(mixed[:52], 24)}",
        lambda: f'api-token: "{"-".join(draw(letters.upper() + digits, 5) for _ in range(5))}"',
    ]
    clean = [
        lambda: draw(digits, 16),
        lambda: f"see 2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T10:{rng.randint(10, 59)}",
        lambda: f"src/{'/'.join(rng.sample(words, 4))}2.py",
        lambda: f"{'_'.join(rng.sample(words, 3))}_{rng.randint(1, 99)}",
        lambda: f"id = {draw(digits, 14)}",
    ]
    kinds = {"known": known, "other": other, "clean": clean}
    rows = []
    for n in range(600):
        kind = ("known", "other", "clean")[n % 3]
        text = " ".join([*rng.sample(words, 12), rng.choice(kinds[kind])(), *rng.sample(words, 12)])
        rows.append((n, text, "en", f"{kind}/src", len(text)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_secret_candidates_against_brute_force(spark, corpus, edges):
    tricky = ["key", "key= key:", "password : " + "x" * 9, "a = secret_value_1", "key=" + "key" * 5000, "key" * 5000, "KEY==`abcdefgh1`", "token:short12 api = 'no'"]
    tricky = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    for docs in (corpus, edges, planted_secrets(spark), tricky):
        want = [(i, *x) for i, text in texts_of(docs) for x in brute_findings(text)]
        got = secrets.candidates(docs).select("doc_id", "place", "finding").collect()
        assert bag(got) == sorted(want, key=repr)


def test_secret_forest_finds_formats_it_has_no_label_for(spark):
    docs = planted_secrets(spark)
    found = secrets.featured(docs)
    labelled = {r["doc_id"] for r in secrets.weak_labels(found).filter("secret = 1").collect()}
    assert {i % 3 for i in labelled} == {0}
    hits = {r["doc_id"] for r in secrets.secrets(docs.withColumn("path", F.lit("x")).withColumn("word", F.lit("y"))).filter("is_secret").collect()}
    share = [sum(i % 3 == kind for i in hits) / 200 for kind in range(3)]
    assert share[0] >= 0.95
    assert share[1] >= 0.9
    assert share[2] <= 0.05


def test_secret_labels_given_with_clashing_columns(spark):
    docs = planted_secrets(spark)
    named = secrets.candidates(docs).select("doc_id", "place", "finding", F.when(F.col("path") == "clean/src", 0).otherwise(1).alias("secret"))
    extra = named.select("*", *[F.lit("x").alias(c) for c in ("path", "word", "score", "before")])
    got, want = (bag(secrets.secrets(docs, x).select("doc_id", "finding", "is_secret").collect()) for x in (extra, named))
    assert got == want
    assert sum(r[2] != (r[0] % 3 != 2) for r in got) <= 0.05 * len(got)


def test_secret_forest_separates_and_is_native(corpus, edges, nothing):
    found = secrets.secrets(corpus.unionByName(edges.select(corpus.columns)))
    rows = found.collect()
    assert all(r["is_secret"] == bool(re.fullmatch("[0-9a-f]{40}", r["finding"])) for r in rows if r["finding"] != "abc-123-def-456")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert secrets.secrets(nothing).count() == 0


def test_secret_labels_of_one_kind_or_none(spark, edges):
    found = secrets.featured(edges)
    labels = spark.createDataFrame([], "doc_id long, place int, finding string, secret int")
    assert {r["score"] for r in secrets.secrets(edges, labels).collect()} == {0.5}
    one = found.limit(1).select("doc_id", "place", "finding", F.lit(1).alias("secret"))
    assert {r["score"] for r in secrets.secrets(edges, one).collect()} == {1.0}


# Language model


def brute_model(rows, order, weights=None):
    split = {i: zlib.crc32(str(i).encode()) % 7 if i is not None else -1 for i, _ in rows}
    tokens = [(i, re.findall(WORDS, lowered(t)) + ["</s>"]) for i, t in rows]
    train = [(i, w) for i, w in tokens if split[i] not in (-1, 2)]

    def counted(chosen):
        grams = [{} for _ in range(order + 1)]
        for _, own in chosen:
            padded = ["<s>"] * (order - 1) + own
            for t in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    g = tuple(padded[t - k + 1 : t + 1])
                    grams[k][g] = grams[k].get(g, 0) + 1
        return grams

    return tokens, split, counted(train), counted([x for x in train if split[x[0]] != 3]), len(train)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_interpolation_against_brute_force(spark, corpus, edges, order, monkeypatch):
    docs = corpus.filter("doc_id < 60").select("doc_id", "text").unionByName(edges.select("doc_id", "text").filter("doc_id is null or doc_id not in (7)"))
    rows = texts_of(docs)
    tokens, split, grams, _, starts = brute_model(rows, order)
    seen = {}
    learned = interpolation.learned_weights

    def kept(*a):
        seen["weights"] = learned(*a)
        return seen["weights"]

    monkeypatch.setattr(interpolation, "learned_weights", kept)
    got = interpolation.scored(docs, order).collect()
    weights = seen["weights"]
    np.testing.assert_allclose(weights.sum(axis=1), 1)
    total, distinct = sum(grams[1].values()), len(grams[1])
    want = []
    for i, own in tokens:
        base = sum(np.log10((grams[1].get((w,), 0) + 1) / (total + distinct + 1)) for w in own)
        score, padded = 0.0, ["<s>"] * (order - 1) + own
        for t in range(order - 1, len(padded)):
            parts = [1 / (distinct + 1)]
            context = total
            for k in range(1, order + 1):
                g = tuple(padded[t - k + 1 : t + 1])
                if k > 1:
                    before = g[:-1]
                    context = starts if set(before) == {"<s>"} else grams[k - 1].get(before, 0)
                parts.append(grams[k].get(g, 0) / context if context else 0.0)
            bucket = min(31, int(np.log2(context)) + 1) if context else 0
            score += np.log10(np.dot(weights[bucket], parts))
        want.append((i, split[i] == 2, len(own), sum((w,) in grams[1] for w in own), total, round(base, 6), round(score, 6)))
    got = [(*tuple(r)[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in got]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert a[:5] == b[:5]
        np.testing.assert_allclose(a[5:], b[5:], rtol=1e-6)


def test_interpolation_beats_the_base_on_held_out_text(corpus):
    rows = interpolation.scored(corpus).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_weights_maximise_held_out_likelihood():
    cells = np.array([(5 * (interpolation.GRID + 1) + a) * (interpolation.GRID + 1) + b for a, b in ((100, 120), (110, 0), (0, 0))])
    n = np.array([50.0, 30.0, 5.0])
    made = interpolation.learned_weights(cells, n, 2, 1e-6)[5]

    def likelihood(w):
        p = lambda x: 10.0 ** ((x - interpolation.GRID) / 12) if x else 0.0
        return sum(m * np.log(w @ [1e-6, p(a), p(b)]) for (a, b), m in zip(((100, 120), (110, 0), (0, 0)), n))

    other = np.random.default_rng(3).dirichlet([1, 1, 1], 400)
    assert likelihood(made) >= max(map(likelihood, other)) - 0.5


def test_interpolation_without_training(spark, nothing):
    assert interpolation.scored(nothing).count() == 0
    one = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    row = interpolation.scored(one).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["score"]) == (3, 0, 0, 0.0)


# Line dedup


def brute_lines(rows):
    holders, out = {}, []
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = lowered(line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 10 and i is not None:
                holders.setdefault(key, set()).add(i)
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            own = holders.get(lowered(line.strip(" \t\n\x0b\x0c\r")), ())
            if len(own) < 2 or i is None or i == min(own):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_against_brute_force(edges, corpus, nothing):
    for docs in (edges, corpus):
        assert bag(line_dedup.digest(line_dedup.deduplicated(docs)).collect()) == brute_lines(texts_of(docs))
    assert line_dedup.deduplicated(nothing).count() == 0


def test_lines_can_be_taken_back(spark, corpus):
    own = corpus.select("doc_id", "text").filter("doc_id < 120").cache()
    old, new, gone = own.filter("doc_id % 3 = 0"), own.filter("doc_id % 3 > 0"), own.filter("doc_id % 3 = 1")
    store = line_dedup.LineStore.create(spark, shared_path(spark, "lines-test"), 4)
    store.insert(old)
    totals = store.insert(new)
    fresh = line_dedup.LineStore.create(spark, shared_path(spark, "lines-test"), 4)
    want = fresh.insert(own)
    keys = new.transform(line_dedup.references).select("hi", "lo").distinct()
    assert bag(totals.collect()) == bag(want.join(keys, ["hi", "lo"], "left_semi").select(totals.columns).collect())
    store.insert(new)  # a repeated insert changes nothing
    assert bag(store.counts().collect()) == bag(fresh.counts().collect())
    store.delete(gone)
    fresh = line_dedup.LineStore.create(spark, shared_path(spark, "lines-test"), 4)
    fresh.insert(own.filter("doc_id % 3 != 1"))
    assert bag(store.counts().collect()) == bag(fresh.counts().collect())
    asked = store.probe(line_dedup.references(own).select(F.pmod("hi", F.lit(store.shards)).cast("int").alias("shard"), "hi", "lo").distinct())
    held = asked.join(store.counts(), ["shard", "hi", "lo"], "left")
    assert held.filter("n_docs is not null and not perhaps").count() == 0
    assert held.filter("n_docs is null and perhaps").count() <= 2
    sizes = {r["shard"]: CuckooFilter.from_bytes(r["cells"]).items for r in store.filters().collect()}
    assert sizes == {r["shard"]: r["count"] for r in store.counts().groupBy("shard").count().collect()}


def test_later_batches_ask_the_filters(spark, corpus, monkeypatch):
    asked = []
    probe = line_dedup.LineStore.probe
    monkeypatch.setattr(line_dedup.LineStore, "probe", lambda self, keys: asked.append(self.version) or probe(self, keys))
    for batches, versions in ((1, []), (4, [1, 2, 3])):
        asked.clear()
        found = line_dedup.digest(line_dedup.deduplicated(corpus, batches=batches))
        assert bag(found.collect()) == brute_lines(texts_of(corpus)) and asked == versions
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 3)
    assert bag(line_dedup.digest(line_dedup.deduplicated(corpus)).collect()) == brute_lines(texts_of(corpus))


def test_cuckoo_filter():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    made = filled(keys[:10_000])
    assert made.contains(keys[:10_000]).all() and made.contains(keys[10_000:]).mean() < 0.001
    made.delete(keys[:5_000])
    assert made.contains(keys[5_000:10_000]).all() and made.contains(keys[:5_000]).mean() < 0.001
    assert CuckooFilter.from_bytes(made.to_bytes()).items == made.items == 5_000
    assert filled(keys[:0]).contains(keys[:3]).tolist() == [False] * 3


# Pages


def test_pages_of_the_corpus(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_templates.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        blocks = re.split("</?(?:p|h1|br|li|ul|article)>", article)
        want = (" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks)
        assert got[r["page_id"]] == " ".join(b for b in want if b)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>
<header>Site head</header><div id="top-nav"><a href="/">Home</a></div><div class="x1"><p>Site slogan</p></div>
<div class="cookie-notice">We use cookies</div><article><h1>Title {n}</h1><p>Caf&eacute; &amp; <b>bo</b>ld {n}<br>next
 line<p>unclosed {n}<ul><li>one<li>two</ul><div class="qq">Read our other sites</div><aside>side</aside>
<form><input>Send</form><div class="comments"><p>reader says</p></div><p>last {n} &lt;tag&gt;</article>
<section class="comments"><article>reply</article></section><footer>foot</footer>"""


def test_page_templates_and_furniture(spark):
    rows = [(n, f"http://User@Host.example:80/{n}", PAGE.format(n=n)) for n in range(8)]
    rows += [(100, "http://other.example/", "<p>plain <i>te</i>xt</p><script>x"), (101, None, None), (102, "", ""), (103, "u", "a < b &copy; <b>c")]
    rows += [(100, "http://other.example/", "<p>plain <i>te</i>xt</p><script>x")]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, host string, gone string")
    got = [(r["page_id"], r["text"]) for r in html_templates.main_text(pages).collect()]
    want = [(n, f"Title {n} Café & bold {n} next line unclosed {n} one two last {n} <tag>") for n in range(8)]
    want += [(100, "plain text"), (100, "plain text"), (101, ""), (102, ""), (103, "a < b © c")]
    assert sorted(got) == sorted(want)
    assert html_templates.main_text(pages.limit(0)).count() == 0


def test_repeated_article_is_no_template(spark):
    one = PAGE.format(n=1)
    pages = spark.createDataFrame([(i, "http://h.example/", one) for i in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in html_templates.main_text(pages).collect()} == {
        "Title 1 Café & bold 1 next line unclosed 1 one two Read our other sites last 1 <tag>"
    }


def test_names_inside_articles(spark):
    names = ["discussion", "alert", "search-result", "social-history", "related-work", "widget"]
    parts = ["comments", "comment-list", "ad", "ad-slot", "share-buttons", "x newsletter-box", "cookie-notice"]
    html = "<article>" + "".join(f'<div class="{n}">{n}</div>' for n in names + parts) + "<p>Let <math><mi>x</mi></math> be</article>"
    html += '<div class="related-work">outside</div>'
    pages = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    assert html_templates.main_text(pages).first()["text"] == " ".join([*names, "Let x be"])


@pytest.mark.parametrize("size", [5, 400])
def test_a_box_on_five_articles_goes_at_every_size_of_the_host(spark, size):
    box, nested = "<div>Read <b>more</b> here</div>", "<section><div>inner</div><p>own {n}</p></section>"
    rows = [(n, "http://h/", f"<article><p>a{n}{box if n < 5 else ''}{nested.format(n=n)}z</article>") for n in range(size)]
    rows += [(1000 + n, "http://i/", f"<article><p>b{n}{box if n < 4 else ''}</article>") for n in range(9)]
    rows += [(2000 + n, "http://j/", f"<body><ul><li>Home</ul><p>c{n}") for n in range(6)]
    got = {r["page_id"]: r["text"] for r in html_templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {
        **{n: f"a{n} own {n} z" for n in range(size)},
        **{1000 + n: f"b{n} Read more here" if n < 4 else f"b{n}" for n in range(9)},
        **{2000 + n: f"c{n}" for n in range(6)},
    }


def test_unclosed_tags_take_linear_time():
    start = time.perf_counter()
    html_templates.parse("<b>x</i>" * 40_000)
    html_templates.parse("<article>" + "<span><div>x</p></em>" * 20_000)
    assert time.perf_counter() - start < 5


# SimHash


def brute_print(text):
    own = re.findall(WORDS, lowered(text))
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
    hashed = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if hashed and sum(h >> b & 1 for h in hashed) * 2 > len(hashed))


def brute_components(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, prints):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, f"{p:016x}", least.get(g)) for g, (i, p) in zip(group, prints)), key=repr)


def test_simhash_against_brute_force(edges, corpus, nothing):
    small = edges.filter("doc_id is null or doc_id not in (7)")
    assert bag(simhash.near_duplicates(small).collect()) == brute_components(texts_of(small))
    assert bag(simhash.near_duplicates(corpus).collect()) == brute_components(texts_of(corpus))
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_links_are_exact_in_crowded_blocks(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    chance = np.random.default_rng(5)
    prints = {int(x) for x in chance.integers(0, 2**63, 6)}
    for x in list(prints):
        for _ in range(25):
            x ^= 1 << int(chance.integers(64))
            prints.add(x)
    prints = sorted(p - 2**64 if p >> 63 else p for p in prints)
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "print long")).collect()
    mask = 2**64 - 1
    want = [(a, b) for a, b in itertools.combinations(prints, 2) if ((a ^ b) & mask).bit_count() <= 2]
    assert bag(got) == sorted(want, key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 50), (50, 70), (7, 7), (1, 2)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert bag(got) == sorted([(i, 1) for i in range(1, 31)] + [(i, 50) for i in (50, 70, 100)], key=repr)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# Decontamination


def test_planted_benchmark_items(spark, sf_dir, corpus):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect()
    clean = "zuk vopel tarn ".split() * 40
    rows, want = [], set()
    for n, r in enumerate(items):
        own = r["text"].split()
        edited = [w if i % 9 else "edited" for i, w in enumerate(own)]
        edited = [w for i, w in enumerate(edited) if i % 13 != 6]
        loud = " ".join(w.upper() + "!!" for w in own)
        for k, text in enumerate((" ".join(own), " ".join(edited), loud, " ".join(own[: len(own) // 4]))):
            rows.append((n * 10 + k, " ".join(clean[: n + k]) + " " + text + " " + " ".join(clean)))
            if k < 3:
                want.add((n * 10 + k, r["item_id"]))
    rows += [(10_000, None), (10_001, ""), (None, items[0]["text"]), (10_002, " ".join(clean) * 50)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(r["item_id"], r["text"], "x") for r in items] + [(9_000, None, "x"), (9_001, "", "x"), (9_002, "...", "x")], "item_id long, text string, doc_id string")
    found = decontamination.contaminated(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert want <= got and (None, items[0]["item_id"]) in got
    exact = {(r["doc_id"], r["item_id"]): r for r in found}
    for n, r in enumerate(items):
        hit = exact[n * 10, r["item_id"]]
        own = decontamination.bare_words(r["text"])
        assert hit["score"] == 1.0 and hit["first_word"] == n and hit["last_word"] == n + len(own) - 1
    assert not any(i is not None and (i % 10 == 3 or i >= 10_000) for i, _ in got)
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_found_items_against_brute_force(spark, sf_dir, corpus):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r["item_id"], decontamination.bare_words(r["text"])) for r in bench.collect()]
    want = set()
    for i, text in texts_of(corpus):
        own = decontamination.bare_words(text)
        want |= {(i, k) for k, item in items if decontamination.align(item, own)[0] >= decontamination.THRESHOLD}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(corpus, bench).collect()} == want


@pytest.mark.parametrize("every", [4, 5])
@pytest.mark.parametrize("copies", [0, 3])
def test_edited_items_against_brute_force(spark, every, copies):
    chance = np.random.default_rng(every)
    items = [(n, [f"w{n}x{i}" for i in range(size)]) for n, size in enumerate((15, 16, 24, 48, 59))]
    rows = []
    for n, own in items:
        rows.append([w if (i + 1) % every else "edited" for i, w in enumerate(own)])
        for _ in range(20):
            gone = chance.random(len(own)) < 1 / every
            rows.append([f"e{chance.integers(9)}" if g else w for w, g in zip(own, gone)])
        rows += [own] * copies
    want = {(i, n) for i, r in enumerate(rows) for n, own in items if decontamination.align(own, r)[0] >= decontamination.THRESHOLD}
    assert len(want) > 80
    docs = spark.createDataFrame([(i, "zuk vopel tarn " * 9 + " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(own)) for n, own in items], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()} == want


def test_single_seeds_do_not_depend_on_the_size_of_the_corpus(spark, monkeypatch):
    """A copy held together by one n-gram is found however many documents hold that n-gram."""
    item = [f"w{i}" for i in range(7)]
    copy = "w0 x1 w2 w3 w4 x5 w6"
    assert decontamination.align(item, copy.split())[0] >= decontamination.THRESHOLD
    assert len(set(decontamination.item_grams(item)) & set(decontamination.item_grams(copy.split()))) == 1
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    for many in (1, 1500):
        rows = [(0, copy), *((i, f"zuk w2 w3 w4 vopel") for i in range(1, many))]
        found = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
        assert [(r["doc_id"], r["item_id"]) for r in found] == [(0, 7)]
    assert decontamination.rare_grams([1, 2, 3, 4], {1: 5, 2: 9, 3: 9}, 0.5) == {1, 2, 3}


def test_alignment_against_the_full_matrix():
    chance = np.random.default_rng(2)
    for _ in range(60):
        a = [str(x) for x in chance.integers(0, 5, chance.integers(1, 12))]
        b = [str(x) for x in chance.integers(0, 5, chance.integers(1, 20))]
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, first, stop = decontamination.align(a, b)
        assert score * 2 * len(a) == pytest.approx(h.max())
        if h.max():
            assert decontamination.align(a, b[first:stop])[0] == pytest.approx(score)


# Top-k


def brute_top(rows, k):
    own = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in own:
        if q % 50 == 0:
            score = [(-max(-(2**61), min(2**61, sum(x * y for x, y in zip(a, b)))), i) for i, b in own if i != q and len(a) == len(b)]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(score)[:k])]
    return sorted(out)


@pytest.mark.parametrize("chunk", [7, 2048])
def test_top_k_against_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "BLOCK", 3)
    chance = np.random.default_rng(4)
    rows = [(i, [float(x) for x in chance.integers(-2, 3, 4) / 2]) for i in range(220)]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)]  # ties
    rows += [(400, None), (450, [1.0, None, 0.0, 0.0]), (500, [float("nan")] * 4), (550, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, [1.0] * 4), (600, []), (650, [1.0, 2.0]), (651, [3.0, 4.0]), (301, [9.0, 9.0, 9.0, 9.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5).collect()
    assert bag(got) == sorted(brute_top(rows, 5), key=repr)
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [1e9, 3.0]), (3, [-1e30, 1.0]), (4, [1e30, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(vectors, vectors.filter("vec_id = 0"), 2).collect()
    assert [tuple(r)[:3] for r in sorted(got)] == [r[:3] for r in brute_top(rows, 2)]


# Byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    made = {t: i for i, t in enumerate(tokens)}
    return tokens, tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=made, special_tokens={})


def test_bpe_equals_the_library(edges, corpus, nothing, ranks):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for docs in (edges, corpus):
        got = byte_bpe.encoded(docs, path, public_tokenizers.PATTERN)
        want = [(i, np.array(ranks[1].encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in texts_of(docs)]
        assert bag([(r[0], bytes(r[1]), bytes(r[2])) for r in got.collect()]) == sorted(want, key=repr)
    assert byte_bpe.encoded(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_random_bytes_and_long_pieces(ranks, monkeypatch):
    encoder = byte_bpe.Encoder(ranks[0], public_tokenizers.PATTERN)
    chance = np.random.default_rng(6)
    texts = ["".join(chance.choice(list("abe \n\t.é日!1")) for _ in range(chance.integers(0, 90))) for _ in range(300)]
    texts += ["ab" * 3000, "a" * 5001, "the" * 700, "!?" * 300, " " * 500, "\n " * 40, "e" * 65]
    for wide in (64, 2):
        monkeypatch.setattr(byte_bpe, "WIDE", wide)
        encoder = byte_bpe.Encoder(ranks[0], public_tokenizers.PATTERN)
        ids, bounds = encoder.encode(pa.array(texts))
        for t, a, b in zip(texts, bounds, bounds[1:]):
            assert ids[a:b].tolist() == ranks[1].encode_ordinary(t)
            assert encoder.decode(ids[a:b]).decode() == t


# Token files


def test_token_files_round_trip(spark, edges, corpus, nothing):
    path = public_tokenizers.path(WORD_TOKENIZER)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    for docs in (edges, corpus):
        root = shared_path(spark, "token-test")
        shards = token_files.write(docs, root, path, END_ID).orderBy("shard").collect()
        got = token_files.read(spark, root).collect()
        tied = [(r[0], r[1]) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy("doc_id", "h", "text").collect()]
        want, start = [], 0
        for i, text in tied:
            ids = [*library.encode(text or "", add_special_tokens=False).ids, END_ID]
            want.append((i, start, len(ids), np.array(ids, "<u4").tobytes()))
            start += len(ids)
        assert bag([(*tuple(r)[:3], bytes(r[3])) for r in got]) == sorted(want, key=repr)
        assert sum(s["tokens"] for s in shards) == start and shards[0]["first_token"] == 0
        assert all(b["first_token"] == a["first_token"] + a["tokens"] for a, b in zip(shards, shards[1:]))
        assert {s["kind"] for s in shards} == {"<u2"}
    root = shared_path(spark, "token-test")
    assert token_files.write(nothing, root, path, END_ID).count() == 0
    assert token_files.read(spark, root).count() == 0


# Pipeline


def test_pipeline_against_brute_force(spark, sf_dir, corpus, ranks, monkeypatch):
    docs = {i: t for i, t in texts_of(corpus)}
    found = corpus_pipeline.run(spark, sf_dir).collect()
    model = language_crf.train(*language_crf.sample(corpus.filter(language_crf.fold(5) != 0)))
    lang = {r["doc_id"]: r for r in language_crf.predicted(corpus, model).collect()}
    docs = {i: t for i, t in docs.items() if lang[i]["lang_pred"] != "und" and lang[i]["score"] >= corpus_pipeline.LEAST_LANGUAGE}
    holders = {}
    keyed = {i: [(line, lowered(line.strip(" \t\n\x0b\x0c\r"))) for line in t.split("\n")] for i, t in docs.items()}
    for i, lines in keyed.items():
        for _, key in lines:
            holders.setdefault(key, set()).add(i)
    docs = {i: "\n".join(x for x, k in lines if len(k) < 10 or i == min(holders[k])) for i, lines in keyed.items()}
    kept = {c for _, _, c in brute_components(list(docs.items()))}
    items = [decontamination.bare_words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = {i: docs[i] for i in kept}
    docs = {i: t for i, t in docs.items() if all(decontamination.align(x, decontamination.bare_words(t))[0] < decontamination.THRESHOLD for x in items)}
    want = [(i, np.array(ranks[1].encode_ordinary(t), "<u4").tobytes(), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs.items()]
    assert sorted((r["doc_id"], bytes(r["ids"]), r["decoded_sha256"]) for r in found) == sorted(want)


DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_deduplication_against_brute_force(spark, sf_dir):
    chance = np.random.default_rng(8)
    rows = []
    for n in range(12):
        own = [f"w{x}" for x in chance.integers(0, 5000, 120)]
        for k in range(5):
            edited = list(own)
            for at in chance.choice(120, k, replace=False):
                edited[at] = "edited"
            rows.append((n * 5 + k, " ".join(edited)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    want = {min(i for i, g in enumerate(group) if g == own) for own in group}
    assert 12 <= len(want) < 40
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC)
    assert {r["doc_id"] for r in corpus_pipeline.near_deduplication(spark, docs, sf_dir).collect()} == want


def test_rows_without_or_with_shared_ids_are_judged_by_text(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    clean = [" ".join(f"{k}{i}" for i in range(40)) for k in "abcd"]
    rows = [(None, clean[0]), (None, clean[1]), (None, clean[1]), (7, clean[2]), (7, clean[3]), (8, clean[2]), (None, item), (7, item)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC)
    left = corpus_pipeline.near_deduplication(spark, docs, sf_dir)
    assert bag(left.select("doc_id", "text").collect()) == sorted([(None, clean[0]), (None, clean[1]), (7, clean[2]), (7, clean[3]), (7, item)], key=repr)
    left = corpus_pipeline.benchmark_decontamination(spark, docs, sf_dir)
    assert bag(left.select("doc_id", "text").collect()) == sorted(rows[:6], key=repr)


def test_pipeline_stages_handle_edges(spark, sf_dir, edges, nothing):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edges, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir).cache()
            docs.count()
            if stage is not corpus_pipeline.byte_tokens:
                assert docs.columns == names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
