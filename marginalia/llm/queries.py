"""The registered queries of this package, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import (
    byte_bpe,
    decontamination,
    dual_tree,
    factor_machine,
    html_templates,
    interpolation,
    language_crf,
    line_dedup,
    manifest,
    secrets,
    simhash,
    token_files,
    topk,
)
from marginalia.llm.arrow import shared_path

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 2
TOP_K = 5
BEST_DOCUMENTS = 20
QUERY_STEP = 50


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose fold of 5 is not 0."""
    docs = _read(spark, sf_dir, "documents")
    model = language_crf.train(*language_crf.sample(docs.filter(language_crf.fold(5) != 0)))
    found = language_crf.predicted(docs, model)
    held = F.coalesce(language_crf.fold(5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_words")


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret candidate with the forest's verdict; the finding itself only as a hash."""
    found = secrets.secrets(_read(spark, sf_dir, "documents"))
    size = F.length("finding").cast("long").alias("n_chars")
    return found.select("doc_id", "place", F.sha2("finding", 256).alias("finding_sha256"), size, "score", "is_secret")


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document."""
    return interpolation.scored(_read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document's lines."""
    return line_dedup.digest(line_dedup.deduplicated(_read(spark, sf_dir, "documents")))


def op5_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_templates.main_text(_read(spark, sf_dir, "pages"))
    return found.select("*", F.length("text").cast("long").alias("n_chars"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the aligned words."""
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_topk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0), TOP_K)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the bytes they decode to, as hashes."""
    docs = _read(spark, sf_dir, "documents")
    return byte_bpe.digest(byte_bpe.encoded(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from the files."""
    root = shared_path(spark, "tokens")
    token_files.write(_read(spark, sf_dir, "documents"), root, public_tokenizers.path(WORD_TOKENIZER), END_ID)
    return token_files.read(spark, root).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of every benchmark item."""
    return dual_tree.ranked(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), BEST_DOCUMENTS)


def op12_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of those whose fold of 4 is not 2."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = factor_machine.learned(docs, labels.filter(factor_machine.fold(4) != 2))
    held = F.coalesce(factor_machine.fold(4) == 2, F.lit(False))
    return factor_machine.scored(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, verified against rows of which a third were lower-cased."""
    docs = _read(spark, sf_dir, "documents")
    changed = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    fields = [changed if c == "text" else F.col(c) for c in manifest.FIELDS]
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest.verified(manifest.manifest(docs.withColumn("found_digest", F.when(touched, manifest.digest(fields)))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_crf,
        op2_secret_forest,
        op3_deleted_interpolation,
        op4_line_dedup,
        op5_html_templates,
        op6_simhash,
        op7_decontamination,
        op8_topk_histogram,
        op9_byte_bpe,
        op10_token_files,
        op11_dual_tree,
        op12_factor_machine,
        op13_merkle_manifest,
    )
}

_A_TO_Z = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"


def _climb(name: str, keys: str, levels: int) -> str:
    """The levels above ``{name}0`` (tree, i, h), and for every row of ``{name}row`` (keys, tree, i, h, f) its way up as ``{name}up``."""
    parts, way = [], f"{name}row"
    for n in range(levels):
        parts.append(f"""{name}k{n} AS (
            SELECT tree, i // 8 AS i, list(h ORDER BY i) AS kids FROM {name}{n} GROUP BY ALL
        ), {name}{n + 1} AS (
            SELECT tree, i, CASE WHEN i = 0 AND len(kids) = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS h FROM {name}k{n}
        ), {name}w{n} AS (
            SELECT r.* EXCLUDE (i, f, proof), r.i // 8 AS i, k.i = 0 AND len(kids) = 1 AS done,
                array_to_string(kids[:(r.i % 8)], '') AS a, array_to_string(kids[(r.i % 8) + 2:], '') AS b, r.f AS g, r.proof AS p
            FROM {way} r JOIN {name}k{n} k ON r.tree = k.tree AND r.i // 8 = k.i
        ), {name}x{n} AS (
            SELECT {keys}, tree, i, CASE WHEN done THEN g ELSE sha256(a || g || b) END AS f,
                CASE WHEN done THEN p ELSE p || a || b END AS proof
            FROM {name}w{n}
        )""")
        way = f"{name}x{n}"
    return ", ".join([*parts, f"{name}up AS (SELECT * FROM {way})", f"{name}top AS (SELECT * FROM {name}{levels})"])


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in fields) + ")"


# Fixed value: the characters of terms.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL: dict[str, str] = {
    "op11_dual_tree": f"""
        WITH words AS (
            SELECT row_number() OVER () AS d, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '{_TERM}') AS terms
            FROM documents
        ),
        sizes AS (SELECT d, doc_id, len(terms) AS n FROM words WHERE len(terms) > 0),
        total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS length FROM sizes),
        tf AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(terms) AS term FROM words) GROUP BY ALL),
        df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
        weights AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total
        ),
        asked AS (
            SELECT q, item_id, term, count(*)::BIGINT AS times FROM (
                SELECT row_number() OVER () AS q, item_id,
                    unnest(regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '{_TERM}')) AS term
                FROM benchmark
            ) GROUP BY ALL
        ),
        scored AS (
            SELECT q, item_id, d, doc_id, sum(
                times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // length)))
            )::BIGINT AS score
            FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (d), total
            GROUP BY ALL
        )
        SELECT item_id, rank::INT AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
        ) WHERE rank <= {BEST_DOCUMENTS}
    """,
    "op13_merkle_manifest": f"""
        WITH docs AS (
            SELECT *, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda x, y: list_reduce(
                    list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda u, v: xor(u >> 1, 3988292384 * (u & 1))
                )
            ) AS crc
            FROM documents
        ),
        leaves AS (
            SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("text")} AS leaf,
                CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN {_leaf(f"translate(text, {_A_TO_Z})")} END AS changed
            FROM docs
        ),
        placed AS (
            SELECT *, row_number() OVER () AS own, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
            FROM leaves
        ),
        l0 AS (SELECT tree, i, leaf AS h FROM placed),
        lrow AS (SELECT own, tree, i, coalesce(changed, leaf) AS f, '' AS proof FROM placed),
        {_climb("l", "own", 10)},
        r0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h FROM ltop),
        rrow AS (
            SELECT own, u.tree AS name, 0 AS tree, t.i, u.f, u.proof
            FROM lup u JOIN (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS i FROM ltop) t USING (tree)
        ),
        {_climb("r", "own, name", 4)}
        SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, sha256(u.proof) AS proof_sha256, u.f AS folded_root, u.f = t.h AS verified
        FROM rup u JOIN placed p USING (own) JOIN ltop s ON s.tree = u.name, rtop t
    """,
    "op4_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, row_id, i, line,
                translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (
                SELECT doc_id, row_id, unnest(parts) AS line, unnest(range(len(parts))) AS i
                FROM (
                    SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS parts
                    FROM documents
                )
            )
        ),
        shared AS (
            SELECT key, min(doc_id) AS first_doc FROM lines
            WHERE length(key) >= 10 AND doc_id IS NOT NULL
            GROUP BY key HAVING count(DISTINCT doc_id) > 1
        ),
        marked AS (
            SELECT l.*, coalesce(l.doc_id > s.first_doc, false) AS gone FROM lines l LEFT JOIN shared s USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY row_id, doc_id
    """,
    "op8_topk_histogram": f"""
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM usable q JOIN usable c ON q.vec_id != c.vec_id
            WHERE q.vec_id % {QUERY_STEP} = 0
        )
        SELECT query_id, rank::INT AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        ) WHERE rank <= {TOP_K}
    """,
}
