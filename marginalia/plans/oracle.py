"""The same results as ``catalog.py`` in DuckDB SQL, for the correctness check."""

from __future__ import annotations

from marginalia.operators.ocr import LANGUAGE_CODES
from marginalia.operators.summarize import STOPWORDS
from marginalia.plans.catalog import SEARCH_QUERY
from marginalia.plans.derive import EXTENSIONS
from marginalia.sources import formats as fm


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


# Sentences of a text, by a control character put after every sentence mark.
def _sentences(text: str) -> str:
    return (
        f"list_filter(string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
        "lambda s: trim(s) <> '')"
    )


LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '')"
ALNUM = "length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))"

# Admitted documents, and their evidence: one chunk each, since no text has a blank line.
EVIDENCE = f"""
lib AS (
  SELECT doc_id, 'doc_' || doc_id AS document_id, source AS document_name, text, {LINES} AS ls
  FROM documents WHERE {ALNUM} >= 20
),
ev AS (
  SELECT 'ev_' || doc_id || '_0001' AS id, document_id, document_name, 'Imported content' AS section,
         CAST(1 AS INTEGER) AS page, CAST(1 AS INTEGER) AS line_start, CAST(len(ls) AS INTEGER) AS line_end,
         array_to_string(ls, ' ') AS snippet, doc_id * 1000000 + 1 AS seq, doc_id
  FROM lib
)
"""


# The newest version of every document after edits, deletions and restorations.
VERSIONS = """versions AS (
  SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN translate(text, 't', 'T')
    WHEN doc_id % 3 = 0 THEN translate(text, 'aeiou', 'AEIOU') ELSE text END AS text
  FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 <> 0
), """ + EVIDENCE.replace("FROM documents ", "FROM versions ")


def _chunk_cte(pages: str, name: str = "chunks") -> str:
    """Greedy chunks of ``pages`` (doc_id, page, ls: one paragraph per line, at odd line numbers)."""
    return f"""
sums AS (
  SELECT doc_id, page, ls, len(ls) AS n,
         list_prepend(0, list_transform(range(1, len(ls) + 1),
           lambda i: list_sum(list_transform(ls[1:i], lambda l: len(regexp_split_to_array(l, '\\s+')))))) AS cs
  FROM ({pages})
),
fold(doc_id, page, part, a, e) AS (
  SELECT doc_id, page, 1, CAST(1 AS BIGINT), greatest(1, len(list_filter(cs[2:], lambda c: c <= 180))) FROM sums
  UNION ALL
  SELECT f.doc_id, f.page, f.part + 1, f.k,
         greatest(f.e + 1, len(list_filter(f.cs[2:], lambda c: c - f.cs[f.k] <= 180)))
  FROM (
    SELECT fold.*, s.cs, s.n,
           greatest(fold.a, len(list_filter(s.cs[1:fold.e], lambda c: s.cs[fold.e + 1] - c > 30)) + 1) AS k
    FROM fold JOIN sums s ON s.doc_id = fold.doc_id AND s.page = fold.page
    WHERE fold.e < s.n
  ) f
),
{name} AS (
  SELECT f.doc_id, f.page, f.part, f.a, f.e,
         row_number() OVER (PARTITION BY f.doc_id ORDER BY f.page, f.part) AS ordinal,
         CAST(2 * f.a - 1 AS INTEGER) AS line_start, CAST(2 * f.e - 1 AS INTEGER) AS line_end,
         array_to_string(s.ls[f.a:f.e], ' ') AS snippet
  FROM fold f JOIN sums s ON s.doc_id = f.doc_id AND s.page = f.page
)
"""


BUDGET = f"lib AS (SELECT * FROM documents WHERE {ALNUM} >= 20)," + _chunk_cte(
    f"SELECT doc_id, 1 AS page, {LINES} AS ls FROM lib"
)
PAGE_LISTS = """
  SELECT doc_id, source, CAST(p + 1 AS INTEGER) AS page,
         string_split(text, chr(10))[p * 10 + 1 : p * 10 + 10] AS ls
  FROM (SELECT doc_id, source, text, unnest(range(0, (len(string_split(text, chr(10))) - 1) // 10 + 1)) AS p FROM documents)
"""
PAGED = _chunk_cte(PAGE_LISTS)
EV_ID = "'ev_' || doc_id || '_' || lpad(CAST(ordinal AS VARCHAR), CAST(greatest(4, length(CAST(ordinal AS VARCHAR))) AS INTEGER), '0')"


def _score(terms: str) -> str:
    return (
        f"CAST(list_sum(list_transform({terms}, lambda t: CASE WHEN contains(lower(snippet), t) THEN 2 "
        "WHEN contains(lower(document_name || ' ' || section || ' ' || snippet), t) THEN 1 ELSE 0 END)) AS INTEGER)"
    )


KEY = "trim(regexp_replace(lower(snippet), '\\s+', ' ', 'g'))"


def _keyword(where_corpus: str = "TRUE", where_hits: str = "TRUE") -> str:
    """Hits of the single query, cut, scoped and deduplicated."""
    terms = _list(t for t in dict.fromkeys(SEARCH_QUERY.lower().split()) if len(t) > 2)
    return f"""WITH {EVIDENCE},
scored AS (SELECT *, {_score(terms)} AS match_score FROM ev WHERE {where_corpus}),
top AS (SELECT *, row_number() OVER (ORDER BY match_score DESC, seq) AS r FROM scored WHERE match_score > 0 QUALIFY r <= 12),
kept AS (SELECT *, {KEY} AS k FROM top WHERE {where_hits}),
once AS (SELECT * FROM kept WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY r) = 1)
SELECT CAST(row_number() OVER (ORDER BY r) AS INTEGER) AS rank, id, document_id, match_score, 0.74 AS score, snippet FROM once"""


GOOD = "document_id IN (SELECT 'doc_' || doc_id FROM labels WHERE quality = 1)"

QUESTIONS = """
questions AS (SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user'),
asked AS (
  SELECT query_id, query, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda t: length(t) > 2)) AS terms
  FROM questions
)
"""


def _batch_hits(evidence: str = "ev") -> str:
    return f"""
low AS (SELECT id, seq, lower(snippet) AS sl, lower(document_name || ' ' || section || ' ' || snippet) AS hl FROM {evidence}),
wanted AS (SELECT query_id, unnest(terms) AS t FROM asked),
vocabulary AS (SELECT DISTINCT t FROM wanted),
points AS (SELECT t, id, seq, CASE WHEN contains(sl, t) THEN 2 ELSE 1 END AS p FROM vocabulary, low WHERE contains(hl, t)),
matched AS (SELECT query_id, id, seq, CAST(sum(p) AS INTEGER) AS match_score FROM wanted JOIN points USING (t) GROUP BY ALL),
hits AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, seq) AS INTEGER) AS rank
  FROM matched WHERE match_score > 0 QUALIFY rank <= 12
)
"""


RETRIEVED = """
placed AS (SELECT h.query_id, h.rank AS r, e.* , %(key)s AS k FROM hits h JOIN ev e USING (id)),
once AS (SELECT * FROM placed WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY r) = 1),
retrieved AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INTEGER) AS rank FROM once)
""" % {"key": KEY.replace("%", "%%")}

FACTUAL_STOP = " OR ".join(
    f"starts_with(lower(trim(s)), '{p}')"
    for p in ("in summary", "overall", "therefore", "thus", "based on the retrieved", "i found the strongest")
)


def _factual(text: str) -> str:
    return (
        f"list_filter({_sentences(text)}, lambda s: NOT ({FACTUAL_STOP}) "
        "AND NOT regexp_full_match(trim(lower(trim(s)), ' .'), '\\[chunk:([^\\]]+)\\]') "
        "AND (regexp_matches(s, '[0-9]') OR len(regexp_split_to_array(trim(s), '\\s+')) > 6))"
    )


def _uncited(text: str) -> str:
    return f"list_filter({_factual(text)}, lambda s: NOT regexp_matches(s, '\\[chunk:([^\\]]+)\\]'))"


def _strip(text: str) -> str:
    bare = f"regexp_replace({text}, '\\[chunk:([^\\]]+)\\]', '', 'g')"
    single = f"regexp_replace({bare}, '\\s{{2,}}', ' ', 'g')"
    return f"trim(regexp_replace({single}, '\\s+([.,;:!?])', '\\1', 'g'), ' ' || chr(10))"


def _composed(source: str) -> str:
    """Answers of ``source`` (key, terms, passages: id and snippet): two sentences a passage, by terms not held before."""
    ctes = [f"""
c0 AS (
  SELECT key, CAST([] AS VARCHAR[]) AS covered, CAST([] AS VARCHAR[]) AS parts, list_transform(passages, lambda p: {{'id': p.id,
    'ss': list_transform({_sentences('p.snippet')}, lambda s: {{'t': s, 'held': list_filter(terms, lambda w: contains(lower(s), w))}})}}) AS ps
  FROM {source}
)"""]
    for k in range(6):
        at = f"ps[{k // 2 + 1}]"
        ctes.append(f"""
x{k} AS (SELECT *, list_transform({at}.ss, lambda s: len(list_filter(s.held, lambda w: NOT list_contains(covered, w)))) AS fresh FROM c{k}),
y{k} AS (SELECT *, list_position(fresh, list_max(fresh)) AS best, coalesce(len(fresh) > 0 AND ({k % 2 == 0} OR list_max(fresh) > 0), FALSE) AS taken FROM x{k}),
c{k + 1} AS (
  SELECT key, ps, CASE WHEN taken THEN list_concat(covered, {at}.ss[best].held) ELSE covered END AS covered,
    CASE WHEN taken THEN list_append(parts, regexp_replace(trim({at}.ss[best].t), '[.!?]+$', '') || ' [chunk:' || {at}.id || '].') ELSE parts END AS parts
  FROM y{k}
)""")
    return ",".join(ctes) + ", composed AS (SELECT key, trim('Based on the retrieved evidence, ' || array_to_string(parts, ' ')) AS raw FROM c6)"


RESPONSES = f"""WITH {EVIDENCE}, {QUESTIONS}, {_batch_hits()}, {RETRIEVED},
packed AS (
  SELECT query_id, count(*) AS n, list(id ORDER BY rank)[1:3] AS ids, list({{'id': id, 'snippet': snippet}} ORDER BY rank)[1:3] AS passages
  FROM retrieved GROUP BY query_id
),
passed AS (SELECT query_id AS key, terms, passages FROM packed JOIN asked USING (query_id)),
{_composed('passed')},
judged AS (
  SELECT q.query_id, coalesce(p.n, 0) AS n, p.ids, c.raw,
         coalesce(len({_uncited('c.raw')}) / greatest(1, len({_factual('c.raw')})) <= 0.6, FALSE) AS grounded
  FROM asked q LEFT JOIN packed p USING (query_id) LEFT JOIN composed c ON c.key = q.query_id
),
responses AS (
  SELECT query_id, grounded, n, ids, CASE WHEN grounded THEN {_strip('raw')} END AS answer FROM judged
)
"""

LIBRARY = f"""
library AS (
  SELECT 'doc_' || d.doc_id AS id, d.doc_id,
         {_list(EXTENSIONS)}[d.doc_id % {len(EXTENSIONS)} + 1] AS file_type,
         d.source || '_' || d.doc_id || '.' || {_list(EXTENSIONS)}[d.doc_id % {len(EXTENSIONS)} + 1] AS name,
         d.n_chars * 997 AS size_bytes,
         CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 1 THEN 'ready' WHEN l.quality = 0 THEN 'review'
              ELSE 'processing' END AS status,
         CASE d.lang WHEN 'en' THEN 'full_layout' WHEN 'de' THEN 'ocr_dependent' WHEN 'fr' THEN 'structural'
              ELSE 'best_effort' END AS fidelity_tier,
         CAST(d.n_chars // 1000 + 1 AS INTEGER) AS pages,
         CAST(1704067200 + d.doc_id AS BIGINT) * 1000000 AS updated_us
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)
"""

JOBS = """
stages AS (
  SELECT event_id AS seq, 'job_' || event_id AS id, 'doc_' || user_id AS document_id, epoch_us(ts) AS updated_us,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'ocr'
              WHEN 'purchase' THEN 'ready' ELSE 'failed' END AS stage
  FROM events
),
jobs AS (
  SELECT *, CASE WHEN stage IN ('queued', 'ready', 'failed') THEN stage ELSE 'processing' END AS status,
         CAST(CASE stage WHEN 'queued' THEN 0 WHEN 'parsing' THEN 5 WHEN 'ocr' THEN 30 ELSE 100 END AS INTEGER) AS progress_pct
  FROM stages
),
latest AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY seq DESC) = 1)
"""
NOW_US = "1706745600000000"

WORDS = """
linewise AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS body,
         unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents
),
tokens AS (
  SELECT doc_id, line, unnest(string_split(body, ' ')) AS text, unnest(range(0, len(string_split(body, ' ')))) AS n FROM linewise
),
words AS (
  SELECT 'doc_' || doc_id AS document_id, CAST(line // 40 + 1 AS INTEGER) AS page_number, CAST(line // 5 AS INTEGER) AS par_num,
         CAST(line % 5 AS INTEGER) AS line_num, line * 100000 + n AS pos, text,
         CASE WHEN (length(text) * 37 + n) % 120 - 10 >= 0 THEN ((length(text) * 37 + n) % 120 - 10) / 100.0 END AS conf,
         n * 50.0 / 2000.0 AS l, (line % 40) * 30.0 / 1100.0 AS t,
         (n * 50.0 + length(text) * 8.0) / 2000.0 AS r, ((line % 40) * 30.0 + 16.0) / 1100.0 AS b
  FROM tokens WHERE text <> ''
),
lines AS (
  SELECT document_id, page_number, par_num, line_num, min(pos) AS first_pos, string_agg(text, ' ' ORDER BY pos) AS text,
         CASE WHEN count(conf) > 0 THEN least(1.0, avg(conf)) END AS confidence, sum(conf) AS conf_sum, count(conf) AS conf_n,
         min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b
  FROM words GROUP BY ALL
),
boxed AS (
  SELECT *, CASE WHEN r > l AND b > t THEN round(least(greatest(l, 0), 1), 5) END AS x,
         CASE WHEN r > l AND b > t THEN round(least(greatest(t, 0), 1), 5) END AS y,
         CASE WHEN r > l AND b > t THEN round(least(r, 1) - least(greatest(l, 0), 1), 5) END AS width,
         CASE WHEN r > l AND b > t THEN round(least(b, 1) - least(greatest(t, 0), 1), 5) END AS height
  FROM lines
)
"""

PAGE_ROWS = f"""
pages_in AS (SELECT doc_id, page, array_to_string(ls, chr(10) || chr(10)) AS body FROM ({PAGE_LISTS})),
sides AS (
  SELECT doc_id, page,
         trim(CASE WHEN page % 2 = 1 THEN body WHEN page % 4 = 0 THEN substr(body, 1, 10) ELSE '' END, ' ' || chr(10)) AS native,
         CASE WHEN page % 2 = 0 AND page % 4 <> 0 THEN replace(body, 'e', 'E') ELSE '' END AS ocr,
         CASE WHEN page % 2 = 0 THEN (doc_id % 100) / 100.0 END AS conf
  FROM pages_in
),
merged AS (
  SELECT 'doc_' || doc_id AS document_id, page AS page_number, length(native) < 40 AS scanned,
         CASE WHEN length(native) >= 40 THEN native ELSE coalesce(nullif(ocr, ''), nullif(native, '')) END AS text,
         CASE WHEN length(native) < 40 AND ocr <> '' THEN 'ocr' ELSE 'native' END AS source,
         CASE WHEN length(native) < 40 AND ocr <> '' THEN conf END AS confidence
  FROM sides
)
"""

VECTORS = """
vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
"""

PAGED_EV = f"""
chunk_ev AS (
  SELECT {EV_ID} AS id, 'doc_' || doc_id AS document_id, source AS document_name, 'Imported content' AS section, page,
         line_start, line_end, snippet, doc_id * 1000000 + ordinal AS seq,
         CASE WHEN page % 2 = 0 THEN (doc_id % 100) / 100.0 END AS ocr_confidence
  FROM chunks JOIN documents USING (doc_id)
)
"""

CITED = f"""WITH RECURSIVE {PAGED}, {PAGED_EV}, {QUESTIONS}, {_batch_hits('chunk_ev')},
cited AS (
  SELECT h.query_id, h.rank, e.id, CASE WHEN h.query_id % 2 = 0 THEN e.document_id END AS document_id, e.document_name,
         e.page, e.ocr_confidence
  FROM hits h JOIN chunk_ev e USING (id)
),
grouped AS (
  SELECT query_id, coalesce(document_id, document_name) AS group_key, arg_min(document_name, rank) AS document_name,
         CAST(min(rank) AS INTEGER) AS first_rank, list(id ORDER BY page, rank) AS ids,
         list_sort(list_distinct(list(page))) AS pages, min(ocr_confidence) AS min_confidence
  FROM cited GROUP BY 1, 2
)
"""

PAGE_WORDS = """CASE len(pages) WHEN 0 THEN '' WHEN 1 THEN 'Page ' || pages[1]
  WHEN 2 THEN 'Pages ' || array_to_string(pages, ', ') WHEN 3 THEN 'Pages ' || array_to_string(pages, ', ')
  ELSE 'Pages ' || pages[1] || '–' || pages[-1] || ' · ' || len(pages) || ' total' END"""

TF = f"""
cand AS (SELECT doc_id, unnest({_sentences('text')}) AS s, unnest(range(0, len({_sentences('text')}))) AS i, text FROM documents),
tok AS (
  SELECT doc_id, i, unnest(list_filter(regexp_extract_all(lower(s), '[a-z][a-z''-]+'), lambda w: NOT list_contains({_list(STOPWORDS)}, w))) AS w
  FROM cand
),
tf AS (SELECT doc_id, w, count(*) AS f FROM tok GROUP BY 1, 2),
scored AS (SELECT doc_id, i, sum(f) / count(*) AS score FROM tok JOIN tf USING (doc_id, w) GROUP BY 1, 2),
ranked AS (
  SELECT c.doc_id, c.i, trim(c.s) AS s, row_number() OVER (PARTITION BY c.doc_id ORDER BY coalesce(score, 0) DESC, c.i) AS r
  FROM cand c LEFT JOIN scored x ON x.doc_id = c.doc_id AND x.i = c.i
  WHERE len(regexp_split_to_array(trim(c.s), '\\s+')) >= 5
),
running AS (
  SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY r) > 600 AND r > 1 AS over_budget FROM ranked WHERE r <= 3
),
kept AS (SELECT *, max(CAST(over_budget AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY r) AS stopped FROM running),
chosen AS (SELECT doc_id, trim(regexp_replace(string_agg(s, ' ' ORDER BY i), '\\s+', ' ', 'g')) AS summary FROM kept WHERE stopped = 0 GROUP BY 1)
"""

KINDS = (
    "CASE WHEN ext = 'PDF' THEN 'pdf' WHEN ext IN ('CSV','XLSX') THEN 'sheet' "
    "WHEN ext IN ('PNG','JPG','JPEG','WEBP','TIFF','TIF','BMP') THEN 'image' "
    "WHEN ext IN ('TS','TSX','JS','JSX','PY','JSON','XML','YAML','YML','SQL','GO','RS') THEN 'code' "
    "WHEN ext IN ('DOCX','PPTX') THEN 'doc' ELSE 'text' END"
)

HTML_STEPS = """
cut AS (
  SELECT page_id, regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', chr(2), 'gsi'), '<!--.*?-->', chr(2), 'gs') AS h
  FROM pages
),
marked AS (
  SELECT page_id, regexp_replace(regexp_replace(h, '<(br|p|div|li|tr|h[1-6])(\\s[^>]*)?/?>', chr(2) || chr(1) || chr(2), 'gi'), '<[^>]*>', chr(2), 'g') AS h
  FROM cut
),
pieces AS (
  SELECT page_id, list_filter(list_transform(string_split(h, chr(2)), lambda p: CASE WHEN p = chr(1) THEN chr(10) ELSE
    trim(replace(replace(replace(replace(p, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), ' ' || chr(10)) END),
    lambda p: p <> '') AS ps
  FROM marked
)
"""

CSV_TEXT = """array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN trim(l) = '' THEN 'x'
  ELSE trim(l) || ' | x' END), chr(10))"""
OFFICE_TEXT = """CASE k WHEN 0 THEN array_to_string(ls, chr(10))
    WHEN 1 THEN 'Sheet: S' || page || chr(10) || array_to_string(list_transform(ls, lambda l, i: l || ' | ' || i), chr(10))
    ELSE 'Slide ' || page || chr(10) || array_to_string(ls, chr(10)) END"""
OFFICE_KEPT = "k <> 0 OR length(regexp_replace(array_to_string(ls, ''), '[^A-Za-z0-9]', '', 'g')) >= 20"

SUMMARY_PROMPT = """'Tell in at most three sentences what the text below is about. Use nothing that it does not say itself.'
  || chr(10) || chr(10) || 'Title: ' || source || chr(10) || chr(10) || 'Document:' || chr(10) || text || chr(10) || chr(10) || 'Summary:'"""
EXTRACT = "coalesce(c.summary, trim(substr(regexp_replace(d.text, '\\s+', ' ', 'g'), 1, 600)))"

ANSWERS = f"""{RESPONSES}
SELECT query_id, CASE WHEN grounded THEN 'grounded' ELSE 'insufficient_evidence' END AS outcome, answer,
  CASE WHEN n = 0 THEN 'insufficient_evidence' WHEN NOT grounded THEN 'citation_density_low' END AS refusal_reason,
  CAST(n AS INTEGER) AS retrieved_chunk_count, CASE WHEN grounded THEN array_to_string(ids, ',') ELSE '' END AS cited,
  'extractive' AS provider, CAST(CASE WHEN n = 0 THEN 0.0 ELSE 0.74 END AS DOUBLE) AS top_score,
  CASE WHEN grounded THEN round(0.5 * 0.74 + 0.3 + 0.2 * len(ids) / n, 3) END AS confidence,
  CASE WHEN grounded THEN round(len(ids) / n, 3) END AS coverage FROM responses"""

PAGE_SPLIT = """SELECT CAST(substr(document_id, 5) AS BIGINT) AS doc_id, page_number AS page, string_split(text, chr(10) || chr(10)) AS ls
  FROM merged WHERE text IS NOT NULL"""

VIOLATIONS = """concat_ws('; ', CASE WHEN doc_id % 13 = 0 THEN 'size_bytes below 0' END,
  CASE WHEN doc_id % 11 = 0 THEN 'pages below 1' END, CASE WHEN doc_id % 7 = 0 THEN 'unknown status' END)"""

SQL: dict[str, str] = {
    "plain_text_admission": f"SELECT doc_id, CAST({ALNUM} AS INTEGER) AS alnum, CAST(length(text) AS INTEGER) AS chars, {ALNUM} >= 20 AS admitted FROM documents",
    "decoded_payloads": """SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN strlen(text) WHEN 1 THEN strlen(text) + 3 ELSE length(text) END AS INTEGER) AS payload_bytes,
  md5(text) AS text_md5 FROM documents""",
    "html_to_text": f"""WITH {HTML_STEPS}
SELECT page_id, trim(regexp_replace(replace(array_to_string(ps, ' '), ' ' || chr(10) || ' ', chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM pieces""",
    "csv_rows_to_text": """SELECT c_custkey, concat_ws(' | ', c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END,
  CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS VARCHAR) END) AS line FROM customer""",
    "csv_files_to_text": """SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS records,
  md5(%s) AS text_md5
FROM documents""" % CSV_TEXT,
    "file_admission": f"""WITH {LIBRARY} SELECT id, file_type AS suffix,
  CAST(CASE WHEN file_type NOT IN ({_list(fm.SUPPORTED_EXTENSIONS)[1:-1]}) THEN 415 WHEN size_bytes > 52428800 THEN 413 ELSE 201 END AS INTEGER) AS status_code,
  CASE WHEN file_type NOT IN ({_list(fm.SUPPORTED_EXTENSIONS)[1:-1]}) THEN 'unsupported_file_type' WHEN size_bytes > 52428800 THEN 'file_too_large' ELSE 'accepted' END AS reason_code
FROM library""",
    "merged_pages": f"""WITH {PAGE_ROWS} SELECT document_id, page_number, source, scanned, text IS NOT NULL AS kept,
  round(confidence, 6) AS confidence, md5(coalesce(text, '')) AS text_md5 FROM merged""",
    "merged_documents": f"""WITH {PAGE_ROWS} SELECT document_id, CASE WHEN bool_or(scanned) THEN 'ocr_dependent' ELSE 'full_layout' END AS fidelity_tier,
  CAST(count(text) AS INTEGER) AS page_count, CASE WHEN bool_or(scanned) THEN 'tesseract' END AS ocr_engine,
  string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) FILTER (WHERE text IS NOT NULL) AS page_numbers
FROM merged GROUP BY 1 HAVING count(text) > 0""",
    "paragraphs": """WITH numbered AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents
)
SELECT doc_id, CAST(i // 3 + 1 AS INTEGER) AS paragraph, CAST(min(i + i // 3 + 1) AS INTEGER) AS start_line,
  CAST(max(i + i // 3 + 1) AS INTEGER) AS end_line, CAST(sum(len(regexp_split_to_array(trim(l), '\\s+'))) AS INTEGER) AS words,
  md5(string_agg(trim(l), ' ' ORDER BY i)) AS text_md5
FROM numbered WHERE trim(l) <> '' GROUP BY doc_id, i // 3""",
    "budget_chunks": f"""WITH RECURSIVE {BUDGET} SELECT {EV_ID} AS id, 'doc_' || doc_id AS document_id, CAST(page AS INTEGER) AS page,
  line_start, line_end, CAST(length(snippet) AS INTEGER) AS chars, md5(snippet) AS snippet_md5 FROM chunks""",
    "segmented_chunks": f"""WITH RECURSIVE {BUDGET} SELECT 'doc_' || doc_id AS document_id, CAST(ordinal AS BIGINT) AS ordinal,
  CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end, md5(snippet) AS snippet_md5 FROM chunks""",
    "paged_chunks": f"""WITH RECURSIVE {PAGED} SELECT {EV_ID} AS id, page, line_start, line_end, 'paragraph' AS anchor_quality,
  CASE WHEN page % 2 = 0 THEN 'tesseract' END AS ocr_engine, CASE WHEN page % 2 = 0 THEN round((doc_id % 100) / 100.0, 6) END AS ocr_confidence,
  md5(snippet) AS snippet_md5 FROM chunks""",
    "evidence_rows": f"""WITH {EVIDENCE} SELECT id, document_id, document_name, section, page, line_start, line_end, snippet,
  CAST(0.74 AS DOUBLE) AS retrieval_score, 'Medium' AS relevance, 'paragraph' AS anchor_quality, 'full_layout' AS fidelity_tier FROM ev""",
    "ingest_outcomes": f"""SELECT 'doc_' || doc_id AS id, CASE WHEN {ALNUM} >= 20 THEN 'ready' ELSE 'review' END AS status,
  CASE WHEN {ALNUM} >= 20 THEN 'full_layout' END AS fidelity_tier, CASE WHEN {ALNUM} >= 20 THEN CAST(1 AS INTEGER) END AS pages,
  CASE WHEN {ALNUM} >= 20 THEN 'extractive' END AS summary_method, CASE WHEN {ALNUM} >= 20 THEN 'ready' ELSE 'failed' END AS job_status,
  CASE WHEN {ALNUM} >= 20 THEN 'ready' ELSE 'failed' END AS stage, CAST(100 AS INTEGER) AS progress_pct,
  CASE WHEN {ALNUM} < 20 THEN 'no_extractable_content' END AS reason_code FROM documents""",
    "office_pages": f"""WITH p AS (SELECT doc_id, page, ls, doc_id % 3 AS k FROM ({PAGE_LISTS}))
SELECT doc_id, ['docx', 'xlsx', 'pptx'][k + 1] AS suffix, CASE k WHEN 0 THEN 'full_layout' ELSE 'structural' END AS fidelity_tier, page AS page_number,
  md5({OFFICE_TEXT}) AS text_md5
FROM p WHERE {OFFICE_KEPT}""",
    "dispatched_files": f"""WITH o AS (SELECT doc_id, page, ls, doc_id % 7 AS k FROM ({PAGE_LISTS}) WHERE doc_id % 7 < 3),
office AS (SELECT doc_id, k, count(*) AS n, string_agg({OFFICE_TEXT}, chr(10) ORDER BY page) AS t FROM o WHERE {OFFICE_KEPT} GROUP BY 1, 2),
plain AS (SELECT doc_id, doc_id % 7 AS k, CASE doc_id % 7 WHEN 3 THEN text ELSE {CSV_TEXT} END AS text FROM documents WHERE doc_id % 7 IN (3, 4)),
made AS (
  SELECT doc_id, k, n, t FROM office UNION ALL SELECT doc_id, k, 1, text FROM plain WHERE {ALNUM} >= 20
)
SELECT d.doc_id, ['docx', 'xlsx', 'pptx', 'txt', 'csv', 'pdf', 'exe'][d.doc_id % 7 + 1] AS suffix,
  CASE WHEN t IS NOT NULL THEN 'parsed' WHEN d.doc_id % 7 = 5 THEN 'awaiting_pages' WHEN d.doc_id % 7 = 6 THEN 'unsupported_file_type'
    ELSE 'no_extractable_content' END AS outcome,
  CASE WHEN k IN (0, 3) THEN 'full_layout' WHEN k IS NOT NULL THEN 'structural' END AS fidelity_tier, CAST(n AS INTEGER) AS page_count, md5(t) AS text_md5
FROM documents d LEFT JOIN made USING (doc_id)""",
    "page_ingest_outcomes": f"""WITH {PAGE_ROWS},
d AS (SELECT document_id AS id, CAST(count(text) AS INTEGER) AS n, bool_or(scanned) AS s FROM merged GROUP BY 1)
SELECT id, CASE WHEN n > 0 THEN 'ready' ELSE 'review' END AS status, CASE WHEN n = 0 THEN NULL WHEN s THEN 'ocr_dependent' ELSE 'full_layout' END AS fidelity_tier,
  nullif(n, 0) AS pages, CASE WHEN n > 0 THEN 'ready' ELSE 'failed' END AS job_status, CASE WHEN n = 0 THEN 'awaiting_pages' END AS reason_code FROM d
UNION ALL SELECT 'img_' || doc_id, 'review', NULL, NULL, 'failed', 'awaiting_pages' FROM documents""",
    "page_evidence": f"""WITH RECURSIVE {PAGE_ROWS}, {_chunk_cte(PAGE_SPLIT)},
tiers AS (SELECT document_id, bool_or(scanned) AS s FROM merged GROUP BY 1)
SELECT {EV_ID} AS id, c.page, line_start, line_end, CASE WHEN m.source = 'ocr' AND c.page % 3 <> 0 THEN 'bbox' ELSE 'paragraph' END AS anchor_quality,
  CASE WHEN t.s THEN 'ocr_dependent' ELSE 'full_layout' END AS fidelity_tier, round(m.confidence, 6) AS ocr_confidence,
  CASE WHEN m.source = 'ocr' AND c.page % 3 <> 0 THEN round(c.page / 1000.0, 6) END AS box_height, md5(snippet) AS snippet_md5
FROM chunks c JOIN merged m ON m.document_id = 'doc_' || c.doc_id AND m.page_number = c.page JOIN tiers t ON t.document_id = m.document_id""",
    "abstractive_outcomes": f"""WITH {TF}, p AS (SELECT doc_id, {SUMMARY_PROMPT} AS prompt FROM documents WHERE {ALNUM} >= 20)
SELECT 'doc_' || d.doc_id AS id, CASE WHEN prompt IS NULL THEN 'review' ELSE 'ready' END AS status,
  CASE WHEN length(prompt) % 2 = 1 THEN 'Digest ' || md5(prompt) || '.' WHEN prompt IS NOT NULL THEN {EXTRACT} END AS summary,
  CASE WHEN length(prompt) % 2 = 1 THEN 'abstractive' WHEN prompt IS NOT NULL THEN 'extractive' END AS summary_method,
  CASE WHEN length(prompt) % 2 = 1 THEN 'digest' END AS summary_provider
FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN chosen c USING (doc_id)""",
    "evidence_vectors": f"""WITH {EVIDENCE} SELECT id, document_id, CAST(length(snippet) AS INTEGER) AS chars,
  CAST(length(snippet) - length(replace(snippet, ' ', '')) AS INTEGER) AS blanks, CAST(length(snippet) - length(replace(snippet, 'e', '')) AS INTEGER) AS es FROM ev""",
    "stored_keyword_search": _keyword(),
    "indexed_keyword_search": _keyword(),
    "indexed_keyword_search_batch": f"WITH {EVIDENCE}, {QUESTIONS}, {_batch_hits()} SELECT query_id, rank, id, match_score FROM hits",
    "versioned_evidence": f"""WITH {VERSIONS}
SELECT id, document_id, document_name, line_end, seq, md5(snippet) AS snippet_md5 FROM ev""",
    "versioned_vectors": f"""WITH {VERSIONS}
SELECT id, document_id, CAST(length(snippet) AS INTEGER) AS chars, CAST(length(regexp_replace(snippet, '[^ ]', '', 'g')) AS INTEGER) AS blanks,
  CAST(length(regexp_replace(snippet, '[^e]', '', 'g')) AS INTEGER) AS es FROM ev""",
    "stored_answers": ANSWERS,
    "incremental_ingest": f"""WITH {EVIDENCE} SELECT id, document_id, document_name, line_end, seq, md5(snippet) AS snippet_md5 FROM ev""",
    "sentence_stats": f"""SELECT doc_id, CAST(len({_sentences('text')}) AS INTEGER) AS sentences,
  CAST(len(list_filter({_sentences('text')}, lambda s: len(regexp_split_to_array(trim(s), '\\s+')) >= 5)) AS INTEGER) AS long_sentences FROM documents""",
    "extractive_summaries": f"""WITH {TF} SELECT d.doc_id, {EXTRACT} AS summary
FROM documents d LEFT JOIN chosen c USING (doc_id)""",
    "model_summaries": """WITH b AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations),
c AS (SELECT *, substr(t, 1, 600) AS clip FROM b)
SELECT conv_id, turn, CASE WHEN length(t) <= 600 THEN t
  WHEN length(regexp_replace(clip, '[^.!?]*$', '')) - 1 > 300 THEN regexp_replace(clip, '[^.!?]*$', '')
  ELSE rtrim(clip) || '…' END AS summary FROM c""",
    "summary_prompts": f"""WITH p AS (SELECT doc_id, {SUMMARY_PROMPT} AS prompt FROM documents)
SELECT doc_id, CAST(length(prompt) AS INTEGER) AS chars, md5(prompt) AS prompt_md5 FROM p""",
    "hash_embeddings": f"""WITH t AS (SELECT doc_id, unnest({_words('lower(text)')}) AS w FROM documents),
b AS (SELECT doc_id, CAST((('0x' || substr(sha256(w), 1, 2))::INTEGER) % 64 AS INTEGER) AS bucket, count(*) AS n FROM t GROUP BY 1, 2)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM b""",
    "vector_topk": f"""WITH {VECTORS}, q AS (SELECT v AS qv FROM vecs ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, round(list_cosine_similarity(v, qv), 12) AS c FROM vecs, q)
SELECT CAST(row_number() OVER (ORDER BY c DESC, vec_id) AS INTEGER) AS rank, 'vec_' || vec_id AS id, round(least(1.0, c), 6) AS score
FROM s WHERE c >= 0.35 QUALIFY rank <= 12""",
    "vector_topk_scoped": f"""WITH {VECTORS}, q AS (SELECT v AS qv FROM vecs ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, round(list_cosine_similarity(v, qv), 12) AS c FROM vecs, q WHERE label IN (1, 2))
SELECT CAST(row_number() OVER (ORDER BY c DESC, vec_id) AS INTEGER) AS rank, 'vec_' || vec_id AS id, round(least(1.0, c), 6) AS score
FROM s WHERE c >= 0 QUALIFY rank <= 12""",
    "vector_topk_batch": f"""WITH {VECTORS},
qv AS (SELECT conv_id * 1000 + turn AS query_id, v FROM conversations JOIN vecs ON vec_id = conv_id WHERE role = 'user'),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(b.v, qv.v), 12) AS c FROM qv, vecs b)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS INTEGER) AS rank, 'vec_' || vec_id AS id, round(least(1.0, c), 6) AS score
FROM s WHERE c >= 0.35 QUALIFY rank <= 12""",
    "vector_cells_batch": f"""WITH {VECTORS},
qv AS (SELECT conv_id * 1000 + turn AS query_id, v FROM conversations JOIN vecs ON vec_id = conv_id WHERE role = 'user'),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(b.v, qv.v), 12) AS c FROM qv, vecs b)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS INTEGER) AS rank, 'vec_' || vec_id AS id, round(least(1.0, c), 6) AS score
FROM s WHERE c >= 0.35 QUALIFY rank <= 12""",
    "keyword_search": _keyword(),
    "keyword_search_scope_postlimit": f"SELECT rank, id, match_score, score FROM ({_keyword(where_hits=GOOD)})",
    "keyword_search_scope_prefilter": f"SELECT rank, id, match_score, score FROM ({_keyword(where_corpus=GOOD)})",
    "keyword_search_batch": f"WITH {EVIDENCE}, {QUESTIONS}, {_batch_hits()} SELECT query_id, rank, id, match_score FROM hits",
    "query_terms": f"WITH {QUESTIONS} SELECT query_id, CAST(len(terms) AS INTEGER) AS terms, array_to_string(list_sort(terms), ' ') AS sorted_terms FROM asked",
    "search_results": f"""WITH {EVIDENCE}, {QUESTIONS}, {_batch_hits()}, {RETRIEVED}
SELECT query_id, rank, id, document_name, CAST(0.74 AS DOUBLE) AS score FROM retrieved""",
    "retrieve_dedupe": f"""WITH {EVIDENCE}, k AS (SELECT id, seq, {KEY} AS k FROM ev)
SELECT id, sha256(k) AS dedupe_key FROM k WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1""",
    "vector_first_retrieval": f"""WITH {EVIDENCE}, {QUESTIONS}, {_batch_hits()}, {VECTORS},
qv AS (SELECT query_id, v FROM asked JOIN vecs ON vec_id = query_id // 1000),
sim AS (SELECT query_id, vec_id, round(list_cosine_similarity(b.v, qv.v), 12) AS c FROM qv, vecs b),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS r FROM sim WHERE c >= 0.35 QUALIFY r <= 12),
placed AS (
  SELECT n.query_id, n.r, e.id, least(1.0, n.c) AS score, {KEY} AS k FROM near n JOIN ev e ON e.id = 'ev_' || n.vec_id || '_0001'
),
fallback AS (
  SELECT h.query_id, h.rank AS r, e.id, 0.74 AS score, {KEY} AS k FROM hits h JOIN ev e USING (id)
  WHERE h.query_id NOT IN (SELECT query_id FROM placed)
),
either AS (SELECT * FROM placed UNION ALL SELECT * FROM fallback),
once AS (SELECT * FROM either WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY r) = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INTEGER) AS rank, id, round(score, 6) AS score FROM once""",
    "ask_prompts": f"""WITH {EVIDENCE}, p AS (SELECT id, 'You are a careful research assistant. Everything you state must be found in the passages below.' || chr(10)
  || 'Put the marker [chunk:<id>] of its passage behind every statement; use no other ids.' || chr(10)
  || 'Should the passages not answer the question, write INSUFFICIENT_EVIDENCE and nothing else.' || chr(10) || chr(10) || 'Question: What does it say?' || chr(10) || chr(10)
  || 'Context:' || chr(10) || '[[chunk:' || id || ']]' || chr(10) || snippet || chr(10) || '[[/chunk]]' || chr(10) || chr(10) || 'Answer:' AS prompt FROM ev)
SELECT id, CAST(length(prompt) AS INTEGER) AS chars, md5(prompt) AS prompt_md5 FROM p""",
    "extractive_answers": f"""WITH {EVIDENCE},
one AS (SELECT id AS key, ['what', 'does', 'say?'] AS terms, [{{'id': id, 'snippet': snippet}}] AS passages FROM ev), {_composed('one')}
SELECT key AS id, raw AS answer FROM composed""",
    "gate_outcomes": f"""WITH {EVIDENCE},
raws AS (SELECT id, doc_id % 5 AS kind, CASE doc_id % 5
  WHEN 0 THEN regexp_replace(snippet, '[.!?\\s]+', ' ', 'g') || ' [chunk:' || id || '].'
  WHEN 1 THEN regexp_replace(snippet, '[.!?\\s]+', ' ', 'g') || ' [chunk:ev_missing].'
  WHEN 2 THEN snippet WHEN 3 THEN 'INSUFFICIENT_EVIDENCE: nothing found'
  ELSE snippet || ' [chunk:' || id || '].' END AS raw FROM ev),
d AS (SELECT *, len({_factual('raw')}) AS f, len({_uncited('raw')}) AS u FROM raws),
v AS (SELECT *, CASE WHEN kind = 3 THEN 'model_declined' WHEN kind = 1 THEN 'gate_rejected_output' WHEN kind = 2 THEN 'citation_density_low'
  WHEN f > 0 AND u / f > 0.6 THEN 'citation_density_low' END AS reason FROM d)
SELECT id, CASE WHEN reason IS NULL THEN 'grounded' ELSE 'insufficient_evidence' END AS outcome, reason,
  CAST(CASE WHEN kind IN (0, 4) THEN 1 ELSE 0 END AS INTEGER) AS cited FROM v""",
    "citation_density": f"""WITH {EVIDENCE}, parts AS (SELECT id, string_split(snippet, '. ') AS ps FROM ev),
m AS (SELECT id, array_to_string(list_transform(ps, lambda p, i: CASE WHEN (i - 1) % 4 = 0 THEN p || ' [chunk:a]' ELSE p END), '. ') AS t FROM parts)
SELECT id, CAST(len({_factual('t')}) AS INTEGER) AS factual, CAST(len({_uncited('t')}) AS INTEGER) AS uncited FROM m""",
    "bound_citations": f"""WITH RECURSIVE {BUDGET}
SELECT 'doc_' || doc_id AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ordinal DESC) AS INTEGER) AS ordinal,
  {EV_ID} AS evidence_unit_id, md5(snippet) AS snippet_md5 FROM chunks""",
    "confidence_breakdown": f"""WITH RECURSIVE {BUDGET},
c AS (SELECT doc_id, ordinal - 1 AS i, (ordinal - 1) % 2 = 0 OR ordinal <= 2 AS cited FROM chunks),
a AS (SELECT doc_id, avg(1.0 / (i + 1)) FILTER (WHERE cited) AS retrieval,
  coalesce(avg(CASE WHEN i % 2 = 1 THEN (i % 10) / 10.0 END) FILTER (WHERE cited), 1.0) AS ocr, count(*) FILTER (WHERE cited) / count(*) AS coverage FROM c GROUP BY 1)
SELECT 'doc_' || doc_id AS document_id, round(0.5 * retrieval + 0.3 * ocr + 0.2 * coverage, 6) AS overall, round(retrieval, 6) AS retrieval,
  round(ocr, 6) AS ocr, round(coverage, 6) AS coverage FROM a""",
    "stripped_markers": f"""WITH m AS (SELECT conv_id, turn, regexp_replace(text, '([.,])', ' [chunk:ev_1] \\1 ', 'g') AS t FROM conversations)
SELECT conv_id, turn, {_strip('t')} AS answer FROM m""",
    "ask_answers": ANSWERS,
    "answer_stream": f"""{RESPONSES},
t AS (SELECT query_id, string_split(answer, ' ') AS ps FROM responses WHERE answer <> ''),
u AS (SELECT query_id, len(ps) AS n, unnest(ps) AS p, unnest(range(0, len(ps))) AS i FROM t)
SELECT query_id, CAST(i AS INTEGER) AS token_index, CASE WHEN i < n - 1 THEN p || ' ' ELSE p END AS token FROM u""",
    "document_tokens": """SELECT doc_id AS query_id, len(string_split(text, ' ')) AS tokens, CAST(len(string_split(text, ' ')) - 1 AS INTEGER) AS last_index,
  CAST(length(text) AS BIGINT) AS chars FROM documents WHERE text <> ''""",
    "event_stream": f"""{RESPONSES}
SELECT query_id, coalesce(answer, '') AS streamed, CASE WHEN grounded THEN 'grounded' ELSE 'insufficient_evidence' END AS outcome, answer FROM responses""",
    "library_list": f"""WITH {LIBRARY} SELECT id, name, status, (SELECT count(*) FROM library WHERE status = 'ready') > 25 AS has_more
FROM library WHERE status = 'ready' ORDER BY doc_id LIMIT 25""",
    "library_next_page": f"""WITH {LIBRARY}, r AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM library WHERE status = 'ready')
SELECT id, name, status, (SELECT count(*) FROM r) > 50 AS has_more FROM r WHERE n BETWEEN 26 AND 50""",
    "document_lookup": f"WITH {LIBRARY} SELECT id, name, status, pages FROM library WHERE doc_id = 7",
    "library_filter": f"WITH {LIBRARY} SELECT id, name, status FROM library WHERE contains(lower(name), 'src1') AND status IN ('review', 'failed')",
    "library_stats": f"""WITH {LIBRARY} SELECT count(*) AS all_documents, count(*) FILTER (WHERE status = 'ready') AS ready,
  count(*) FILTER (WHERE status IN ('review', 'failed')) AS attention, CAST(sum(pages) AS BIGINT) AS total_pages FROM library""",
    "review_stats": f"""WITH {LIBRARY} SELECT CAST(floor(count(*) FILTER (WHERE status = 'ready') * 100.0 / count(*) + 0.5) AS BIGINT) AS coverage_pct,
  count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status IN ('review', 'failed')) AS attention,
  count(*) FILTER (WHERE fidelity_tier = 'ocr_dependent') AS ocr_derived FROM library""",
    "document_labels": f"""WITH {LIBRARY}, x AS (SELECT *, upper(file_type) AS ext, (1704070800000000 - updated_us) / 60e6 AS m FROM library)
SELECT id, ext AS type, CASE WHEN size_bytes < 1048576 THEN CAST(greatest(1, floor(size_bytes / 1024 + 0.5)) AS BIGINT) || ' KB'
  ELSE printf('%.1f MB', size_bytes / 1048576.0) END AS size,
  CASE fidelity_tier WHEN 'full_layout' THEN 'Full layout' WHEN 'ocr_dependent' THEN 'OCR dependent' WHEN 'best_effort' THEN 'Best effort' ELSE 'Structural' END AS fidelity,
  {KINDS} AS kind, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN greatest(1, CAST(floor(m + 0.5) AS BIGINT)) || ' min ago' ELSE 'Today' END AS updated FROM x""",
    "inline_files": f"WITH {LIBRARY} SELECT id, file_type IN ({_list(fm.INLINE_SAFE_EXTENSIONS)[1:-1]}) AS inline, file_type IN ({_list(fm.PREVIEWABLE_EXTENSIONS)[1:-1]}) AS previewable FROM library",
    "first_hits": f"""WITH RECURSIVE {PAGED}, {PAGED_EV}, {QUESTIONS}, {_batch_hits('chunk_ev')}
SELECT h.query_id, e.document_id, h.rank, e.id FROM hits h JOIN chunk_ev e USING (id)
QUALIFY row_number() OVER (PARTITION BY h.query_id, e.document_id ORDER BY h.rank) = 1""",
    "citation_groups": f"""{CITED} SELECT query_id, group_key, document_name, first_rank, CAST(len(ids) AS INTEGER) AS passages,
  array_to_string(ids, ',') AS passage_ids, round(min_confidence, 6) AS min_confidence, coalesce(min_confidence < 0.6, FALSE) AS low_confidence FROM grouped""",
    "citation_pages": f"{CITED} SELECT query_id, group_key, {PAGE_WORDS} AS pages FROM grouped",
    "source_totals": f"""{CITED} SELECT query_id, CAST(sum(len(ids)) AS BIGINT) || ' passage' || CASE WHEN sum(len(ids)) = 1 THEN '' ELSE 's' END || ' from '
  || count(*) || ' document' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS label FROM grouped GROUP BY query_id""",
    "document_page_summary": f"""WITH p AS (SELECT doc_id, list(page ORDER BY page) AS pages FROM ({PAGE_LISTS}) GROUP BY 1)
SELECT doc_id, {PAGE_WORDS} AS pages FROM p""",
    "hydrated_citations": f"""WITH RECURSIVE {BUDGET}
SELECT {EV_ID} || CASE WHEN ordinal % 2 = 1 THEN '_gone' ELSE '' END AS evidence_unit_id, CAST(ordinal AS INTEGER) AS ordinal,
  CASE WHEN ordinal % 2 = 0 THEN source ELSE 'Retrieved evidence' END AS document_name,
  CASE WHEN ordinal % 2 = 0 THEN 'Imported content' ELSE 'Citation ' || ordinal END AS section, CAST(1 AS INTEGER) AS page,
  CASE WHEN ordinal % 2 = 0 THEN line_start || '-' || line_end ELSE '1-1' END AS lines, 'Medium' AS relevance,
  md5(CASE WHEN ordinal % 2 = 0 THEN snippet ELSE 'Cited: ' || snippet END) AS snippet_md5
FROM chunks JOIN lib USING (doc_id)""",
    "latest_jobs": f"WITH {JOBS} SELECT document_id, id, status, stage, progress_pct FROM latest",
    "documents_with_progress": f"""WITH {LIBRARY}, {JOBS} SELECT l.id, l.status, CASE WHEN l.status = 'processing' THEN j.stage END AS stage,
  CASE WHEN l.status = 'processing' THEN j.progress_pct END AS progress FROM library l LEFT JOIN latest j ON j.document_id = l.id""",
    "reconciled_jobs": f"""WITH {JOBS} SELECT id, CASE WHEN status IN ('queued', 'processing') THEN 'failed' ELSE status END AS status,
  CASE WHEN status IN ('queued', 'processing') THEN 'failed' ELSE stage END AS stage,
  CASE WHEN status IN ('queued', 'processing') THEN 'interrupted' END AS reason_code,
  CASE WHEN status IN ('queued', 'processing') THEN stage END AS error_stage,
  CASE WHEN status IN ('queued', 'processing') THEN {NOW_US} ELSE updated_us END AS updated_us FROM jobs""",
    "reconciled_documents": f"""WITH {LIBRARY}, {JOBS}, o AS (SELECT DISTINCT document_id FROM jobs WHERE status IN ('queued', 'processing'))
SELECT id, CASE WHEN document_id IS NOT NULL THEN 'review' ELSE status END AS status,
  CASE WHEN document_id IS NOT NULL THEN {NOW_US} ELSE updated_us END AS updated_us FROM library LEFT JOIN o ON document_id = id""",
    "job_timelines": f"""WITH d AS (SELECT doc_id, {ALNUM} >= 20 AS ok FROM documents),
s AS (SELECT doc_id, CASE WHEN ok THEN ['queued', 'parsing', 'chunking', 'summarizing', 'embedding', 'indexing', 'ready'] ELSE ['queued', 'parsing', 'failed'] END AS st FROM d),
u AS (SELECT doc_id, unnest(st) AS stage, unnest(range(0, len(st))) AS step FROM s)
SELECT 'job_' || doc_id AS job_id, 'doc_' || doc_id AS document_id, CAST(step AS INTEGER) AS step,
  CASE WHEN stage IN ('queued', 'ready', 'failed') THEN stage ELSE 'processing' END AS status, stage,
  CAST(CASE stage WHEN 'queued' THEN 0 WHEN 'parsing' THEN 5 WHEN 'chunking' THEN 62 WHEN 'summarizing' THEN 72 WHEN 'embedding' THEN 82
    WHEN 'indexing' THEN 92 ELSE 100 END AS INTEGER) AS progress_pct FROM u""",
    "retried_documents": f"""WITH {LIBRARY} SELECT id AS document_id, CASE WHEN doc_id % 9 <> 0 THEN 'retry_' || id END AS id,
  CASE WHEN doc_id % 9 <> 0 THEN 'queued' ELSE 'refused' END AS status, CASE WHEN doc_id % 9 = 0 THEN 'The stored file is missing.' END AS reason
FROM library WHERE status IN ('review', 'failed')""",
    "uploaded_documents": f"""WITH {LIBRARY} SELECT id, file_type, 'application/octet-stream' AS mime_type, 'processing' AS status,
  CASE WHEN file_type = 'png' THEN 'ocr_dependent' ELSE 'structural' END AS fidelity_tier,
  CAST(greatest(1, CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 ELSE 1 END) AS INTEGER) AS pages, 'queued' AS job_status, CAST(0 AS INTEGER) AS progress_pct
FROM library WHERE file_type <> 'exe' AND size_bytes <= 52428800""",
    "progress_reports": """WITH RECURSIVE t AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents),
o AS (SELECT doc_id, n, list_concat(list_filter(range(1, n + 1), lambda p: p % 2 = 1), list_filter(range(1, n + 1), lambda p: p % 2 = 0)) AS ps FROM t),
f(doc_id, i, last, page, passes) AS (
  SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), FALSE FROM o
  UNION ALL
  SELECT f.doc_id, f.i + 1, CASE WHEN o.ps[f.i + 1] = o.n OR o.ps[f.i + 1] - f.last >= 5 THEN o.ps[f.i + 1] ELSE f.last END,
         o.ps[f.i + 1], o.ps[f.i + 1] = o.n OR o.ps[f.i + 1] - f.last >= 5
  FROM f JOIN o USING (doc_id) WHERE f.i < o.n
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS n, CAST(page AS INTEGER) AS page,
  CAST(least(60, 5 + floor(55 * page / t.n)) AS INTEGER) AS progress_pct FROM f JOIN t USING (doc_id) WHERE passes""",
    "upserted_documents": f"""WITH {LIBRARY} SELECT CASE WHEN doc_id % 5 = 0 THEN id ELSE 'new_' || id END AS id, name, 'processing' AS status FROM library
UNION ALL SELECT id, name, status FROM library WHERE doc_id % 5 <> 0""",
    "replaced_evidence": f"""WITH RECURSIVE {BUDGET}
SELECT {EV_ID} AS id, 'doc_' || doc_id AS document_id, line_end FROM chunks WHERE doc_id % 2 = 1
UNION ALL SELECT 'ev_' || doc_id || '_0001', 'doc_' || doc_id, CAST(len({LINES}) AS INTEGER) FROM lib WHERE doc_id % 2 = 0""",
    "updated_documents": f"""WITH {LIBRARY}, {JOBS}
SELECT l.id, CASE j.status WHEN 'ready' THEN 'ready' WHEN 'failed' THEN 'review' ELSE l.status END AS status,
  CASE WHEN j.status IN ('ready', 'failed') THEN {NOW_US} ELSE l.updated_us END AS updated_us
FROM library l LEFT JOIN latest j ON j.document_id = l.id""",
    "deleted_vectors": "SELECT 'vec_' || vec_id AS id, 'doc_' || label AS document_id FROM embeddings WHERE label <> 3",
    "remaining_configs": """SELECT 'cfg_' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'chat' ELSE 'embedding' END AS role,
  CASE WHEN s_suppkey % 3 = 0 THEN 'ollama' ELSE 'openai' END AS provider_type, s_suppkey % 4 = 0 AS is_default FROM supplier WHERE s_suppkey <> 3""",
    "demoted_configs": """WITH c AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'chat' ELSE 'embedding' END AS role FROM supplier),
m AS (SELECT role, max(k) AS k FROM c GROUP BY 1)
SELECT 'cfg_' || c.k AS id, c.role, CASE WHEN c.k = m.k OR c.k % 3 = 0 THEN 'ollama' ELSE 'openai' END AS provider_type,
  CASE WHEN c.k = m.k THEN 'm2' ELSE 'm' END AS model_name, CASE WHEN c.k = m.k THEN c.role = 'chat' ELSE c.role <> 'chat' AND c.k % 4 = 0 END AS is_default,
  c.k = m.k OR c.k % 3 = 0 AS local FROM c JOIN m USING (role)""",
    "installed_models": """SELECT p_partkey, p_partkey % 7 IN (1, 2, 3) OR (p_partkey % 7 = 4 AND p_partkey % 3 <> 0) AS installed FROM part""",
    "evolved_evidence": f"""WITH RECURSIVE {BUDGET}
SELECT 'old_ev_' || doc_id || '_0001' AS id, CAST(len({LINES}) AS INTEGER) AS line_end, 'paragraph' AS anchor_quality, 'full_layout' AS fidelity_tier, TRUE AS native FROM lib
UNION ALL SELECT {EV_ID}, line_end, 'paragraph', 'full_layout', TRUE FROM chunks""",
    "exported_state": f"""WITH {LIBRARY} SELECT id, name, CASE WHEN doc_id % 13 = 0 THEN -1 ELSE size_bytes END AS size_bytes, {VIOLATIONS} AS violations FROM library""",
    "quarantined_documents": f"""SELECT 'doc_' || doc_id AS id, {VIOLATIONS} AS violations
FROM documents WHERE doc_id % 13 = 0 OR doc_id % 11 = 0 OR doc_id % 7 = 0""",
    "recognised_lines": f"""WITH {WORDS} SELECT document_id, page_number, par_num, line_num, first_pos, md5(text) AS text_md5, round(confidence, 9) AS confidence,
  x, y, round(width, 4) AS width, round(height, 4) AS height FROM boxed""",
    "recognised_page_texts": f"""WITH {WORDS} SELECT document_id, page_number, md5(string_agg(text, chr(10) ORDER BY first_pos)) AS text_md5,
  CASE WHEN sum(conf_n) > 0 THEN round(least(1.0, sum(conf_sum) / sum(conf_n)), 9) END AS confidence, round(min(x), 4) AS x, round(min(y), 4) AS y,
  round(max(x + width) - min(x), 4) AS width, round(max(y + height) - min(y), 4) AS height FROM boxed GROUP BY 1, 2""",
    "quad_boxes": """WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT vec_id, list_min([v[1], v[3], v[5], v[7]]) / 0.2 AS l, list_max([v[1], v[3], v[5], v[7]]) / 0.2 AS r,
  list_min([v[2], v[4], v[6], v[8]]) / 0.1 AS t, list_max([v[2], v[4], v[6], v[8]]) / 0.1 AS b FROM p),
c AS (SELECT vec_id, least(greatest(l, 0), 1) AS l, least(greatest(r, 0), 1) AS r, least(greatest(t, 0), 1) AS t, least(greatest(b, 0), 1) AS b FROM e)
SELECT vec_id, CASE WHEN r > l AND b > t THEN round(l, 5) END AS x, CASE WHEN r > l AND b > t THEN round(t, 5) END AS y,
  CASE WHEN r > l AND b > t THEN round(r - l, 5) END AS width, CASE WHEN r > l AND b > t THEN round(b - t, 5) END AS height FROM c""",
    "recognition_languages": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE lang "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGE_CODES.items())
    + " ELSE lang END WHEN 1 THEN lang || 'x' ELSE 'en' END AS code FROM documents",
    "line_labels": f"""WITH RECURSIVE {PAGED} SELECT {EV_ID} AS id, line_start || '-' || line_end AS lines,
  page % 2 = 0 AND (doc_id % 100) / 100.0 < 0.6 AS low_confidence FROM chunks""",
}
