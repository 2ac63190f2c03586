"""Registered queries of the corpus operators, with production parameters over whole tables."""

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from topicweir.llm import (
    conversation_repair,
    decontaminate,
    html_extract,
    jaccard_join,
    line_dedup,
    minhash,
    packing,
    pii,
    spelling,
    substring_dedup,
    token_counts,
    topk_search,
    toxicity,
)
from topicweir.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.leak_report(decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text")))


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.toxicity_report(toxicity.score(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


@query
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


SQL["op3_exact_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(pii.find_pii(table(spark, sf_dir, "documents", "doc_id", "text")))


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_passages(table(spark, sf_dir, "documents", "doc_id", "text"))


def _sql_words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"


def _sql_lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_SQL_FOLDED = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL["op2_benchmark_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_FOLDED.format(_sql_lower("text"))} AS ws FROM documents),
i AS (SELECT item_id, {_SQL_FOLDED.format(_sql_lower("text"))} AS ws FROM benchmark),
k AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[s : s + n - 1], ' ') AS w
       FROM (SELECT *, unnest(range(1, (len(ws) - n + 2)::BIGINT)) AS s FROM k)),
dw AS (SELECT r, n, s, array_to_string(ws[s : s + n - 1], ' ') AS w
       FROM (SELECT r, ws, n, unnest(range(1, (len(ws) - n + 2)::BIGINT)) AS s FROM d, (SELECT DISTINCT n FROM k))),
hit AS (SELECT r, dw.n, s, item_id FROM dw JOIN iw USING (n, w)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

SQL["op5_substring_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words("text")} AS ws FROM documents),
win AS (SELECT r, doc_id, s, array_to_string(ws[s : s + 12], ' ') AS w
        FROM (SELECT *, unnest(range(1, (len(ws) - 11)::BIGINT)) AS s FROM d WHERE doc_id IS NOT NULL)),
f AS (SELECT w, min(doc_id) AS first FROM win GROUP BY w),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 13)) AS p FROM win JOIN f USING (w) WHERE first < doc_id),
word AS (SELECT r, unnest(ws) AS x, unnest(range(1, (len(ws) + 1)::BIGINT)) AS p FROM d),
kept AS (SELECT r, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS t
         FROM word LEFT JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@query
def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_forms(table(spark, sf_dir, "documents", "doc_id", "text"), damage=spelling.DAMAGE)


SQL["op7_ngram_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_sql_words(_sql_lower("text"))} AS ws FROM documents),
s AS (SELECT doc_id, len(ws) AS n_words, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, (len(ws) - 3)::BIGINT), lambda i: array_to_string(ws[i : i + 4], ' '))) END) AS w FROM d),
k AS (SELECT least(n_words, 5) AS n, w, doc_id FROM s),
c AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id),
ov AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM k a JOIN k b ON a.n = b.n AND a.w = b.w AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM ov JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
m AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

# Pairs of texts are compared where the longer set has at most 5/4 of the shorter one's shingles.
SQL["op12_minhash"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_sql_words(_sql_lower("text"))} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 2 THEN ws
      ELSE list_distinct(list_transform(range(1, len(ws)::BIGINT), lambda i: ws[i] || ' ' || ws[i + 1])) END AS x FROM d),
t AS (SELECT x, min(doc_id) AS id, len(x) AS n FROM (SELECT doc_id, list_sort(x) AS x FROM s WHERE len(x) > 0) GROUP BY x),
w AS (SELECT id, n, unnest(x) AS w FROM t),
ov AS (SELECT a.id AS a, b.id AS b, a.n AS m, b.n AS n, count(*) AS n_both FROM w a JOIN w b
       ON a.w = b.w AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY ALL),
one AS (SELECT a, b FROM ov WHERE 100 * n_both >= 80 * (m + n - n_both)),
own AS (SELECT DISTINCT s.doc_id, t.id FROM s JOIN t ON list_sort(s.x) = t.x),
link AS (SELECT a, b FROM one UNION SELECT b, a FROM one UNION SELECT doc_id, id FROM own UNION SELECT id, doc_id FROM own),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
m AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT s.doc_id, len(x)::BIGINT AS n_shingles, coalesce(m.least, s.doc_id) AS component_id, s.doc_id = coalesce(m.least, s.doc_id) AS kept
FROM s LEFT JOIN m USING (doc_id)
"""

# crc32 by table: entry n is what eight shifts make of n.
_SQL_CRC_TABLE = """SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    ORDER BY n) AS t FROM range(256) r(n)"""


def _sql_crc(value: str, crc_table: str) -> str:
    code = f"(strpos('0123456789ABCDEF', substr(hex(encode({value})), 2 * i - 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode({value})), 2 * i, 1)) - 1"
    codes = f"list_transform(range(1, octet_length(encode({value})) + 1), lambda i: ({code})::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, {crc_table}[(xor(c, b) & 255) + 1])), 4294967295)"


SQL["op13_spelling_variants"] = f"""
WITH RECURSIVE crc AS ({_SQL_CRC_TABLE}),
run AS (SELECT doc_id, unnest(regexp_extract_all({_sql_lower("text")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
own AS (SELECT w, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || w AS k FROM run GROUP BY doc_id, w),
h AS (SELECT w, n, {_sql_crc("k", "t")} AS h FROM own, crc),
made AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w) + 2)::BIGINT) ELSE w END AS word, n FROM h),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM less),
near AS (SELECT a.word, b.word AS other, b.n FROM v a JOIN v b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
         UNION SELECT v.word, w.word, w.n FROM v JOIN words w ON v.v = w.word
         UNION SELECT w.word, v.word, v.n FROM v JOIN words w ON v.v = w.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
form AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * words.n THEN top END AS form_n,
         (SELECT min(other) FROM near WHERE near.word = words.word AND near.n = top AND top >= 2 * words.n) AS form
         FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM form UNION SELECT chain.word, form.form FROM chain JOIN form ON form.word = chain.root WHERE form.form IS NOT NULL),
last AS (SELECT chain.word, root FROM chain JOIN form ON form.word = chain.root WHERE form.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM form JOIN last USING (word)
"""

# The dynamic program runs forward, a row of each conversation at a time; `cost` and `audit` are the best up to a state:
# n nothing yet, s, u, a after that role. A state is entered by the row itself and then by turns put in, at most two.
SQL["op11_conversation_repair"] = f"""
WITH RECURSIVE crc AS ({_SQL_CRC_TABLE}),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
        FROM conversations),
h AS (SELECT conv_id, turn, role, text, {_sql_crc("k", "t")} % 20 AS kind FROM raw, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
             regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body FROM d),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, substr(role, 1, 1) AS c,
             lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS next FROM o),
stats AS (SELECT conv_id, count(*) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
                 count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (next IS NOT NULL AND c || next NOT IN ('su', 'ua', 'au')) AS illegal
          FROM f GROUP BY conv_id),
put(a, b, role, cost) AS (VALUES ('n', 'u', 'user', 2), ('s', 'u', 'user', 2), ('u', 'a', 'assistant', 2), ('a', 'u', 'user', 2)),
keep(a, b) AS (VALUES ('n', 's'), ('n', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
ins AS (SELECT a, a AS b, 0 AS cost, '' AS edits, [] AS turns FROM (VALUES ('n'), ('s'), ('u'), ('a')) v(a)
        UNION ALL SELECT a, b, 2, 'I', [role || ':'] FROM put
        UNION ALL SELECT p.a, q.b, 4, 'II', [p.role || ':', q.role || ':'] FROM put p JOIN put q ON q.a = p.b),
step AS (SELECT conv_id, i, k.a, k.b, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cost, 'K' AS edits, [role || ':' || text] AS turns
         FROM f JOIN keep k ON k.b = f.c WHERE fault NOT IN ('blank', 'duplicate')
         UNION ALL SELECT conv_id, i, p.a, p.b, 2 + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'R', [p.role || ':' || text]
         FROM f, put p WHERE fault NOT IN ('blank', 'duplicate')
         UNION ALL SELECT conv_id, i, a, a, 3, 'D', [] FROM f, (VALUES ('n'), ('s'), ('u'), ('a')) v(a)),
go AS (SELECT conv_id, i, ins.a, step.b, ins.cost + step.cost AS cost, ins.edits || step.edits AS edits, ins.turns || step.turns AS turns
       FROM ins JOIN step ON step.a = ins.b),
walk(conv_id, i, b, best) AS (
    SELECT conv_id, 0::BIGINT, 'n', {{'cost': 0::BIGINT, 'audit': '', 'turns': []::VARCHAR[]}} FROM stats
    UNION ALL
    SELECT w.conv_id, go.i, go.b, min({{'cost': (w.best.cost + go.cost)::BIGINT, 'audit': w.best.audit || go.edits, 'turns': w.best.turns || go.turns}})
    FROM walk w JOIN go ON go.conv_id IS NOT DISTINCT FROM w.conv_id AND go.i = w.i + 1 AND go.a = w.b GROUP BY w.conv_id, go.i, go.b),
done AS (SELECT w.conv_id, min({{'cost': (best.cost + ins.cost)::BIGINT, 'audit': best.audit || edits, 'turns': best.turns || ins.turns}}) AS best
         FROM walk w JOIN stats s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i JOIN ins ON ins.a = w.b AND ins.b IN ('n', 'a') GROUP BY w.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id
"""
