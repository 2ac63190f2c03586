"""DuckDB SQL for the registered queries, over the same tables."""

from topicweir.functions.fixed_values import (
    HAN_CLASS,
    PUNCT_CLASS,
    SPACE_CLASS,
    STOPWORDS,
    STOPWORDS_ENGLISH,
    WORD_CLASS,
)
from topicweir.functions.segmentation import Lattice
from topicweir.plans.queries import ACCENTS, CUSTOM_STOP, DESCRIPTIONS, LETTERS, MIXED_CASE, PARTICLES, SELECTED, SIMILAR, SUBJECTS, SUBJECTS_AND_ABSENT, WIDE_ENTRIES, WORDS


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def values_table(dictionary) -> str:
    rows = [
        f"({quoted(s)}, {i}, {j}, {quoted(k)})"
        for i, (s, kws) in enumerate(dictionary.entries)
        for j, k in enumerate(kws)
    ]
    return "VALUES " + ", ".join(rows)


def order_table(values) -> str:
    return "VALUES " + ", ".join(f"({quoted(v)}, {i})" for i, v in enumerate(values))


# --- text expressions --------------------------------------------------------------------


def clean(x: str) -> str:
    spaced = f"regexp_replace(lower({x}), '[{SPACE_CLASS}]+', ' ', 'g')"
    kept = f"regexp_replace({spaced}, '[^{WORD_CLASS} {HAN_CLASS}{PUNCT_CLASS}]', ' ', 'g')"
    return f"trim(regexp_replace({kept}, '[{PUNCT_CLASS}]{{2,}}', ' ', 'g'))"


def pairs(x: str, chars: str) -> str:
    runs = f"list_filter(regexp_extract_all({x}, '([{chars}]+)', 1), lambda r: length(r) >= 2)"
    each = "list_transform(range(1, length(r)), lambda i: substr(r, i, 2))"
    return f"list_filter(flatten(list_transform({runs}, lambda r: {each})), lambda w: NOT list_contains({sql_list(STOPWORDS)}, w))"


def english(x: str) -> str:
    return (
        f"list_filter(regexp_extract_all({x}, '([a-zA-Z]{{2,}})', 1), "
        f"lambda w: length(w) >= 3 AND NOT list_contains({sql_list(STOPWORDS_ENGLISH)}, w))"
    )


def joined(items: str) -> str:
    return f"array_to_string({items}, ' ')"


def processed(relation: str, id_col: str, text: str, name: str) -> str:
    """CTEs ending in `name(id, text)` with processed texts."""
    return (
        f"{name}_c AS (SELECT {id_col} AS id, {clean(text)} AS c FROM {relation}), "
        f"{name} AS (SELECT id, CASE WHEN t = '' THEN c ELSE t END AS text FROM (SELECT id, c, "
        f"{joined(f'list_concat({pairs("c", HAN_CLASS)}, {english("c")})')} AS t FROM {name}_c))"
    )


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$', '', 'g')"


def runs(html: str, tag: str) -> str:
    found = f"regexp_extract_all({html}, '<{tag}[^>]*>([^<]+)</{tag}>', 1)"
    return joined(f"list_filter(list_transform({found}, lambda r: {strip('r')}), lambda r: r <> '')")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{SPACE_CLASS}]+'), lambda w: w <> '')"


# --- keyword classification ------------------------------------------------------------------


def hits(relation: str, id_col: str, text: str, dictionary=WORDS, lower: bool = True, name: str = "hits") -> str:
    """CTEs ending in `hits(id, subject, ord, n, hits, chars)`: one row per text and subject."""
    kw = "lower(k.keyword)" if lower else "k.keyword"
    return (
        f"{name}_kw(subject, ord, kw_ord, keyword) AS ({values_table(dictionary)}), "
        f"{name} AS (SELECT t.id, k.subject, k.ord, count(*) AS n, "
        f"sum(CASE WHEN contains(t.low, {kw}) THEN 1 ELSE 0 END)::BIGINT AS hits, any_value(t.chars) AS chars "
        f"FROM (SELECT {id_col} AS id, lower({text}) AS low, length({text}) AS chars FROM {relation}) t, {name}_kw k "
        f"GROUP BY t.id, k.subject, k.ord)"
    )


def classified(relation: str, id_col: str, text: str, name: str = "c1") -> str:
    """CTEs ending in `c1(id, subject, confidence)`."""
    score = "least(hits::DOUBLE / n * CASE WHEN chars > 1000 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END, 1.0::DOUBLE)"
    return (
        hits(relation, id_col, text, name=f"{name}_h")
        + f", {name} AS (SELECT id, CASE WHEN score > 0 THEN subject ELSE '未知' END AS subject, score * 10 AS confidence "
        f"FROM (SELECT id, subject, ord, {score} AS score FROM {name}_h) "
        f"QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) = 1)"
    )


# Smoothed keyword counts as class probabilities; `m` has the arg-max class.
PROBS = (
    hits("documents", "doc_id", "text", name="ph")
    + ", probs AS (SELECT id, subject, ord, (hits + 1)::DOUBLE / (sum(hits) OVER (PARTITION BY id) + 4)::DOUBLE AS p FROM ph)"
    ", m AS (SELECT id, subject AS model_subject, p AS model_confidence FROM probs "
    "QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, ord) = 1)"
)
C1 = classified("documents", "doc_id", "text")
SCORED = C1 + (
    ", s AS (SELECT d.doc_id, d.text, d.lang AS label, d.source, d.n_chars, d.n_chars / 1000.0::DOUBLE AS seconds, "
    "c1.subject, c1.confidence FROM documents d JOIN c1 ON c1.id = d.doc_id)"
)

# --- evaluation --------------------------------------------------------------------------------


def class_table(source: str, by: str = "") -> str:
    """CTE `ct` with per-class counts and scores from rows (label, prediction)."""
    keys = f"{by}, " if by else ""
    return (
        f"ct AS (SELECT *, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS precision, "
        f"CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS recall, "
        f"CASE WHEN predicted + support > 0 THEN 2.0::DOUBLE * tp / (predicted + support) ELSE 0 END AS f1 FROM ("
        f"SELECT {keys}class, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted, sum(tp)::BIGINT AS tp FROM ("
        f"SELECT {keys}label AS class, 1 AS support, 0 AS predicted, (label = prediction)::INT AS tp FROM {source} "
        f"UNION ALL SELECT {keys}prediction, 0, 1, 0 FROM {source}) GROUP BY {keys}class))"
    )


EVAL = f"WITH {SCORED}, e AS (SELECT label, subject AS prediction FROM s), {class_table('e')} "

# --- keywords per class ---------------------------------------------------------------------------

STOP_SQL = sql_list(STOPWORDS)


def class_terms(relation: str, label: str, text: str, n: int | None, name: str) -> str:
    return (
        f"{name} AS (SELECT subject, o.ord AS subject_ord, (rn - 1)::INT AS kw_ord, keyword, n FROM ("
        f"SELECT subject, keyword, n, row_number() OVER (PARTITION BY subject ORDER BY n DESC, keyword) AS rn FROM ("
        f"SELECT {label} AS subject, keyword, count(*) AS n FROM (SELECT {label}, "
        f"unnest(regexp_extract_all(lower({text}), '([{WORD_CLASS}]+)', 1)) AS keyword FROM {relation}) "
        f"WHERE NOT list_contains({STOP_SQL}, keyword) GROUP BY ALL)) "
        f"JOIN (SELECT * FROM ({order_table(SUBJECTS)}) t(subject, ord)) o USING (subject) WHERE {'true' if n is None else f'rn <= {n}'})"
    )


DOC_DICT_30 = class_terms("documents", "lang", "text", 30, "dict")
DOC_DICT = class_terms("documents", "lang", "text", None, "dict")


def lattice_terms(terms) -> str:
    """The scored terms of a lattice as a list of structs."""
    rows = [f"{{'term': {quoted(t)}, 'score': {s}::BIGINT, 'size': {len(t)}}}" for b in Lattice.of(terms).buckets for t, s in b]
    return "[" + ", ".join(rows) + "]"


# Best rests of a run from its end on; `cut(run, ws)` has the words of every distinct run.
_SINGLE = f"{{'score': {Lattice.of(PARTICLES).letter}::BIGINT + acc[1].score, 'size': 1, 'words': substr(run, i, 1) || acc[1].words}}"
_ARC = "{'score': t.score + acc[t.size].score, 'size': t.size, 'words': ' +' || t.term || ' ' || acc[t.size].words}"
LATTICE_WALK = (
    f"tm AS (SELECT {lattice_terms(PARTICLES)} AS terms), "
    f"rs AS (SELECT doc_id AS id, regexp_extract_all({clean('text')}, '([{LETTERS}]+)', 1) AS runs FROM documents), "
    "run AS (SELECT * FROM (SELECT id, unnest(runs) AS run, generate_subscripts(runs, 1) AS pos FROM rs) WHERE length(run) >= 2), "
    "walk(run, i, acc) AS (SELECT DISTINCT run, length(run), [{'score': 0::BIGINT, 'size': 0, 'words': ''}] FROM run UNION ALL "
    f"SELECT run, i - 1, list_prepend(list_sort(list_prepend({_SINGLE}, list_transform(list_filter(terms, lambda t: starts_with(substr(run, i), t.term)), "
    f"lambda t: {_ARC})), 'DESC')[1], acc) FROM walk, tm WHERE i > 0), "
    "cut AS (SELECT run, flatten(list_transform(list_filter(string_split(acc[1].words, ' '), lambda p: p <> ''), lambda p: "
    "CASE WHEN p[1] = '+' THEN [substr(p, 2)] ELSE list_transform(range(1, length(p)), lambda j: substr(p, j, 2)) END)) AS ws FROM walk WHERE i = 0)"
)

FOLDER = "list_extract(string_split(url, '/'), -2)"
PAGES = f"pg AS (SELECT page_id, url, html, {FOLDER} AS label FROM pages)"
BASE_NAME = "list_extract(string_split(url, '/'), -1)"


def is_in(column: str, values) -> str:
    return f"{column} IN (" + ", ".join(quoted(v) for v in values) + ")"


INFO = (
    f"WITH {PAGES}, lab AS (SELECT label, {BASE_NAME} AS name, url FROM pg WHERE {is_in('label', SUBJECTS_AND_ABSENT)}), "
    f"o AS (SELECT * FROM ({order_table(SUBJECTS_AND_ABSENT)}) t(label, ord)), "
    "c AS (SELECT label, count(*) AS n FROM lab GROUP BY label), "
    "x AS (SELECT label, string_agg(name, ',' ORDER BY rn) AS examples FROM (SELECT label, name, "
    "row_number() OVER (PARTITION BY label ORDER BY name, url) AS rn FROM lab) WHERE rn <= 5 GROUP BY label), "
    "info AS (SELECT o.label, coalesce(c.n, 0) AS n, coalesce(x.examples, '') AS examples "
    "FROM o LEFT JOIN c USING (label) LEFT JOIN x USING (label)) "
)


def hash_ranked(relation: str, label: str, id_col: str, columns: str, seed: int = 42) -> str:
    return (
        f"ranked AS (SELECT {columns}, row_number() OVER (PARTITION BY {label} "
        f"ORDER BY md5('{seed}:' || {id_col}::VARCHAR), {id_col}) AS rn FROM {relation} WHERE {is_in(label, SUBJECTS)})"
    )


# --- decks built from documents -------------------------------------------------------------------

LINES = (
    "ln AS (SELECT doc_id, i::INT AS line, "
    + strip("parts[i]")
    + " AS text, parts[i] AS raw FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"
)
BROKEN = "bad AS (SELECT doc_id FROM labels WHERE toxic = 1)"
DECK_PATH = "'decks/' || doc_id::VARCHAR || '.pptx'"


def line_texts(n: int) -> str:
    return (
        f"lt AS (SELECT d.doc_id, coalesce(t.text, '') AS text FROM documents d LEFT JOIN (SELECT doc_id, "
        f"string_agg(text, ' ' ORDER BY line) AS text FROM ln WHERE line <= {n} AND text <> '' GROUP BY doc_id) t USING (doc_id))"
    )


# --- TF-IDF ------------------------------------------------------------------------------------------


def tfidf(relation: str, id_col: str, text: str) -> str:
    """CTEs ending in `vocab(term, tf, df, n_docs, idf)` and `weights(id, term, w)`."""
    return (
        f"tk AS (SELECT {id_col} AS id, regexp_extract_all(lower({text}), '([{WORD_CLASS}]{{2,}})', 1) AS toks FROM {relation}), "
        "flat AS (SELECT id, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos FROM tk), "
        "led AS (SELECT id, t, lead(t, 1) OVER w AS t2, lead(t, 2) OVER w AS t3, lead(t, 3) OVER w AS t4 "
        "FROM flat WINDOW w AS (PARTITION BY id ORDER BY pos)), "
        "grams AS (SELECT id, t AS term FROM led UNION ALL SELECT id, t || ' ' || t2 FROM led WHERE t2 IS NOT NULL "
        "UNION ALL SELECT id, t || ' ' || t2 || ' ' || t3 FROM led WHERE t3 IS NOT NULL "
        "UNION ALL SELECT id, t || ' ' || t2 || ' ' || t3 || ' ' || t4 FROM led WHERE t4 IS NOT NULL), "
        "dt AS (SELECT id, term, count(*) AS c FROM grams GROUP BY id, term), "
        f"nd AS (SELECT count(*) AS n_docs FROM {relation}), "
        "vocab AS (SELECT term, tf, df, n_docs, ln((1 + n_docs)::DOUBLE / (1 + df)) + 1 AS idf FROM ("
        "SELECT term, sum(c)::BIGINT AS tf, count(*) AS df FROM dt GROUP BY term), nd "
        "WHERE df >= 2 AND df <= 0.9::DOUBLE * n_docs ORDER BY tf DESC, term LIMIT 1500), "
        "raw AS (SELECT id, term, c * idf AS w FROM dt JOIN vocab USING (term)), "
        "weights AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"
    )


def chars(x: str, pattern: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{pattern}', '', 'g')))"


def stats(relation: str, key: str, text: str) -> str:
    """CTEs ending in `stats` with the ten statistics of each text."""
    return (
        f"base AS (SELECT {key}, length({text})::INT AS text_length, "
        f"len({words(text)})::INT AS word_count, {chars(text, f'[{HAN_CLASS}]+')}::INT AS chinese_chars, "
        f"{chars(text, '[a-zA-Z]+')}::INT AS english_chars, {chars(text, chr(92) + 'p{Nd}+')}::INT AS digit_chars, "
        f"{chars(text, f'[^{WORD_CLASS}{SPACE_CLASS}]+')}::INT AS symbol_chars FROM {relation}), "
        "stats AS (SELECT *, text_length::DOUBLE / greatest(word_count, 1) AS avg_word_length, "
        "chinese_chars::DOUBLE / greatest(text_length, 1) AS chinese_ratio, "
        "english_chars::DOUBLE / greatest(text_length, 1) AS english_ratio, "
        "digit_chars::DOUBLE / greatest(text_length, 1) AS digit_ratio FROM base)"
    )


STATS = stats("documents", "doc_id", "text")
STAT_ORDER = [
    "text_length", "word_count", "avg_word_length", "chinese_chars", "english_chars",
    "digit_chars", "symbol_chars", "chinese_ratio", "english_ratio", "digit_ratio",
]
# `cell(id, idx, name, v)`: entries of the assembled vectors; `top(rank, idx, name, variance)` over all positions.
ASSEMBLED = (
    f"{processed('documents', 'doc_id', 'text', 'pt')}, {tfidf('pt', 'id', 'text')}, {stats('pt', 'id', 'text')}, "
    + hits("pt", "id", "text", WORDS, False)
    + ", vi AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, count(*) OVER () AS n FROM vocab), "
    "cell AS (SELECT id, idx, term AS name, w AS v FROM weights JOIN vi USING (term) UNION ALL "
    + " UNION ALL ".join(f"SELECT id, (SELECT any_value(n) FROM vi) + {i}, '{n}', {n}::DOUBLE FROM stats" for i, n in enumerate(STAT_ORDER))
    + f" UNION ALL SELECT id, (SELECT any_value(n) FROM vi) + {len(STAT_ORDER)} + ord, subject, hits::DOUBLE FROM hits), "
    "sums AS (SELECT idx, name, count(*) / any_value(n_docs)::DOUBLE AS share, avg(v) AS mean, var_pop(v) AS spread FROM cell, nd WHERE v <> 0 GROUP BY idx, name), "
    "top AS (SELECT row_number() OVER (ORDER BY variance DESC, idx)::INT AS rank, * FROM "
    "(SELECT idx, name, share * spread + share * (1 - share) * mean * mean AS variance FROM sums))"
)

CENTROIDS = (
    "cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS feature FROM embeddings), "
    "coef AS (SELECT label AS class, feature::INT AS feature, avg(v) AS value FROM cells GROUP BY ALL), "
    "shift AS (SELECT class, sum(value * value) * -0.5::DOUBLE AS value FROM coef GROUP BY class), "
    "imp AS (SELECT feature, max(abs(value)) AS importance FROM coef GROUP BY feature), "
    "kept AS (SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature)::INT AS rank FROM imp)"
)


def per_subject(column: str, cast: str = "INT") -> str:
    return ", ".join(
        f"max(CASE WHEN subject = '{s}' THEN {column} END)::{cast} AS {{prefix}}{s}" for s in SUBJECTS
    )


def counts_wide(dictionary, lower: bool, cast: str = "INT") -> str:
    return (
        "WITH " + hits("documents", "doc_id", "text", dictionary, lower)
        + f" SELECT id AS doc_id, {per_subject('hits', cast).format(prefix='n_')} FROM hits GROUP BY id"
    )


def rank_scores(rounded_kind: str, shift_kind: str, top: str) -> str:
    return (
        f"SELECT c.vec_id, c.label, k.class, sum(c.v * k.value::{rounded_kind}::DOUBLE) + any_value(s.value::{shift_kind}::DOUBLE) AS score "
        f"FROM cells c JOIN coef k USING (feature) JOIN shift s USING (class) {top} GROUP BY c.vec_id, c.label, k.class"
    )


def half(x: str) -> str:
    """A value rounded to half precision: 11 significant bits, none below 2^-24."""
    unit = f"pow(2.0::DOUBLE, greatest(floor(log2(abs({x}))), -14) - 10)"
    return f"CASE WHEN {x} = 0 THEN 0 ELSE round_even({x} / {unit}, 0) * {unit} END"


def best_class(scores: str) -> str:
    return (
        f"SELECT vec_id, label, class FROM ({scores}) "
        "QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) = 1"
    )


ERRORS = (
    f"WITH {PROBS}, er AS (SELECT d.doc_id, d.lang AS true_label, m.model_subject AS predicted_label, "
    "t.p AS true_prob, m.model_confidence AS pred_prob, "
    "CASE WHEN length(d.text) > 100 THEN substr(d.text, 1, 100) || '...' ELSE d.text END AS sample "
    "FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN probs t ON t.id = d.doc_id AND t.subject = d.lang "
    "WHERE d.lang <> m.model_subject) "
)

# Test rows per class by the split's own rule; the rest of these rows are checks that must hold.
QUOTAS = (
    f"cl AS (SELECT lang AS label, count(*) AS n FROM documents WHERE {is_in('lang', SUBJECTS)} GROUP BY lang), "
    "tr AS (SELECT label, n, sum(n) OVER () AS total FROM cl), "
    "ex AS (SELECT label, n, total, n::DOUBLE / total * (total - ceil(0.2::DOUBLE * total)) AS exact, "
    "total - ceil(0.2::DOUBLE * total) AS n_train FROM tr), "
    "quota AS (SELECT label, n - floor(exact) - (row_number() OVER (ORDER BY exact - floor(exact) DESC, label) "
    "<= n_train - sum(floor(exact)) OVER ())::INT AS quota FROM ex)"
)
# Test rows of the split and whether the keyword classifier hits them.
TEST_ROWS = (
    f"{hash_ranked('documents', 'lang', 'doc_id', 'doc_id, lang AS label')}, {QUOTAS}, {C1}, "
    "test AS (SELECT r.label, (c1.subject = r.label) AS baseline FROM ranked r JOIN quota USING (label) JOIN c1 ON c1.id = r.doc_id WHERE rn <= quota)"
)
HELD_OUT = f"WITH {TEST_ROWS} SELECT label, count(*) AS n_test, sum(baseline::INT)::BIGINT AS baseline_hits, "

SQL: dict[str, str] = {
    # sources, extraction
    "deck_scan": "SELECT page_id, url AS path FROM pages WHERE lower(url) LIKE '%.html' OR lower(url) LIKE '%.htm'",
    "labelled_scan": f"WITH {PAGES} SELECT page_id, url AS path, label FROM pg WHERE {is_in('label', ['en', 'fr', 'de'])}",
    "dict_load": f"WITH {DOC_DICT_30} SELECT subject, subject_ord::INT AS subject_ord, kw_ord, keyword FROM dict",
    "stopword_load": (
        f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '([{WORD_CLASS}]+)', 1)) AS word "
        f"FROM documents) WHERE list_contains({sql_list([*STOPWORDS, *STOPWORDS_ENGLISH, *CUSTOM_STOP])}, word) GROUP BY word"
    ),
    "slide_extract": (
        f"WITH {LINES}, {BROKEN} SELECT {DECK_PATH} AS path, line AS slide_idx, text, false AS failed FROM ln "
        f"WHERE line <= 50 AND doc_id NOT IN (SELECT doc_id FROM bad) "
        f"UNION ALL SELECT {DECK_PATH}, NULL, '', true FROM documents WHERE doc_id IN (SELECT doc_id FROM bad)"
    ),
    "markup_runs": f"SELECT page_id, {runs('html', 'p')} AS text FROM pages",
    "deck_text": (
        "SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (text <> ''), '') AS text FROM ("
        "SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) "
        "WHERE rn <= 50 GROUP BY conv_id"
    ),
    "slide_count": (
        "SELECT d.doc_id AS conv_id, coalesce(c.n, 0) AS slides FROM documents d LEFT JOIN ("
        "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c ON c.conv_id = d.doc_id"
    ),
    "slide_images": (
        f"WITH {LINES}, {BROKEN} SELECT {DECK_PATH} AS path, (line - 1)::INT AS slide_idx, (line - 1)::INT AS img_no, "
        "'slide_' || (line - 1) || '_img_' || (line - 1) || '.png' AS name, '.png' AS ext, (8 + strlen(raw))::INT AS n_bytes "
        "FROM ln WHERE line <= 10 AND doc_id NOT IN (SELECT doc_id FROM bad)"
    ),
    "text_fallback": f"SELECT page_id, coalesce(nullif({runs('html', 'p')}, ''), {runs('html', 'title')}) AS text FROM pages",
    "extract_corpus": (
        f"WITH {LINES}, {line_texts(30)} SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN lt.text ELSE d.text END AS text, "
        "l.doc_id IS NOT NULL AS reused FROM documents d JOIN lt USING (doc_id) LEFT JOIN labels l USING (doc_id)"
    ),
    # sinks
    "write_results_csv": (
        f"WITH {SCORED} SELECT source || '/' || doc_id::VARCHAR AS path, subject, round(confidence, 6) AS confidence, "
        "round(seconds, 6) AS seconds FROM s"
    ),
    "write_dataset_info": INFO + "SELECT label, n, (SELECT sum(n) FROM info)::BIGINT AS total_files, examples FROM info",
    "write_mini_csv": (
        f"WITH {PAGES}, {hash_ranked('pg', 'label', 'page_id', 'url, label')} SELECT url AS file_path, label FROM ranked WHERE rn <= 10"
    ),
    "save_dictionary": (
        f"WITH {DOC_DICT_30} SELECT '{{' || string_agg('\"' || subject || '\":[' || kws || ']', ',' ORDER BY subject_ord) || '}}' AS json "
        "FROM (SELECT subject, subject_ord, string_agg('\"' || keyword || '\"', ',' ORDER BY kw_ord) AS kws FROM dict GROUP BY ALL)"
    ),
    "model_save_load": (
        f"WITH {tfidf('documents', 'doc_id', 'text')} SELECT d.doc_id, count(w.term)::INT AS terms "
        "FROM documents d LEFT JOIN weights w ON w.id = d.doc_id GROUP BY d.doc_id"
    ),
    # text
    "basic_clean": f"SELECT doc_id, {clean('text')} AS clean FROM documents",
    "han_runs": (
        f"SELECT doc_id, {joined(f'regexp_extract_all({clean("text")}, {quoted(f"([{ACCENTS}]+)")}, 1)')} AS runs, "
        f"{joined(f'regexp_extract_all(text, {quoted(f"([{HAN_CLASS}]+)")}, 1)')} AS han FROM documents"
    ),
    "latin_words": f"SELECT doc_id, {joined('regexp_extract_all(text, ' + quoted('([a-zA-Z]{2,})') + ', 1)')} AS words FROM documents",
    "english_filter": f"SELECT doc_id, {joined(english(clean('text')))} AS words FROM documents",
    "han_segment": f"SELECT doc_id, {joined(pairs(clean('text'), ACCENTS))} AS pairs FROM documents",
    "han_lattice": (
        f"WITH RECURSIVE {LATTICE_WALK}, found AS (SELECT id, pos, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM run JOIN cut USING (run)) "
        f"SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY pos, k) FILTER (NOT list_contains({STOP_SQL}, w)), '') AS words "
        "FROM documents LEFT JOIN found ON id = doc_id GROUP BY doc_id"
    ),
    "process_text": (
        f"WITH {processed('documents', 'doc_id', 'text', 'pt')} SELECT pt.id AS doc_id, pt.text, "
        f"(CASE WHEN len({pairs('pt_c.c', HAN_CLASS)}) > 0 THEN length({joined(pairs('pt_c.c', HAN_CLASS))}) ELSE length(pt_c.c) END)::INT "
        "AS chinese_only_chars FROM pt JOIN pt_c USING (id)"
    ),
    "segment_dict": (
        f"WITH {DOC_DICT} SELECT subject, kw_ord, keyword FROM dict WHERE length(keyword) >= 2 "
        "AND regexp_matches(keyword, '[^\\x{00}-\\x{7f}]')"
    ),
    "doc_keywords": (
        f"WITH {processed('documents', 'doc_id', 'text', 'pt')}, tk AS (SELECT id, unnest(string_split(text, ' ')) AS token, "
        "generate_subscripts(string_split(text, ' '), 1) AS pos FROM pt), "
        f"ct AS (SELECT id, token, count(*) AS n, min(pos) AS first FROM tk WHERE length(token) >= 2 "
        f"AND NOT list_contains({STOP_SQL}, token) GROUP BY id, token) "
        "SELECT id AS doc_id, rank::INT AS rank, token, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS rank "
        "FROM ct) WHERE rank <= 20"
    ),
    "jaccard": (
        f"WITH cv AS (SELECT conv_id, turn, text, conv_id::VARCHAR || ':' || turn::VARCHAR AS k FROM conversations), "
        f"{processed('cv', 'k', 'text', 'pt')}, sets AS (SELECT cv.conv_id, cv.turn, "
        "list_distinct(list_filter(string_split(pt.text, ' '), lambda w: w <> '')) AS toks FROM cv JOIN pt ON pt.id = cv.k) "
        "SELECT a.conv_id, a.turn, round(CASE WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0 ELSE "
        "len(list_intersect(a.toks, b.toks))::DOUBLE / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) END, 6) AS similarity "
        "FROM sets a JOIN sets b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
    ),
    "similar_pairs": (
        f"WITH {processed('documents', 'doc_id', 'text', 'pd')}, {processed('benchmark', 'item_id', 'text', 'pb')}, "
        + ", ".join(
            f"{name} AS (SELECT id, list_distinct(list_filter(string_split(text, ' '), lambda w: w <> '')) AS t FROM {source})"
            for name, source in (("ds", "pd"), ("bs", "pb"))
        )
        + ", pr AS (SELECT a.id AS doc_id, b.id AS item_id, len(list_intersect(a.t, b.t)) AS n_both, len(a.t) + len(b.t) AS total FROM ds a, bs b "
        f"WHERE len(a.t) > 0 AND len(b.t) > 0) SELECT doc_id, item_id, round(n_both::DOUBLE / (total - n_both), 6) AS similarity FROM pr "
        f"WHERE n_both::DOUBLE / (total - n_both) >= {SIMILAR}::DOUBLE"
    ),
    # datasets
    "limit_per_class": (
        f"WITH {hash_ranked('documents', 'lang', 'doc_id', 'doc_id, lang AS label')} SELECT doc_id, label FROM ranked WHERE rn <= 100"
    ),
    "stratified_split": (
        f"WITH {hash_ranked('documents', 'lang', 'doc_id', 'doc_id, lang AS label')}, {QUOTAS} "
        "SELECT doc_id, r.label, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS part FROM ranked r JOIN quota USING (label)"
    ),
    "class_subset": (
        f"WITH {hash_ranked('documents', 'lang', 'doc_id', 'doc_id, lang AS label, source')} "
        "SELECT doc_id, label, source FROM ranked WHERE label = 'fr' AND rn <= 40"
    ),
    "class_distribution": "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang",
    "analyze_dataset": (
        f"WITH o AS (SELECT * FROM ({order_table(SUBJECTS_AND_ABSENT)}) t(label, ord)), "
        f"c AS (SELECT lang AS label, count(*) AS n FROM documents WHERE {is_in('lang', SUBJECTS_AND_ABSENT)} GROUP BY lang), "
        "x AS (SELECT sum(n)::BIGINT AS total, max(n)::DOUBLE / greatest(min(n), 1) AS imbalance FROM c) "
        "SELECT o.label, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0)::DOUBLE / total * 100, 6) AS percent, total, "
        "round(imbalance, 6) AS imbalance, imbalance > 3 AS unbalanced FROM o LEFT JOIN c USING (label), x"
    ),
    "mini_dataset": (
        f"WITH {hash_ranked('documents', 'lang', 'doc_id', 'doc_id, lang AS label')} SELECT doc_id, label FROM ranked WHERE rn <= 10"
    ),
    "dataset_info": INFO + "SELECT * FROM info",
    "label_encode": (
        "SELECT doc_id, lang AS label, c.code::INT AS code FROM documents JOIN (SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS code "
        "FROM (SELECT DISTINCT lang FROM documents)) c USING (lang)"
    ),
    "label_decode": (
        "SELECT doc_id, c.code::INT AS code, lang AS decoded FROM documents JOIN (SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS code "
        "FROM (SELECT DISTINCT lang FROM documents)) c USING (lang)"
    ),
    "encoded_distribution": (
        "SELECT (dense_rank() OVER (ORDER BY lang) - 1)::INT AS code, n, lang AS label FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)"
    ),
    # features
    "tfidf_vocab": (
        f"WITH {tfidf('documents', 'doc_id', 'text')} SELECT (row_number() OVER (ORDER BY term) - 1)::INT AS idx, term, tf, df, "
        "round(idf, 6) AS idf FROM vocab"
    ),
    "tfidf_transform": f"WITH {tfidf('documents', 'doc_id', 'text')} SELECT id AS doc_id, term, round(w, 6) AS weight FROM weights",
    "stat_features": (
        f"WITH {STATS} SELECT doc_id, text_length, word_count, round(avg_word_length, 6) AS avg_word_length, chinese_chars, english_chars, "
        "digit_chars, symbol_chars, round(chinese_ratio, 6) AS chinese_ratio, round(english_ratio, 6) AS english_ratio, "
        "round(digit_ratio, 6) AS digit_ratio FROM stats"
    ),
    "keyword_features": counts_wide(MIXED_CASE, False),
    "embedding_attach": (
        "SELECT d.doc_id, e.vec_id IS NOT NULL AS has_embedding, 64::INT AS width, "
        "round(coalesce(list_sum(e.embedding::DOUBLE[]), 0), 6) AS total FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"
    ),
    "feature_assemble": (
        "WITH " + hits("documents", "doc_id", "text", WORDS, False)
        + " SELECT d.doc_id, 78::INT AS width, length(d.text)::DOUBLE AS text_length, h.hits::DOUBLE AS n_en, "
        "round(coalesce(e.embedding[64]::DOUBLE, 0), 6) AS last FROM documents d JOIN hits h ON h.id = d.doc_id AND h.subject = 'en' "
        "LEFT JOIN embeddings e ON e.vec_id = d.doc_id"
    ),
    "variance_topk": f"WITH {ASSEMBLED} SELECT rank, name, round(variance, 4) AS variance FROM top WHERE rank <= {SELECTED}",
    "apply_selection": (
        f"WITH {ASSEMBLED} SELECT id AS doc_id, rank, round(v, 6) AS value FROM cell JOIN top USING (idx) WHERE rank <= {SELECTED} AND v <> 0"
    ),
    "extract_selected": (
        f"WITH {ASSEMBLED} SELECT id AS doc_id, cell.name, round(v, 6) AS value FROM cell JOIN top USING (idx) WHERE rank <= {SELECTED} AND v <> 0"
    ),
    "align_width": (
        "SELECT vec_id, 32::INT AS width_32, round(list_sum(embedding[1:32]::DOUBLE[]), 6) AS total_32, 80::INT AS width_80, "
        "round(list_sum(embedding::DOUBLE[]), 6) AS total_80 FROM embeddings"
    ),
    "feature_importance": (
        f"WITH {CENTROIDS} SELECT feature, 'dim_' || feature AS name, round(avg(abs(value)), 6) AS importance FROM coef GROUP BY feature"
    ),
    "extract_features": (
        f"WITH {processed('documents', 'doc_id', 'text', 'pt')}, {tfidf('pt', 'id', 'text')}, "
        + hits("pt", "id", "text", WORDS, False)
        + ", wc AS (SELECT id, count(*) AS terms, sum(w) AS total FROM weights GROUP BY id) SELECT pt.id AS doc_id, coalesce(wc.terms, 0)::INT AS tfidf_terms, "
        "round(coalesce(wc.total, 0), 6) AS tfidf_total, "
        f"length(pt.text)::DOUBLE AS text_length, len({words('pt.text')})::DOUBLE AS word_count, h.hits::DOUBLE AS n_en "
        "FROM pt LEFT JOIN wc USING (id) JOIN hits h ON h.id = pt.id AND h.subject = 'en'"
    ),
    "light_features": (
        "WITH " + hits("documents", "doc_id", "text", WORDS, False)
        + f" SELECT id AS doc_id, 100::INT AS width, {per_subject('hits', 'DOUBLE').format(prefix='n_')}, sum(hits)::DOUBLE AS total "
        "FROM hits GROUP BY id"
    ),
    # classification
    "keyword_classify": f"WITH {SCORED} SELECT doc_id, label, subject, round(confidence, 6) AS confidence FROM s",
    "keyword_classify_wide": (
        f"WITH {class_terms('documents', 'lang', 'text', WIDE_ENTRIES, 'dict')}, sz AS (SELECT subject, count(*) AS size FROM dict GROUP BY subject), "
        "low AS (SELECT doc_id, lower(text) AS t, length(text) AS chars FROM documents), "
        "hit AS (SELECT doc_id, subject, any_value(subject_ord) AS ord, any_value(chars) AS chars, sum(contains(t, lower(keyword))::INT)::BIGINT AS n "
        "FROM low, dict GROUP BY doc_id, subject), "
        "sc AS (SELECT doc_id, subject, ord, least(n::DOUBLE / size * CASE WHEN chars > 1000 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END, 1.0::DOUBLE) AS score "
        "FROM hit JOIN sz USING (subject)) "
        "SELECT doc_id, CASE WHEN score > 0 THEN subject ELSE '未知' END AS subject, round(score * 10, 6) AS confidence FROM sc "
        "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1"
    ),
    "cascade_classify": (
        f"WITH {SCORED}, {PROBS} SELECT doc_id, label, CASE WHEN confidence > 0.8 OR text = '' THEN subject "
        "WHEN model_confidence >= confidence THEN model_subject ELSE subject END AS subject, "
        "round(CASE WHEN confidence > 0.8 OR text = '' THEN confidence ELSE least(greatest(model_confidence, confidence), 0.99::DOUBLE) END, 6) "
        "AS confidence FROM s JOIN m ON m.id = s.doc_id"
    ),
    "keyword_only": (
        "WITH dk AS (SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (text <> ''), '') AS text FROM ("
        "SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) "
        f"WHERE rn <= 10 GROUP BY conv_id), {classified('dk', 'conv_id', 'text')} "
        "SELECT id AS conv_id, subject, round(confidence, 6) AS confidence FROM c1"
    ),
    "model_classify": f"WITH {PROBS} SELECT id AS doc_id, model_subject, round(model_confidence, 6) AS model_confidence FROM m",
    "batch_classify": (
        f"WITH {LINES}, {BROKEN}, {line_texts(30)}, {classified('lt', 'doc_id', 'text')} SELECT {DECK_PATH} AS path, "
        "CASE WHEN b.doc_id IS NOT NULL THEN '错误' ELSE subject END AS subject, "
        "round(CASE WHEN b.doc_id IS NOT NULL THEN 0 ELSE confidence END, 6) AS confidence "
        "FROM (SELECT id AS doc_id, subject, confidence FROM c1) LEFT JOIN bad b USING (doc_id)"
    ),
    "incremental_classify": (
        f"WITH {SCORED} SELECT s.doc_id, s.n_chars, subject, round(confidence, 6) AS confidence, coalesce(l.toxic = 0, false) AS reused "
        "FROM s LEFT JOIN labels l USING (doc_id)"
    ),
    # training
    "train_teacher": HELD_OUT + "true AS accurate, true AS sums_to_one FROM test GROUP BY label",
    "train_student": HELD_OUT + "true AS accurate FROM test GROUP BY label",
    "distill": HELD_OUT + "true AS agrees, true AS accurate FROM test GROUP BY label",
    "train_job": (
        f"WITH {TEST_ROWS} SELECT model, n_test, baseline, true AS accurate FROM (VALUES ('teacher'), ('student'), ('reduced')) t(model), "
        "(SELECT count(*) AS n_test, round(avg(baseline::INT), 6) AS baseline FROM test)"
    ),
    "temperature_scale": (
        f"WITH {PROBS}, pw AS (SELECT id, subject, pow(least(greatest(p, 1e-10::DOUBLE), 1 - 1e-10::DOUBLE), 0.5::DOUBLE) AS q FROM probs), "
        "tp AS (SELECT id, subject, q / sum(q) OVER (PARTITION BY id) AS q FROM pw) SELECT id AS doc_id, "
        + ", ".join(f"round(max(CASE WHEN subject = '{s}' THEN q END), 6) AS p_{s}" for s in SUBJECTS)
        + " FROM tp GROUP BY id"
    ),
    "distill_eval": (
        f"WITH {SCORED}, {PROBS} SELECT round(avg((subject = label)::INT), 6) AS teacher_accuracy, "
        "round(avg((model_subject = label)::INT), 6) AS student_accuracy FROM s JOIN m ON m.id = s.doc_id"
    ),
    "agreement_rate": (
        f"WITH {SCORED}, {PROBS} SELECT round(avg((subject = model_subject)::INT), 6) AS agreement FROM s JOIN m ON m.id = s.doc_id"
    ),
    "topk_coef": f"WITH {CENTROIDS} SELECT feature, round(importance, 6) AS importance, rank FROM kept WHERE rank <= 32",
    "reduced_eval": (
        f"WITH {CENTROIDS}, full_best AS ({best_class(rank_scores('DOUBLE', 'DOUBLE', ''))}), small_best AS ("
        f"{best_class(rank_scores('FLOAT', 'FLOAT', 'JOIN kept t ON t.feature = c.feature AND t.rank <= 32'))}), "
        "acc AS (SELECT (SELECT avg((label = class)::INT) FROM full_best) AS f, (SELECT avg((label = class)::INT) FROM small_best) AS r) "
        "SELECT round(f, 6) AS full_accuracy, round(r, 6) AS reduced_accuracy, round(r - f, 6) AS change FROM acc"
    ),
    "reduced_eval_half": (
        f"WITH {CENTROIDS}, half_coef AS (SELECT class, feature, {half('value')} AS value FROM coef), "
        f"half_shift AS (SELECT class, {half('value')} AS value FROM shift), full_best AS ({best_class(rank_scores('DOUBLE', 'DOUBLE', ''))}), "
        "half_score AS (SELECT c.vec_id, c.label, k.class, sum(c.v * k.value) + any_value(s.value) AS score FROM cells c "
        "JOIN half_coef k USING (feature) JOIN half_shift s USING (class) JOIN kept t ON t.feature = c.feature AND t.rank <= 32 GROUP BY ALL), "
        "small_best AS (SELECT vec_id, label, class FROM half_score QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) = 1), "
        "acc AS (SELECT (SELECT avg((label = class)::INT) FROM full_best) AS f, (SELECT avg((label = class)::INT) FROM small_best) AS r) "
        "SELECT round(f, 6) AS full_accuracy, round(r, 6) AS reduced_accuracy, round(r - f, 6) AS change FROM acc"
    ),
    # evaluation
    "accuracy": EVAL + "SELECT round(avg((label = prediction)::INT), 6) AS accuracy FROM e",
    "macro_metrics": (
        EVAL + "SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision_macro, "
        "round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro FROM ct"
    ),
    "class_metrics": EVAL + "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ct",
    "confusion_matrix": (
        EVAL + "SELECT a.class AS label, b.class AS prediction, (SELECT count(*) FROM e WHERE e.label = a.class AND e.prediction = b.class) AS n "
        "FROM ct a, ct b"
    ),
    "classification_report": (
        EVAL + "SELECT class AS name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ct "
        "UNION ALL SELECT 'accuracy', round(sum(tp)::DOUBLE / sum(support), 6), round(sum(tp)::DOUBLE / sum(support), 6), "
        "round(sum(tp)::DOUBLE / sum(support), 6), sum(support)::BIGINT FROM ct "
        "UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM ct "
        "UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), "
        "round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM ct"
    ),
    "compare_models": (
        f"WITH {SCORED}, {PROBS}, e AS (SELECT 'keyword' AS model, label, subject AS prediction FROM s "
        f"UNION ALL SELECT 'counts', label, model_subject FROM s JOIN m ON m.id = s.doc_id), {class_table('e', 'model')} "
        "SELECT model, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro FROM ct GROUP BY model"
    ),
    "analyze_errors": (
        ERRORS + "SELECT doc_id, true_label, predicted_label, round(true_prob, 6) AS true_prob, round(pred_prob, 6) AS pred_prob, sample FROM er"
    ),
    "top_errors": (
        ERRORS + "SELECT doc_id, true_label, predicted_label, coalesce(printf('%.3f', true_prob), 'N/A') AS true_prob, "
        "coalesce(printf('%.3f', pred_prob), 'N/A') AS pred_prob, sample FROM er ORDER BY doc_id LIMIT 20"
    ),
    # dictionaries and reports
    "class_keywords": f"WITH {DOC_DICT_30} SELECT subject, kw_ord, keyword, n FROM dict",
    "merge_dict": (
        f"WITH {DOC_DICT}, {PAGES}, pt AS (SELECT label, {runs('html', 'p')} AS text FROM pg WHERE {is_in('label', SUBJECTS)}), "
        f"{class_terms('pt', 'label', 'text', None, 'fresh')}, base(subject, ord, kw_ord, keyword) AS ({values_table(WORDS)}), "
        "al AS (SELECT subject, keyword FROM dict UNION SELECT subject, keyword FROM fresh), "
        "fl AS (SELECT subject, keyword, EXISTS (SELECT 1 FROM base b WHERE b.subject = al.subject AND b.keyword = al.keyword) AS is_base FROM al) "
        "SELECT subject, (rn - 1)::INT AS kw_ord, keyword FROM (SELECT subject, keyword, row_number() OVER (PARTITION BY subject "
        "ORDER BY length(keyword) DESC, is_base DESC, keyword) AS rn FROM fl) WHERE rn <= 50"
    ),
    "keyword_hit_rate": (
        f"WITH kw(subject, ord, kw_ord, keyword) AS ({values_table(MIXED_CASE)}), dk AS (SELECT DISTINCT subject, keyword FROM kw), "
        "h AS (SELECT d.lang AS label, sum(contains(lower(d.text), k.keyword)::INT)::BIGINT AS hits FROM documents d JOIN dk k ON k.subject = d.lang GROUP BY d.lang), "
        f"w AS (SELECT lang AS label, sum(len({words('lower(text)')}))::BIGINT AS words FROM documents GROUP BY lang) "
        "SELECT label, hits, words, round(hits::DOUBLE / words, 6) AS hit_rate FROM h JOIN w USING (label)"
    ),
    "dict_stats": (
        f"WITH {DOC_DICT} SELECT subject, count(*) AS n, round(avg(length(keyword)), 6) AS avg_length, "
        f"sum(regexp_matches(keyword, '[{HAN_CLASS}]')::INT)::BIGINT AS chinese_count, "
        f"sum((regexp_matches(keyword, '[a-zA-Z]') AND NOT regexp_matches(keyword, '[{HAN_CLASS}]'))::INT)::BIGINT AS english_count, "
        "string_agg(keyword, ',' ORDER BY kw_ord) FILTER (kw_ord < 5) AS examples FROM dict GROUP BY subject"
    ),
    "ambiguous_keywords": (
        f"WITH {DOC_DICT} SELECT keyword, count(*) AS n, string_agg(subject, ',' ORDER BY subject_ord, kw_ord) AS subjects FROM dict "
        "GROUP BY keyword HAVING count(*) > 1"
    ),
    "dict_export": (
        f"WITH {DOC_DICT}, ds AS (SELECT * FROM (VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in DESCRIPTIONS.items())}) t(subject, descr)) "
        "SELECT d.subject, subject_ord::INT AS subject_ord, (kw_ord + (ds.subject IS NOT NULL)::INT)::INT AS kw_ord, keyword FROM dict d LEFT JOIN ds USING (subject) "
        "UNION ALL SELECT DISTINCT d.subject, subject_ord::INT, 0::INT, ds.descr FROM dict d JOIN ds USING (subject)"
    ),
    "subject_report": (
        f"WITH {SCORED}, o AS (SELECT * FROM ({order_table([*SUBJECTS, '未知', '错误'])}) t(subject, ord)), "
        "c AS (SELECT subject, count(*) AS n FROM s GROUP BY subject) SELECT subject, ord::INT AS ord, n, "
        "round(n::DOUBLE / (SELECT count(*) FROM s) * 100, 6) AS percent FROM o JOIN c USING (subject)"
    ),
    "confidence_summary": (
        f"WITH {SCORED} SELECT round(avg(confidence) FILTER (ok), 6) AS avg_confidence, round(max(confidence) FILTER (ok), 6) AS max_confidence, "
        "round(min(confidence) FILTER (ok), 6) AS min_confidence, round(avg(confidence) FILTER (subject <> '未知'), 6) AS avg_known "
        "FROM (SELECT *, confidence > 0 AND subject NOT IN ('未知', '错误') AS ok FROM s)"
    ),
    "confidence_histogram": (
        f"WITH {PROBS}, v AS (SELECT model_confidence AS c FROM m), "
        "b(bin, lo, hi, name) AS (VALUES (0, 0.0, 0.5, '<50%'), (1, 0.5, 0.7, '50-70%'), (2, 0.7, 0.8, '70-80%'), (3, 0.8, 0.9, '80-90%'), (4, 0.9, 1.0, '90-100%')) "
        "SELECT bin::INT AS bin, name, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM v) * 100, 6) AS percent "
        "FROM v JOIN b ON c >= lo::DOUBLE AND c < hi::DOUBLE GROUP BY bin, name"
    ),
    "timing_summary": (
        "WITH t AS (SELECT n_chars / 1000.0::DOUBLE AS x FROM documents) SELECT round(sum(x) FILTER (x > 0), 6) AS total_seconds, "
        "round(avg(x) FILTER (x > 0), 6) AS avg_seconds, round(min(x) FILTER (x > 0), 6) AS min_seconds, round(max(x) FILTER (x > 0), 6) AS max_seconds, "
        "count(*) AS files, round(count(*) / sum(x) FILTER (x > 0), 6) AS files_per_second, round(avg(x), 6) AS avg_seconds_all FROM t"
    ),
    "confidence_band": (
        f"WITH {SCORED} SELECT doc_id, CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence > 0.6 THEN 'medium' ELSE 'low' END AS band FROM s"
    ),
}
