"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

from caselight.functions import text as tx
from caselight.operators import scoring
from caselight.plans import bindings as _b
from caselight.plans.views import _list, query
from caselight.schemas import (
    CLASSIFIER_BOOLEAN, CLASSIFIER_NUMERIC, DRIFT_FEATURES, PRIORITIES, PRIORITY_ADJACENCY,
    SENTIMENT_SCORE, SENTIMENTS, SUBCATEGORIES,
)

ORACLES: dict[str, str] = {}

TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def r6(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name or expr}"


# ---- data quality ---------------------------------------------------------------

_FACTS = "SELECT count(*) AS n, count(DISTINCT ticket_id) AS ids, count(*) FILTER (category IS NULL) AS nulls FROM {}"
_CHECKS = """
    SELECT 'row_count' AS check_name, n > 0 AS passed, n || ' rows' AS details FROM facts
    UNION ALL SELECT 'no_duplicate_ids', ids = n, '' FROM facts
    UNION ALL SELECT 'required_fields', {}, '' FROM facts
    UNION ALL SELECT 'category_not_null', nulls = 0, 'Null: ' || nulls FROM facts"""

ORACLES["dq_report"] = query(
    "tickets_d", _CHECKS.format("true"), {"facts": _FACTS.format("tickets_d")})
ORACLES["dq_summary"] = query(
    "tickets_e",
    "SELECT count(*) AS total, count(*) FILTER (passed) AS passed, "
    "count(*) FILTER (NOT passed) AS failed FROM checks",
    {"facts": _FACTS.format("tickets_e"), "checks": _CHECKS.format("false")})

ORACLES["quarantine"] = query("tickets_d", """
    SELECT ticket_id, CAST(length(description) AS INTEGER) AS ticket_text_length,
           CAST(1 AS INTEGER) AS affected_users, CAST(1 AS INTEGER) AS response_count,
           'medium' AS business_impact, s IS NULL AND t IS NULL AS valid, concat_ws('; ', s, t) AS reasons
    FROM (SELECT *,
            CASE WHEN subject IS NULL THEN 'subject missing' WHEN length(subject) < 1 THEN 'subject empty'
                 WHEN length(subject) > 500 THEN 'subject too long' END AS s,
            CASE WHEN description IS NULL THEN 'description missing'
                 WHEN length(description) < 1 THEN 'description empty'
                 WHEN length(description) > 10000 THEN 'description too long' END AS t
          FROM tickets_d)""")

_SPLIT = """
    SELECT *, CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
                   WHEN rn <= floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'val'
                   ELSE 'test' END AS data_split
    FROM (SELECT *, row_number() OVER (ORDER BY created_at, ticket_id) AS rn, count(*) OVER () AS n
          FROM {})"""

ORACLES["ingest_summary"] = query("tickets_o", """
    SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM s
    UNION ALL SELECT 'split', data_split, count(*) FROM s GROUP BY data_split
    UNION ALL SELECT 'category', category, count(*) FROM s GROUP BY category""",
    {"s": _SPLIT.format("tickets_o")})
ORACLES["temporal_split"] = query(
    "tickets_o", "SELECT ticket_id, data_split FROM s", {"s": _SPLIT.format("tickets_o")})
ORACLES["split_report"] = query("tickets_e", """
    SELECT data_split, count(*) AS n, epoch_us(min(created_at)) AS first_us,
           epoch_us(max(created_at)) AS last_us FROM s GROUP BY data_split""",
    {"s": _SPLIT.format("tickets_e")})

# ---- features -------------------------------------------------------------------


def _features(view: str, subject: str, description: str) -> str:
    return query(view, f"""
        SELECT ticket_id, sl AS subject_length, dl AS description_length,
               sl + dl AS combined_text_length, wc AS word_count, has_error_code, has_stack_trace,
               ec AS error_code_count, CAST(coalesce(c.n, 0) AS INTEGER) AS customer_ticket_count_30d,
               {r6('coalesce(c.sat, 3.5)', 'customer_avg_satisfaction')},
               {r6('coalesce(c.esc, 0.0)', 'customer_escalation_rate')},
               {r6('coalesce(p.hrs, 24.0)', 'product_avg_resolution_hrs')},
               CAST(coalesce(p.n, 0) AS INTEGER) AS product_ticket_volume_7d,
               h AS hour_of_day, w AS day_of_week, w >= 5 AS is_weekend, h < 8 OR h > 18 AS is_after_hours,
               days_since_product_update
        FROM f LEFT JOIN c USING (customer_id) LEFT JOIN p USING (product)""", {
        "f": f"""SELECT ticket_id, customer_id, product,
                   CAST(length({subject}) AS INTEGER) AS sl, CAST(length({description}) AS INTEGER) AS dl,
                   CAST(len(regexp_extract_all({description}, '\\S+')) AS INTEGER) AS wc,
                   coalesce(contains_error_code, false) AS has_error_code,
                   coalesce(contains_stack_trace, false) AS has_stack_trace,
                   CAST(len(regexp_extract_all({description}, '{tx.ERROR_CODE}')) AS INTEGER) AS ec,
                   CAST(hour(created_at) AS INTEGER) AS h, CAST(isodow(created_at) - 1 AS INTEGER) AS w,
                   CAST(coalesce(product_version_age_days, 90) AS INTEGER) AS days_since_product_update
                 FROM {view}""",
        "c": f"""SELECT customer_id, count(*) AS n, avg(satisfaction_score) AS sat,
                   avg(CAST(escalated AS INTEGER)) AS esc FROM {view} GROUP BY customer_id""",
        "p": f"SELECT product, count(*) AS n, avg(resolution_time_hours) AS hrs FROM {view} GROUP BY product",
    })


ORACLES["ticket_features"] = _features(
    "tickets_d", "coalesce(subject, '')", "coalesce(description, '')")
ORACLES["event_features"] = _features("tickets_e", "''", "''")

ORACLES["features_trailing"] = query("tickets_e", """
    SELECT ticket_id,
           count(*) OVER (PARTITION BY customer_id ORDER BY s
                          RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING) AS customer_ticket_count_30d,
           count(*) OVER (PARTITION BY product ORDER BY s
                          RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING) AS product_ticket_volume_7d
    FROM (SELECT *, epoch_us(created_at) // 1000000 AS s FROM tickets_e)""")

_scale_cols = CLASSIFIER_NUMERIC + CLASSIFIER_BOOLEAN
ORACLES["scaled_features"] = query("tickets_e", "SELECT ticket_id, " + ", ".join(
    f"round((x.{c} - avg(x.{c}) OVER ()) / CASE WHEN stddev_pop(x.{c}) OVER () > 0 "
    f"THEN stddev_pop(x.{c}) OVER () ELSE 1 END, 6) AS {c}_num" for c in _scale_cols) + " FROM x", {
    "x": "SELECT ticket_id, " + ", ".join(
        f"CAST(coalesce(CAST({c} AS DOUBLE), 0) AS DOUBLE) AS {c}" if c in CLASSIFIER_NUMERIC
        else f"CAST(CAST(coalesce({c}, false) AS INTEGER) AS DOUBLE) AS {c}" for c in _scale_cols)
    + " FROM tickets_e"})

_codes = "product product_module customer_tier severity channel environment region business_impact".split()
_known = "product customer_tier severity channel".split()  # the other columns are absent
_code = lambda c: f"coalesce((SELECT code FROM codes WHERE feature = '{c}' AND value = t.{c}), -1)"
ORACLES["encoded_categories"] = query("tickets_e", "SELECT ticket_id, " + ", ".join(
    f"CAST({_code(c) if c in _known else 0} AS INTEGER) AS {c}_code" for c in _codes) + " FROM newer t", {
    "older": "SELECT * FROM tickets_e WHERE created_at < (SELECT max(created_at) - INTERVAL 7 DAY FROM tickets_e) "
             "AND product <> 'P2' AND channel <> 'email'",
    "newer": "SELECT * FROM tickets_e WHERE created_at >= (SELECT max(created_at) - INTERVAL 7 DAY FROM tickets_e)",
    "codes": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS value, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM older)"
        for c in _known)})

# ---- text -----------------------------------------------------------------------


def _re(pattern: str) -> str:
    """A Java pattern of ``functions.text`` for RE2."""
    return pattern.replace("(?imd)", "(?im)").replace("'", "''")


def _trim(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def _sub(e: str, pattern: str, by: str) -> str:
    return f"regexp_replace({e}, '{_re(pattern)}', {by}, 'g')"


def _cut(e: str) -> str:
    return (
        f"CASE WHEN regexp_matches({e}, '{_re(tx.QUOTED_REPLY)}') THEN "
        + _trim(f"regexp_replace({e}, '{_re(tx.QUOTED_REPLY)}(?s:.*)\\z', '')") + f" ELSE {e} END")


def _clean_ticket(view: str) -> str:
    return query(view, """
        SELECT ticket_id, CASE WHEN length(s) > 0 AND length(b) > 0 THEN s || '. ' || b ELSE s || b END
               AS cleaned_text FROM done""", {
        "c0": f"SELECT ticket_id, {_trim('coalesce(subject, chr(32))')} AS s, "
              + _sub(_sub(_trim("coalesce(description, '')"), tx.HTML_TAG, "' '"), tx.HEADER_LINE, "''")
              + f" AS b FROM {view}",
        "c1": f"SELECT ticket_id, s, {_cut('b')} AS b FROM c0",
        "c2": f"SELECT ticket_id, s, {_sub(_sub('b', tx.GREETING, chr(39) * 2), tx.CLOSING, chr(39) * 2)} AS b FROM c1",
        "lines": f"""SELECT ticket_id, s, i, ls[i] AS line, regexp_matches(ls[i], '{tx.STACK_FRAME}') AS fr
                     FROM (SELECT ticket_id, s, string_split(b, chr(10)) AS ls FROM c2),
                          unnest(range(1, len(ls) + 1)) AS t(i)""",
        "marked": """SELECT *, i - row_number() OVER (PARTITION BY ticket_id, fr ORDER BY i) AS g FROM lines""",
        "runs": f"""SELECT ticket_id, s, min(i) AS i0,
                      CASE WHEN NOT fr THEN string_agg(line, chr(10) ORDER BY i)
                           WHEN count(*) > 2 THEN {_trim('arg_min(line, i)')} || chr(10) || '  ... ('
                             || (count(*) - 2) || ' more frames)' || chr(10) || {_trim('arg_max(line, i)')}
                           ELSE string_agg({_trim('line')}, chr(10) ORDER BY i) END AS part
                    FROM marked GROUP BY ticket_id, s, fr, g""",
        "body": "SELECT ticket_id, s, string_agg(part, chr(10) ORDER BY i0) AS b FROM runs GROUP BY ticket_id, s",
        "done": "SELECT ticket_id, s, " + _trim(_sub(_sub(_sub(
            "b", tx.REPEATED_PUNCTUATION, "'\\1'"), tx.MANY_NEWLINES, "chr(10) || chr(10)"),
            tx.MANY_SPACES, "' '")) + " AS b FROM body",
    })


def _clean_resolution_expr(column: str) -> tuple[str, str]:
    first = _sub(_sub(_sub(_trim(f"coalesce({column}, '')"), tx.HTML_TAG, "' '"),
                      tx.GREETING, "''"), tx.CLOSING, "''")
    second = _trim(_sub(_sub("c", tx.MANY_NEWLINES, "chr(10) || chr(10)"), tx.MANY_SPACES, "' '"))
    return first, second


def _clean_resolution(view: str) -> str:
    first, second = _clean_resolution_expr("resolution")
    return query(view, f"SELECT ticket_id, {second} AS cleaned_resolution FROM r1", {
        "r0": f"SELECT ticket_id, {first} AS x FROM {view}",
        "r1": f"SELECT ticket_id, {_cut('x')} AS c FROM r0"})


ORACLES["clean_ticket"] = _clean_ticket("tickets_d")
ORACLES["clean_page_ticket"] = _clean_ticket("tickets_p")
ORACLES["clean_resolution"] = _clean_resolution("tickets_d")
ORACLES["clean_page_resolution"] = _clean_resolution("tickets_p")

ORACLES["error_codes"] = query("tickets_d", f"""
    SELECT ticket_id, CAST(len(codes) AS INTEGER) AS n_codes,
           coalesce(array_to_string(list_sort(list_distinct(codes)), ','), '') AS codes
    FROM (SELECT ticket_id, regexp_extract_all(concat_ws(' ', description, error_logs),
                                               '{tx.ERROR_CODE}') AS codes FROM tickets_d)""")

_first, _second = _clean_resolution_expr("resolution")
ORACLES["composed_texts"] = query("tickets_d", """
    SELECT ticket_id, md5(it) AS index_md5, md5(et) AS embedding_md5, md5(ct) AS classifier_md5,
           CAST(length(it) AS INTEGER) AS index_length FROM t""", {
    "r0": f"SELECT *, {_first} AS x FROM tickets_d",
    "r1": f"SELECT *, {_cut('x')} AS c FROM r0",
    "t": f"""SELECT ticket_id, {_trim("coalesce(subject, '')")} || ' | ' || {_second} AS it,
               concat_ws(' | ', coalesce(subject, ''), coalesce(description, ''), 'Product: ' || product,
                         'Error: ' || split_part(error_logs, chr(10), 1)) AS et,
               coalesce(subject, '') || ' [SEP] ' || coalesce(description, '') AS ct FROM r1"""})

# ---- graph ----------------------------------------------------------------------

_ISSUES = """SELECT product, category AS issue_type, count(*) AS frequency,
                    avg(resolution_time_hours) AS avg_resolution_hrs
             FROM tickets_d GROUP BY product, category"""
_SOLUTIONS = """SELECT category AS issue_type, resolution_code, count(*) AS usage_count,
                       avg(CAST(resolution_helpful AS INTEGER)) AS success_rate,
                       arg_min(resolution, (created_at, ticket_id)) AS resolution_template
                FROM tickets_d WHERE resolution_code IS NOT NULL AND resolution IS NOT NULL
                GROUP BY category, resolution_code"""
_CODES = f"""SELECT DISTINCT ticket_id, created_at, product, category AS issue_type, resolution_code,
                    resolution AS txt,
                    unnest(regexp_extract_all(error_logs, '{tx.ERROR_CODE}')) AS error_code
             FROM tickets_d WHERE error_logs IS NOT NULL"""
_MAPPING = """SELECT error_code, product, issue_type, count(*) AS occurrences,
                     arg_min(resolution_code, (created_at, ticket_id)) FILTER (resolution_code IS NOT NULL)
                       AS resolution_code,
                     arg_min(txt, (created_at, ticket_id)) FILTER (txt IS NOT NULL) AS resolution_text
              FROM codes GROUP BY error_code, product, issue_type"""

ORACLES["product_issues"] = query("tickets_d", f"""
    SELECT product, issue_type, frequency, {r6('avg_resolution_hrs')} FROM i""", {"i": _ISSUES})
ORACLES["issue_solutions"] = query("tickets_d", f"""
    SELECT issue_type, resolution_code, usage_count, {r6('success_rate')}, resolution_template FROM s""",
    {"s": _SOLUTIONS})
ORACLES["error_code_map"] = query("tickets_d", "SELECT * FROM m", {"codes": _CODES, "m": _MAPPING})

_QUERY_CODES = f"""
    SELECT DISTINCT query_id, unnest(regexp_extract_all(description, '{tx.ERROR_CODE}')) AS error_code
    FROM queries_b"""
_CONTEXT = {
    "i": _ISSUES, "s": _SOLUTIONS, "codes": _CODES, "m": _MAPPING, "qc": _QUERY_CODES,
    "top": """SELECT q.query_id, q.predicted_subcategory AS sub, s.*, row_number() OVER (
                PARTITION BY q.query_id ORDER BY s.success_rate DESC NULLS FIRST, s.resolution_code) AS rr
              FROM queries_b q JOIN i ON i.product = q.product AND i.issue_type = q.predicted_category
              JOIN s ON s.issue_type = i.issue_type""",
    "boosted": """SELECT *, coalesce(success_rate, 0) * CASE WHEN length(sub) > 0 AND contains(
                   lower(coalesce(resolution_template, '')),
                   replace(replace(lower(sub), '_', ' '), '/', ' ')) THEN 1.5::DOUBLE ELSE 1::DOUBLE END AS score
                 FROM top WHERE rr <= 5""",
    "templates": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rr) AS rank
                    FROM boosted""",
    "hits": """SELECT query_id, m.*, row_number() OVER (PARTITION BY query_id
                 ORDER BY occurrences DESC, m.error_code, product, issue_type) AS rank
               FROM qc JOIN m USING (error_code)"""}
_CONTEXT_ROWS = f"""
    SELECT query_id, 'template' AS kind, CAST(rank AS INTEGER) AS rank, resolution_code AS code,
           resolution_template AS text, {r6('score')} FROM templates
    UNION ALL
    SELECT query_id, 'error_code', CAST(rank AS INTEGER), error_code, resolution_text,
           CAST(occurrences AS DOUBLE) FROM hits WHERE rank <= 5"""
ORACLES["graph_context"] = query("tickets_d queries_b", _CONTEXT_ROWS, _CONTEXT)

# ---- keyword search -------------------------------------------------------------

_BM25 = {
    "docs": f"""SELECT ticket_id, category, {TOKENS.format(
        "concat_ws(' ', subject, description, resolution, error_logs, tag)")} AS toks
        FROM tickets_d WHERE length(resolution) > 0""",
    "stats": "SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM docs",
    "post": """SELECT ticket_id, category, dl, term, count(*) AS tf
               FROM (SELECT ticket_id, category, len(toks) AS dl, unnest(toks) AS term FROM docs)
               GROUP BY ALL""",
    "raw": """SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf
              FROM post, stats GROUP BY term""",
    "terms": """SELECT term, df, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM raw) ELSE idf END AS idf
                FROM raw""",
}
_BM25_SEARCH = {
    **_BM25,
    "q": f"""SELECT query_id, category, term, count(*) AS qtf FROM (
               SELECT query_id, predicted_category AS category,
                      unnest({TOKENS.format("concat_ws(' ', subject, description)")}) AS term FROM queries_b)
             GROUP BY ALL""",
    "scores": """SELECT query_id, p.ticket_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE *
                   (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
                 FROM q JOIN terms USING (term) JOIN post p USING (term), stats
                 WHERE {restriction} GROUP BY query_id, p.ticket_id""",
    "ranked": """SELECT query_id, ticket_id, score, row_number() OVER (
                   PARTITION BY query_id ORDER BY round(score, 9) DESC, ticket_id) AS rank
                 FROM scores WHERE score > 0""",
}


def _search(restriction: str) -> dict[str, str]:
    return {**_BM25_SEARCH, "scores": _BM25_SEARCH["scores"].format(restriction=restriction)}


_IN_CATEGORY = "(p.category = q.category OR q.category NOT IN (SELECT category FROM docs))"
_SEARCH_BODY = f"""
    SELECT query_id, ticket_id, {r6('score')}, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10"""
ORACLES["bm25_terms"] = query("tickets_d", f"SELECT term, df, {r6('idf')} FROM terms", _BM25)
ORACLES["bm25_search"] = query("tickets_d queries_b", _SEARCH_BODY, _search(_IN_CATEGORY))
ORACLES["bm25_search_all"] = query("tickets_d queries_b", _SEARCH_BODY, _search("true"))

# ---- vector search --------------------------------------------------------------

_CENTROIDS = {
    "cells": """SELECT category, i, avg(vector[i]) AS x
                FROM vectors_v, unnest(range(1, len(vector) + 1)) AS t(i) GROUP BY category, i""",
    "cq": """SELECT category AS query_id, category, 'P' || (CAST(substr(category, 2) AS INTEGER) % 5) AS product,
                    list(x ORDER BY i) AS qv FROM cells GROUP BY category""",
}


def _vector(where: str) -> str:
    return query("vectors_v", f"""
        SELECT query_id, ticket_id, {r6('score')}, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ticket_id) AS rank
          FROM (SELECT query_id, v.ticket_id, list_cosine_similarity(qv, vector) AS score
                FROM cq, vectors_v v WHERE {where})) WHERE rank <= 10""", _CENTROIDS)


ORACLES["vector_topk"] = _vector("true")
ORACLES["vector_topk_lsh"] = _vector("true")
ORACLES["vector_index_checks"] = query(
    "vectors_v", "SELECT query_id, true AS found, true AS few, true AS enough FROM cq", _CENTROIDS)
ORACLES["vector_topk_filtered"] = _vector("v.category = cq.category AND v.product = cq.product")
ORACLES["vector_count"] = "SELECT count(*) AS n FROM embeddings"

# ---- fusion ---------------------------------------------------------------------

_LIST = """SELECT product AS query_id, ticket_id, {no} AS source_no, row_number() OVER (
             PARTITION BY product ORDER BY {col} DESC, ticket_id) AS rank FROM tickets_e"""
_FUSED = {
    "lists": "SELECT * FROM (" + _LIST.format(no=0, col="resolution_time_hours")
             + " UNION ALL " + _LIST.format(no=1, col="account_monthly_value") + ") WHERE rank <= 20",
    "fused": """SELECT query_id, ticket_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score,
                       min(source_no * 1000000000 + rank) AS first_seen
                FROM lists GROUP BY query_id, ticket_id""",
}
_ADJACENCY = "CASE pp || '>' || priority " + " ".join(
    f"WHEN '{p}>{a}' THEN {v}::DOUBLE" for p, row in PRIORITY_ADJACENCY.items() for a, v in row.items()
) + " ELSE 0.5::DOUBLE END"


def _rerank(fused_score: str = "rrf_score") -> str:
    return f"""{fused_score}
        * CASE WHEN resolution_helpful THEN 1.5::DOUBLE ELSE 1 END
        * CASE WHEN coalesce(satisfaction_score, 0) >= 4 THEN 1.3::DOUBLE ELSE 1 END
        * CASE WHEN subcategory = ps THEN 1.8::DOUBLE
               WHEN category IS NOT DISTINCT FROM pc THEN 1.1::DOUBLE ELSE 1 END
        * (0.8::DOUBLE + 0.4::DOUBLE * {_ADJACENCY})
        * CASE WHEN pm IN ('frustrated', 'angry') AND coalesce(satisfaction_score, 0) >= 4
               THEN 1.2::DOUBLE ELSE 1 END
        * CASE WHEN pm IN ('frustrated', 'angry') AND resolution_helpful THEN 1.1::DOUBLE ELSE 1 END"""


ORACLES["rrf_fusion"] = query("tickets_e", f"""
    SELECT query_id, ticket_id, {r6('rrf_score')}, first_seen FROM fused""", _FUSED)

_NO = "CAST(substr(query_id, 2) AS INTEGER)"
_RERANK_BODY = f"""
    SELECT query_id, CAST(rank AS INTEGER) AS rank, ticket_id, {r6('rrf_score')}, {r6('final_score')} FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id
               ORDER BY final_score DESC, rrf_score DESC, first_seen, ticket_id) AS rank FROM scored)
    WHERE rank <= """
ORACLES["rerank"] = query("tickets_e", _RERANK_BODY + "10", {
    **_FUSED,
    "joined": f"""SELECT f.*, t.resolution_helpful, t.satisfaction_score, t.subcategory, t.category, t.priority,
                    {_list(_b.EVENT_TYPES, _NO)} AS pc, 'S' || ({_NO} % 3) AS ps,
                    {_list(_b.PRIORITIES, _NO)} AS pp, {_list(_b.MOODS, _NO)} AS pm
                  FROM fused f JOIN tickets_e t USING (ticket_id)""",
    "scored": f"SELECT *, {_rerank()} AS final_score FROM joined"})
_KEYWORD_ONLY = {
    **_search(_IN_CATEGORY),
    "joined": """SELECT r.query_id, r.ticket_id, 1.0::DOUBLE / (60 + r.rank) AS rrf_score, r.rank AS first_seen,
                   t.resolution_helpful, t.satisfaction_score, t.subcategory, t.category, t.priority,
                   b.predicted_category AS pc, b.predicted_subcategory AS ps,
                   b.predicted_priority AS pp, b.predicted_sentiment AS pm
                 FROM ranked r JOIN tickets_d t USING (ticket_id) JOIN queries_b b USING (query_id)
                 WHERE r.rank <= 10""",
    "scored": f"SELECT *, {_rerank()} AS final_score FROM joined"}
ORACLES["hybrid_keyword_only"] = query("tickets_d queries_b", _RERANK_BODY + "5", _KEYWORD_ONLY)
ORACLES["hybrid_answer"] = query("tickets_d queries_b", """
    SELECT b.query_id, coalesce(results, '') AS results, coalesce(context, '') AS context, coalesce(error_codes, '') AS error_codes,
           b.predicted_category, b.predicted_subcategory, b.predicted_priority, b.predicted_sentiment, b.product
    FROM queries_b b
    LEFT JOIN (SELECT query_id, string_agg(ticket_id, ',' ORDER BY rank) AS results FROM answered GROUP BY 1) USING (query_id)
    LEFT JOIN (SELECT query_id, string_agg(kind || ':' || code, ',' ORDER BY kind, rank) AS context FROM context GROUP BY 1) USING (query_id)
    LEFT JOIN (SELECT query_id, string_agg(error_code, ',' ORDER BY error_code) AS error_codes FROM qc GROUP BY 1) USING (query_id)""", {
    **_KEYWORD_ONLY, "answered": _RERANK_BODY + "5", **_CONTEXT, "context": _CONTEXT_ROWS})

# ---- quality of results ---------------------------------------------------------


def _words(words: list[str]) -> str:
    return f"regexp_matches(res, '(?i)({'|'.join(words)})')"


def _points(step: float, conditions: list[str]) -> str:
    total = " + ".join(f"CASE WHEN {c} THEN {step}::DOUBLE ELSE 0 END" for c in conditions)
    return f"least(1.0::DOUBLE, greatest(0.1::DOUBLE, {total}))"


_QUALITY = {
    "pairs": f"""SELECT *, 'q' || (doc_no % 50) AS query_id, coalesce(resolution, '') AS res,
                   {_list(_b.LANGS, 'doc_no')} AS query_category, 'src' || ((doc_no * 3) % 20) AS query_product
                 FROM tickets_d""",
    "dims": f"""SELECT query_id, query_category, ticket_id,
          CASE WHEN query_category = category AND query_product = product THEN 1.0::DOUBLE
               WHEN query_category = category THEN 0.7::DOUBLE
               WHEN query_product = product THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS relevance,
          CASE WHEN resolution_helpful THEN 1.0::DOUBLE WHEN NOT resolution_helpful THEN 0.2::DOUBLE
               ELSE 0.5::DOUBLE END AS success,
          coalesce(least(1.0::DOUBLE, satisfaction_score / 5.0::DOUBLE), 0.5::DOUBLE) AS satisfaction,
          {_points(0.2, ["length(res) > 50", "length(res) > 150",
                         "regexp_matches(res, '\\p{Nd}')",
                         _words(scoring.ACTION_WORDS), _words(scoring.OUTCOME_WORDS)])} AS completeness,
          {_points(0.25, [f"regexp_matches(res, '{tx.ERROR_CODE}')",
                          f"regexp_matches(res, '(?i){scoring.FILE_SUFFIX}')",
                          _words([*scoring.VERSION_WORDS, scoring.VERSION_NUMBER]), _words(scoring.TOOL_WORDS)])} AS specificity
        FROM pairs""",
    "q": "SELECT *, " + " + ".join(f"{d} * {w}::DOUBLE" for d, w in scoring.WEIGHTS.items())
         + " AS quality_score FROM dims",
}
_METRICS = f"""count(*) AS n_results_scored, {r6('avg(quality_score)', 'mean_quality')},
    {r6('quantile_cont(quality_score, 0.5)', 'median_quality')},
    {r6('quantile_cont(quality_score, 0.25)', 'p25_quality')},
    {r6('avg(CAST(quality_score < 0.3::DOUBLE AS INTEGER))', 'low_quality_rate')},
    {r6('avg(CAST(quality_score >= 0.7::DOUBLE AS INTEGER))', 'high_quality_rate')}"""
ORACLES["quality_score"] = query("tickets_d", "SELECT ticket_id, " + ", ".join(
    r6(c) for c in [*scoring.WEIGHTS, "quality_score"]) + " FROM q", _QUALITY)
ORACLES["quality_ranking"] = query("tickets_d", f"""
    SELECT query_id, CAST(rank AS INTEGER) AS rank, ticket_id, {r6('quality_score')} FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY quality_score DESC, ticket_id) AS rank FROM q)
    WHERE rank <= 5""", _QUALITY)
ORACLES["quality_metrics"] = query("tickets_d", f"SELECT {_METRICS} FROM q", _QUALITY)
ORACLES["quality_by_category"] = query(
    "tickets_d", f"SELECT query_category, {_METRICS} FROM q GROUP BY query_category", _QUALITY)

# ---- anomalies ------------------------------------------------------------------

_VOLUME_E = {
    "cut": "SELECT max(created_at) - INTERVAL 7 DAY AS c FROM tickets_e",
    "span": """SELECT greatest(1, floor((epoch_us(max(created_at)) - epoch_us(min(created_at)))
                 / 86400000000.0::DOUBLE)) AS days FROM tickets_e, cut WHERE created_at >= c""",
    "rec": """SELECT product, category, count(*) AS recent_count FROM tickets_e, cut
              WHERE created_at >= c GROUP BY product, category""",
    "base": """SELECT product, category, avg(n) AS mean_daily, coalesce(stddev_samp(n), 1) AS std_daily
               FROM (SELECT product, category, CAST(created_at AS DATE) AS day, count(*) AS n
                     FROM tickets_e, cut WHERE created_at < c GROUP BY ALL) GROUP BY product, category""",
    "v": """SELECT *, CASE WHEN std_daily > 0 THEN (recent_daily - mean_daily) / std_daily
                          WHEN recent_daily > mean_daily THEN CAST('inf' AS DOUBLE)
                          WHEN recent_daily < mean_daily THEN CAST('-inf' AS DOUBLE) END AS z
            FROM (SELECT rec.*, mean_daily, std_daily, recent_count / days AS recent_daily
                  FROM rec JOIN base USING (product, category), span)""",
}
_VOLUME = {k: v.replace("tickets_e", "tickets_a") for k, v in _VOLUME_E.items()}
ORACLES["volume_statistics"] = query("tickets_e", f"""
    SELECT product, category, CAST(recent_count AS BIGINT) AS recent_count, {r6('mean_daily')},
           {r6('std_daily')}, {r6('recent_daily')}, {r6('z')} FROM v""", _VOLUME_E)
ORACLES["volume_anomalies"] = query("tickets_a", f"""
    SELECT product, category, {r6('recent_daily')}, {r6('mean_daily')}, {r6('std_daily')}, {r6('z')},
           CASE WHEN z > 3 THEN 'critical' ELSE 'warning' END AS severity,
           {r6('mean_daily + 2 * std_daily', 'threshold')} FROM v WHERE z > 2""", _VOLUME)

_MOOD_E = {
    "scored": "SELECT product, created_at, ticket_id, CASE customer_sentiment "
              + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SENTIMENT_SCORE.items())
              + " ELSE 3::DOUBLE END AS x FROM tickets_e",
    "w": """SELECT *, pow(29.0::DOUBLE / 31, row_number() OVER (
              PARTITION BY product ORDER BY created_at DESC, ticket_id DESC) - 1) AS wt FROM scored""",
    "m": """SELECT product, count(*) AS n, avg(x) AS mean, greatest(stddev_samp(x), 0.1::DOUBLE) AS std,
                   sum(x * wt) / sum(wt) AS ewma FROM w GROUP BY product HAVING count(*) >= 50""",
    "mz": "SELECT *, (ewma - mean) / std AS z FROM m",
}
ORACLES["sentiment_statistics"] = query("tickets_e", f"""
    SELECT product, n, {r6('mean')}, {r6('std')}, {r6('ewma')}, {r6('z')} FROM mz""", _MOOD_E)
_MOOD = {k: v.replace("tickets_e", "tickets_a") for k, v in _MOOD_E.items()}
ORACLES["sentiment_drift"] = query("tickets_a", f"""
    SELECT product, {r6('ewma')}, {r6('mean')}, {r6('std')}, {r6('z')},
           CASE WHEN z > -3 THEN 'warning' ELSE 'critical' END AS severity,
           {r6('mean - 1 * std', 'threshold')} FROM mz WHERE z < -1""", _MOOD)


def _issues(view: str) -> dict[str, str]:
    return {
        "o": f"""SELECT *, row_number() OVER (ORDER BY created_at, ticket_id) AS rn, count(*) OVER () AS n
                 FROM {view}""",
        "marked": """SELECT product, category, rn > n - floor(n * CAST(0.1 AS DOUBLE)) AS is_tail FROM o
                     WHERE rn > n - floor(n * CAST(0.1 AS DOUBLE)) OR rn <= floor(n * CAST(0.9 AS DOUBLE))""",
        "counts": """SELECT product, category, count(*) FILTER (is_tail) AS r, count(*) FILTER (NOT is_tail) AS h
                     FROM marked WHERE product IS NOT NULL AND category IS NOT NULL GROUP BY product, category""",
        "shares": """SELECT product, category,
                       r / nullif(sum(r) OVER (PARTITION BY product), 0)::DOUBLE AS recent_share,
                       coalesce(h / nullif(sum(h) OVER (PARTITION BY product), 0)::DOUBLE, 0) AS hist_share
                     FROM counts""",
    }


_SHARES = f"SELECT product, category, {r6('recent_share')}, {r6('hist_share')} FROM shares"
ORACLES["issue_shares"] = query("tickets_o", _SHARES, _issues("tickets_o"))
ORACLES["new_issue_types"] = query(
    "tickets_a", _SHARES + " WHERE recent_share > 0.05 AND hist_share < 0.01", _issues("tickets_a"))
ORACLES["all_anomalies"] = query("tickets_a", f"""
    SELECT 'volume_spike' AS anomaly_type, product, category, CASE WHEN z > 3 THEN 'critical' ELSE 'warning' END AS severity,
           {r6('recent_daily', 'metric_value')}, {r6('mean_daily + 2 * std_daily', 'threshold')}
    FROM v WHERE z > 2
    UNION ALL SELECT 'new_issue_type', product, category, 'info', round(recent_share, 6), 0.05::DOUBLE FROM shares
    WHERE recent_share > 0.05 AND hist_share < 0.01
    UNION ALL SELECT 'sentiment_drift', product, NULL, CASE WHEN z > -3 THEN 'warning' ELSE 'critical' END,
           round(ewma, 6), round(mean - 1 * std, 6) FROM mz WHERE z < -1""",
    {**_VOLUME, **_issues("tickets_a"), **_MOOD})

# ---- drift ----------------------------------------------------------------------


def _psi(features: list[str], view: str = "tickets_e") -> dict[str, str]:
    cells = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, is_ref FROM sided WHERE {f} IS NOT NULL"
        for f in features)
    return {
        "sided": f"""SELECT *, created_at < (SELECT max(created_at) - INTERVAL 7 DAY FROM {view}) AS is_ref
                     FROM {view}""",
        "cells": cells,
        "edges": """SELECT feature, list_sort(list_distinct(quantile_cont(x,
                      [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e
                    FROM cells WHERE is_ref GROUP BY feature""",
        "binned": """SELECT feature, is_ref, CASE WHEN len(e) > 1 AND x BETWEEN e[1] AND e[len(e)]
                       THEN least(len(list_filter(e, lambda v: v <= x)), len(e) - 1) END AS bin
                     FROM cells JOIN edges USING (feature)""",
        "counts": """SELECT feature, bin, count(*) FILTER (is_ref) AS rc, count(*) FILTER (NOT is_ref) AS cc
                     FROM binned GROUP BY feature, bin""",
        "totals": "SELECT feature, sum(rc) AS n_ref, sum(cc) AS n_cur FROM counts GROUP BY feature",
        "grid": """SELECT feature, len(e) - 1 AS k, i AS bin
                   FROM edges, unnest(range(1, len(e))) AS t(i)""",
        "filled": """SELECT grid.feature, k, coalesce(rc, 0) AS rc, coalesce(cc, 0) AS cc
                     FROM grid LEFT JOIN counts ON grid.feature = counts.feature AND grid.bin = counts.bin""",
        "shares": """SELECT feature,
                       (rc + 1e-6) / (sum(rc) OVER (PARTITION BY feature) + 1e-6 * k) AS p,
                       (cc + 1e-6) / (sum(cc) OVER (PARTITION BY feature) + 1e-6 * k) AS q FROM filled""",
        "psi": """SELECT t.feature, coalesce(sum((q - p) * ln(q / p)), 0) AS psi,
                         CAST(any_value(n_ref) AS BIGINT) AS n_ref, CAST(any_value(n_cur) AS BIGINT) AS n_cur
                  FROM totals t LEFT JOIN shares USING (feature) GROUP BY t.feature""",
    }


_SEVERITY = "CASE WHEN {0} >= {1} THEN 'severe' WHEN {0} >= {2} THEN 'moderate' WHEN {0} >= {3} THEN 'minor' END"
_PSI_SEVERITY = _SEVERITY.format("psi", "0.25", "0.2", "0.1")
ORACLES["psi_features"] = query("tickets_e", f"SELECT feature, {r6('psi')}, n_ref, n_cur FROM psi",
                                _psi([*DRIFT_FEATURES, "resolution_time_hours"]))
_FEATURE_SIGNALS = f"""
    SELECT 'feature_drift' AS signal_type, {_PSI_SEVERITY} AS severity, 'psi_' || feature AS metric_name,
           {r6('psi', 'current_value')}, 0.0::DOUBLE AS reference_value, 0.2::DOUBLE AS threshold
    FROM psi WHERE psi >= 0.1 AND n_ref >= 50 AND n_cur >= 10"""
_SKETCHED = ", ".join(f"('{f}')" for f in [*DRIFT_FEATURES, "resolution_time_hours"])
ORACLES["sketch_bounds"] = f"""
    SELECT feature, true AS quantiles_hold, true AS distinct_holds, true AS index_holds FROM (VALUES {_SKETCHED}) t(feature)"""
ORACLES["ordered_encoding"] = query("tickets_e", f"""
    SELECT ticket_id, feature, value, count(*) OVER w AS n_before,
           round((coalesce(sum(label) OVER w, 0) + 0.7::DOUBLE * 0.5) / (count(*) OVER w + 0.7::DOUBLE), 6) AS encoded
    FROM cells WINDOW w AS (PARTITION BY feature, value ORDER BY created_at, ticket_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", {
    "cells": " UNION ALL ".join(
        f"SELECT ticket_id, created_at, '{c}' AS feature, {c} AS value, CAST(priority = 'critical' AS DOUBLE) AS label FROM tickets_e"
        for c in ("product", "channel", "customer_tier"))})
ORACLES["feature_drift"] = query("tickets_e", _FEATURE_SIGNALS, _psi(DRIFT_FEATURES))


def _values(cols: list[str]) -> dict[str, str]:
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, is_ref FROM sided2 WHERE {c} IS NOT NULL"
        for c in cols)
    return {
        "sided2": """SELECT *, CAST(CAST(created_at AS DATE) AS VARCHAR) AS created_day,
                       created_at < (SELECT max(created_at) - INTERVAL 7 DAY FROM tickets_e) AS is_ref
                     FROM tickets_e""",
        "vals": cells,
        "vc": """SELECT feature, value, count(*) FILTER (is_ref) AS rn, count(*) FILTER (NOT is_ref) AS n
                 FROM vals GROUP BY feature, value""",
    }


_CATS = ["product", "customer_tier", "channel", "priority"]
ORACLES["new_categories"] = query(
    "tickets_e", "SELECT feature, value, n FROM vc WHERE rn = 0", _values([*_CATS, "created_day"]))
ORACLES["value_shares"] = query("tickets_e", f"""
    SELECT feature, value, {r6('p', 'ref_share')}, {r6('q', 'cur_share')},
           round(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) / 2 ELSE 0 END
                 + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) / 2 ELSE 0 END, 6) AS js_term FROM s""", {
    **_values(_CATS),
    "s": """SELECT feature, value, rn / (sum(rn) OVER (PARTITION BY feature))::DOUBLE AS p,
                   n / (sum(n) OVER (PARTITION BY feature))::DOUBLE AS q FROM vc"""})

_LOGSIDES = """SELECT *, "timestamp" < (SELECT max("timestamp") - INTERVAL 7 DAY FROM pred_log) AS old FROM pred_log"""


def _shift(ref_sql: str, cur_sql: str) -> dict[str, str]:
    return {
        "refc": ref_sql, "curc": cur_sql,
        "shift": """SELECT category, ref_prop, cur_prop,
                      abs(cur_prop - ref_prop) / greatest(ref_prop, 0.01::DOUBLE) AS rel_change
                    FROM (SELECT refc.category, refc.n / (SELECT sum(n) FROM refc)::DOUBLE AS ref_prop,
                                 coalesce(curc.n, 0) / (SELECT sum(n) FROM curc)::DOUBLE AS cur_prop
                          FROM refc LEFT JOIN curc ON refc.category = curc.category)
                    WHERE (SELECT sum(n) FROM curc) >= 20""",
    }


ORACLES["prediction_shift"] = query("pred_log", f"""
    SELECT category, {r6('ref_prop')}, {r6('cur_prop')}, {r6('rel_change')} FROM shift""", {
    "l": _LOGSIDES,
    **_shift("SELECT actual_category AS category, count(*) AS n FROM l WHERE old GROUP BY actual_category",
             "SELECT predicted_category AS category, count(*) AS n FROM l WHERE NOT old GROUP BY predicted_category")})
_PRED_SIGNALS = f"""
    SELECT 'prediction_drift' AS signal_type, CASE WHEN rel_change > 1 THEN 'severe' ELSE 'moderate' END AS severity,
           'pred_dist_' || category AS metric_name, {r6('cur_prop', 'current_value')},
           {r6('ref_prop', 'reference_value')}, {r6('ref_prop * 1.5', 'threshold')}
    FROM shift WHERE rel_change > 0.5"""
ORACLES["prediction_drift"] = query("pred_log tickets_o", _PRED_SIGNALS, _shift(
    "SELECT category, count(*) AS n FROM tickets_o GROUP BY category",
    "SELECT predicted_category AS category, count(*) AS n FROM pred_log GROUP BY predicted_category"))


def _confidence(source: str) -> dict[str, str]:
    return {"conf": f"SELECT avg(confidence) AS m, count(confidence) AS n FROM {source}"}


_CONF_SIGNALS = f"""
    SELECT 'confidence_drift' AS signal_type, {_SEVERITY.format('0.85 - m', 0.15, 0.10, 0.05)} AS severity,
           'mean_confidence_24h' AS metric_name, {r6('m', 'current_value')}, 0.85::DOUBLE AS reference_value,
           0.75::DOUBLE AS threshold FROM conf WHERE n >= 10 AND 0.85 - m >= 0.05"""
ORACLES["confidence_drift"] = query("pred_log", _CONF_SIGNALS, _confidence("pred_log"))

_LABELLED = {
    "lab": """SELECT * FROM pred_log WHERE true_category IS NOT NULL AND "timestamp" >=
                (SELECT max("timestamp") - INTERVAL 168 HOUR FROM pred_log)""",
    "rate": "SELECT count(*) AS n, count(*) FILTER (was_corrected) / count(*)::DOUBLE AS r FROM lab",
}
_LABEL_SIGNALS = f"""
    SELECT 'label_drift' AS signal_type, {_SEVERITY.format('r', 0.30, 0.20, 0.10)} AS severity,
           'correction_rate_7d' AS metric_name, {r6('r', 'current_value')}, 0.0::DOUBLE AS reference_value,
           0.2::DOUBLE AS threshold FROM rate WHERE n >= 20 AND r >= 0.1"""
ORACLES["label_drift"] = query("pred_log", _LABEL_SIGNALS, _LABELLED)
ORACLES["label_confusions"] = query("pred_log", """
    SELECT predicted_category, true_category, count(*) AS n FROM lab WHERE was_corrected
    GROUP BY predicted_category, true_category ORDER BY n DESC, 1, 2 LIMIT 5""", _LABELLED)

_ALL = {
    **_psi(DRIFT_FEATURES), **_values(_CATS), "l": _LOGSIDES,
    **_shift("SELECT predicted_category AS category, count(*) AS n FROM l WHERE old GROUP BY predicted_category",
             "SELECT predicted_category AS category, count(*) AS n FROM l WHERE NOT old GROUP BY predicted_category"),
    **_confidence("l WHERE NOT old"), **_LABELLED,
    "sig": f"""{_FEATURE_SIGNALS} UNION ALL
        SELECT 'feature_drift', 'moderate', 'new_categories_' || feature, CAST(count(*) AS DOUBLE), 0.0::DOUBLE,
               0.0::DOUBLE FROM vc WHERE rn = 0 GROUP BY feature
        UNION ALL {_PRED_SIGNALS} UNION ALL {_CONF_SIGNALS} UNION ALL {_LABEL_SIGNALS}""",
}
_SIDES = "tickets_e pred_log"
ORACLES["all_drift"] = query(_SIDES, "SELECT * FROM sig", _ALL)

# ---- lifecycle ------------------------------------------------------------------

_FACTS_OF_SIGNALS = """SELECT count(*) FILTER (severity = 'severe') AS severe,
    count(*) FILTER (signal_type = 'label_drift' AND severity IN ('severe', 'moderate')) AS lab,
    (SELECT count(*) FILTER (was_corrected) FROM pred_log) AS corr FROM sig"""
_DECIDE = """
    SELECT days >= 7 OR severe >= 2 OR (corr >= 200 AND lab > 0) AS should_retrain,
           CASE WHEN days >= 7 THEN 'scheduled' WHEN severe >= 2 THEN 'drift'
                WHEN corr >= 200 AND lab > 0 THEN 'feedback' ELSE 'manual' END AS trigger,
           CASE WHEN days >= 7 THEN 'Scheduled: ' || days || ' days since last retrain (max=7)'
                WHEN severe >= 2 THEN 'Multiple severe drift signals: ' || severe
                WHEN corr >= 200 AND lab > 0 THEN corr || ' corrections available, correction rate elevated'
                ELSE 'No retraining trigger met' END AS reason FROM facts2"""
ORACLES["retrain_decision"] = query(_SIDES, _DECIDE, {
    **_ALL, "facts1": _FACTS_OF_SIGNALS, "facts2": "SELECT *, 2 AS days FROM facts1"})
ORACLES["retrain_scheduled"] = query(_SIDES, _DECIDE, {
    **_ALL, "facts1": _FACTS_OF_SIGNALS,
    "facts2": """SELECT *, (SELECT CAST(floor((epoch_us(max(created_at)) - epoch_us(min(created_at)))
                 / 86400000000.0::DOUBLE) AS BIGINT) FROM tickets_e) AS days FROM facts1"""})

_RECENT = "(SELECT max(created_at) - INTERVAL {} DAY FROM tickets_e)"
ORACLES["train_augment"] = query("tickets_e latest_corrections", f"""
    SELECT ticket_id, coalesce(corrected, category) AS category
    FROM tickets_e LEFT JOIN latest_corrections USING (ticket_id) WHERE created_at < {_RECENT.format(7)}
    UNION ALL
    SELECT ticket_id, category FROM tickets_e WHERE created_at >= {_RECENT.format(7)}
      AND created_at >= {_RECENT.format(10)}""")
ORACLES["train_recent"] = query("tickets_e latest_corrections", f"""
    SELECT ticket_id, coalesce(corrected, category) AS category
    FROM tickets_e LEFT JOIN latest_corrections USING (ticket_id) WHERE created_at >= {_RECENT.format(14)}""")


def _f1(name: str, source: str, label: str, prediction: str) -> dict[str, str]:
    return {
        f"{name}_c": f"""SELECT class, sum(s) AS support, sum(q) AS predicted, sum(h) AS hits FROM (
              SELECT {label} AS class, 1 AS s, 0 AS q, CAST({label} = {prediction} AS INTEGER) AS h FROM {source}
              UNION ALL SELECT {prediction}, 0, 1, 0 FROM {source}) GROUP BY class""",
        f"{name}_f": f"""SELECT *, coalesce(2.0::DOUBLE * hits / nullif(support + predicted, 0), 0) AS f1
                         FROM {name}_c""",
        f"{name}": f"SELECT sum(f1 * support) / sum(support) AS f FROM {name}_f",
    }


_BOTH = """SELECT p.ticket_id, p.actual_category AS a, p.predicted_category AS o, s.predicted_category AS n
           FROM pred_log p JOIN shadow_log s USING (ticket_id)"""
ORACLES["model_gate"] = query("pred_log shadow_log", f"""
    SELECT {r6('o.f', 'old_f1')}, {r6('w.f', 'new_f1')}, {r6('w.f - o.f', 'improvement')},
           w.f - o.f >= 0.005 AS should_deploy FROM fo o, fw w""",
    {"both_models": _BOTH, **_f1("fo", "both_models", "a", "o"), **_f1("fw", "both_models", "a", "n")})

_SHADOW = {
    "sh": """SELECT count(*) AS n, avg(CAST(p.predicted_category = s.predicted_category AS INTEGER)) AS agree,
                    avg(p.confidence) AS pc, avg(s.confidence) AS sc,
                    (epoch_us(max(p."timestamp")) - epoch_us(min(p."timestamp"))) / 3600000000.0::DOUBLE AS h
             FROM pred_log p JOIN shadow_log s USING (ticket_id)""",
}
ORACLES["shadow_report"] = query("pred_log shadow_log", f"""
    SELECT n AS n_predictions, {r6('agree', 'agreement_rate')}, {r6('pc', 'primary_mean_confidence')},
           {r6('sc', 'shadow_mean_confidence')}, {r6('h', 'hours_running')}, {r6('sc - pc', 'confidence_delta')},
           CASE WHEN n > 0 THEN 'running' ELSE 'no_data' END AS status,
           n >= 100 AND h >= 24 AND sc >= pc AS ready_for_promotion FROM sh""", _SHADOW)
ORACLES["correction_rate"] = query("feedback", f"""
    SELECT CAST(7 AS INTEGER) AS window_days, count(*) AS total,
           {r6('coalesce(count(corrected_category) / nullif(count(*), 0)::DOUBLE, 0)', 'correction_rate')},
           {r6('coalesce(count(*) FILTER (resolution_accepted) / nullif(count(resolution_accepted), 0)::DOUBLE, 0)',
               'acceptance_rate')}
    FROM feedback WHERE feedback_at >= (SELECT max(feedback_at) - INTERVAL 7 DAY FROM feedback)""")
ORACLES["monitoring_report"] = query("tickets_e pred_log shadow_log", f"""
    SELECT count(*) AS n_signals, count(*) FILTER (severity = 'severe') AS n_severe,
           count(*) FILTER (severity = 'moderate') AS n_moderate, count(*) FILTER (severity = 'minor') AS n_minor,
           any_value(r.n) AS n_recent_predictions, {r6('any_value(r.c)', 'mean_confidence')},
           any_value(dec.should_retrain) AS should_retrain, any_value(dec.trigger) AS trigger,
           any_value(dec.reason) AS reason, any_value(CASE WHEN sh.n > 0 THEN 'running' ELSE 'no_data' END)
             AS shadow_status, {r6('any_value(sh.agree)', 'shadow_agreement')},
           any_value(sh.n >= 100 AND sh.h >= 24 AND sh.sc >= sh.pc) AS shadow_ready
    FROM sig, r, dec, sh""", {
    **_ALL, **_SHADOW, "facts1": _FACTS_OF_SIGNALS,
    "facts2": "SELECT severe, lab, 0 AS corr, 2 AS days FROM facts1", "dec": _DECIDE,
    "r": """SELECT count(*) AS n, avg(confidence) AS c FROM (
              SELECT * FROM pred_log QUALIFY row_number() OVER (
                PARTITION BY model_name ORDER BY "timestamp" DESC, ticket_id DESC) <= 1000)"""})
ORACLES["metric_snapshots"] = query("tickets_e", f"""
    SELECT metric_name, {r6('v', 'metric_value')}, (SELECT epoch_us(max(created_at)) FROM tickets_e) AS snapshot_us
    FROM (SELECT 'n_tickets' AS metric_name, CAST(count(satisfaction_score) AS DOUBLE) AS v FROM tickets_e
          UNION ALL SELECT 'n_satisfied', count(*) FILTER (satisfaction_score >= 4) FROM tickets_e
          UNION ALL SELECT 'satisfaction_rate', avg(CAST(satisfaction_score >= 4 AS INTEGER)) FROM tickets_e)""")

# ---- analytics ------------------------------------------------------------------

_AGENTS = {
    "a": """SELECT agent_id, count(*) AS ticket_count, avg(resolution_time_hours) AS avg_resolution_hours,
              quantile_cont(resolution_time_hours, 0.5) AS median_resolution_hours,
              avg(satisfaction_score) AS avg_satisfaction, count(satisfaction_score) AS satisfaction_count,
              avg(CAST(escalated AS INTEGER)) AS escalation_rate,
              avg(CAST(resolution_helpful AS INTEGER)) AS resolution_helpful_rate,
              avg(response_count) AS avg_response_count,
              avg(CAST(coalesce(response_count, 3) <= 2 AS INTEGER)) AS fcr_rate,
              arg_min(agent_experience_months, (created_at, ticket_id))
                FILTER (agent_experience_months IS NOT NULL) AS experience_months,
              arg_min(agent_specialization, (created_at, ticket_id))
                FILTER (agent_specialization IS NOT NULL) AS specialization
            FROM tickets_e GROUP BY agent_id""",
    "modes": """SELECT agent_id, category AS primary_category FROM (
                  SELECT agent_id, category, row_number() OVER (PARTITION BY agent_id
                           ORDER BY count(*) DESC, category) AS rn FROM tickets_e GROUP BY agent_id, category)
                WHERE rn = 1""",
    "ag": """SELECT a.*, primary_category,
               coalesce(avg_satisfaction, 3) / 5.0::DOUBLE * 0.3::DOUBLE
               + coalesce(resolution_helpful_rate, 0.5) * 0.25::DOUBLE + coalesce(fcr_rate, 0.5) * 0.2::DOUBLE
               + (1 - coalesce(escalation_rate, 0.1)) * 0.15::DOUBLE
               + (1 - greatest(0, least(1, coalesce(avg_resolution_hours, 24) / 48))) * 0.1::DOUBLE AS perf_score
             FROM a LEFT JOIN modes USING (agent_id)""",
}
ORACLES["agent_performance"] = query("tickets_e", f"""
    SELECT agent_id, ticket_count, {r6('avg_resolution_hours')}, {r6('median_resolution_hours')},
           {r6('avg_satisfaction')}, satisfaction_count, {r6('escalation_rate')}, {r6('resolution_helpful_rate')},
           {r6('avg_response_count')}, {r6('fcr_rate')}, {r6('perf_score')}, experience_months, specialization,
           primary_category FROM ag""", _AGENTS)
ORACLES["agent_report"] = query("tickets_e", f"""
    SELECT 'summary' AS section, CAST(1 AS INTEGER) AS position, 'avg_resolution_hours' AS agent_id,
           {r6('avg(avg_resolution_hours)', 'value')} FROM ag
    UNION ALL SELECT 'summary', 2, 'avg_satisfaction', round(avg(avg_satisfaction), 6) FROM ag
    UNION ALL SELECT 'summary', 3, 'avg_fcr_rate', round(avg(fcr_rate), 6) FROM ag
    UNION ALL SELECT 'summary', 4, 'n_agents', CAST(count(*) AS DOUBLE) FROM ag
    UNION ALL SELECT 'agents', rn, agent_id, round(perf_score, 6) FROM rk WHERE rn <= 50
    UNION ALL SELECT 'top_performers', rn, agent_id, round(perf_score, 6) FROM rk WHERE rn <= 5
    UNION ALL SELECT 'needs_coaching', rn - greatest(n - 5, 0), agent_id, round(perf_score, 6) FROM rk
    WHERE rn > n - 5""", {
    **_AGENTS, "rk": """SELECT agent_id, perf_score, CAST(count(*) OVER () AS INTEGER) AS n,
        CAST(row_number() OVER (ORDER BY perf_score DESC, agent_id) AS INTEGER) AS rn FROM ag"""})
ORACLES["resolution_time_stats"] = query("tickets_e", f"""
    SELECT product, category, count(*) AS ticket_count, {r6('avg(resolution_time_hours)', 'avg_hours')},
           {r6('quantile_cont(resolution_time_hours, 0.5)', 'median_hours')},
           {r6('quantile_cont(resolution_time_hours, 0.95)', 'p95_hours')}
    FROM tickets_e WHERE resolution_time_hours IS NOT NULL GROUP BY product, category""")
ORACLES["satisfaction_summary"] = query("tickets_e", f"""
    SELECT count(satisfaction_score) AS n_tickets, count(*) FILTER (satisfaction_score >= 4) AS n_satisfied,
           {r6('avg(CAST(satisfaction_score >= 4 AS INTEGER))', 'satisfaction_rate')} FROM tickets_e""")
ORACLES["driver_matrix"] = query("tickets_e", f"""
    SELECT ticket_id, {r6('coalesce(resolution_time_hours, 24)', 'resolution_time_hours')},
           CAST(coalesce(resolution_attempts, 1) AS DOUBLE) AS resolution_attempts,
           CAST(coalesce(transferred_count, 0) AS DOUBLE) AS transferred_count,
           CAST(coalesce(response_count, 1) AS DOUBLE) AS response_count,
           CAST(coalesce(escalated, false) AS INTEGER) AS escalated,
           CAST(coalesce(resolution_helpful, false) AS INTEGER) AS resolution_helpful,
           CAST(coalesce(agent_experience_months, 12) AS DOUBLE) AS agent_experience_months,
           CAST(customer_tier = 'enterprise' AS INTEGER) AS is_enterprise,
           CAST(priority = 'critical' AS INTEGER) AS is_critical,
           CAST(coalesce(response_count, 1) <= 2 AS INTEGER) AS first_contact_resolution,
           CAST(satisfaction_score >= 4 AS INTEGER) AS satisfied
    FROM tickets_e WHERE satisfaction_score IS NOT NULL""")

# ---- classification -------------------------------------------------------------

ORACLES["class_weights"] = query("tickets_d", f"""
    SELECT category, n, {r6('(SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n)', 'weight')} FROM c""",
    {"c": "SELECT category, count(*) AS n FROM tickets_d GROUP BY category"})
ORACLES["per_class_f1"] = query("pred_log", f"""
    SELECT class, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted,
           CAST(hits AS BIGINT) AS hits, {r6('f1')} FROM x_f""",
    _f1("x", "pred_log", "actual_category", "predicted_category"))
ORACLES["weighted_f1"] = query("pred_log", f"SELECT {r6('f', 'weighted_f1')} FROM x",
                               _f1("x", "pred_log", "actual_category", "predicted_category"))

_OTHER = _list(_b.EVENT_TYPES, "length(ticket_id) + length(predicted_category)")
_PROBS = """SELECT ticket_id, predicted_category AS c, confidence AS p FROM {0}
            UNION ALL SELECT ticket_id, CASE WHEN {1} <> predicted_category THEN {1} ELSE 'rest' END,
                             1 - confidence FROM {0}"""
ORACLES["ensemble_route"] = query("pred_log shadow_log", f"""
    SELECT ticket_id, c AS predicted_category, {r6('p', 'confidence')}, ensembled FROM (
      SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY p DESC, c) AS rn FROM mixed) WHERE rn = 1""", {
    "pa": _PROBS.format("pred_log", _OTHER), "pb": _PROBS.format("shadow_log", _OTHER),
    "sure": "SELECT ticket_id, max(p) >= 0.6::DOUBLE AS ok FROM pa GROUP BY ticket_id",
    "mixed": """SELECT pa.ticket_id, c, p, false AS ensembled FROM pa JOIN sure USING (ticket_id) WHERE ok
                UNION ALL
                SELECT x.ticket_id, c, sum(p) / 2, true FROM (SELECT * FROM pa UNION ALL SELECT * FROM pb) x
                JOIN sure USING (ticket_id) WHERE NOT ok GROUP BY x.ticket_id, c"""})

# ---- label correction -----------------------------------------------------------

ORACLES["label_prompts"] = query("tickets_d", """
    SELECT ticket_id, md5(concat_ws(chr(10), 'Subject: ' || coalesce(subject, 'N/A'),
             'Description: ' || coalesce(description, 'N/A'), 'Category: ' || coalesce(category, 'UNKNOWN'),
             'Product: ' || coalesce(product, 'N/A'), 'Product module: N/A', 'Product version: N/A',
             'Customer tier: N/A', 'Channel: N/A', 'Environment: N/A', 'Severity: N/A',
             'Affected users: N/A', 'Business impact: N/A',
             CASE WHEN length(error_logs) > 0 THEN 'Error logs: ' || error_logs END,
             CASE WHEN length(resolution) > 0 THEN 'Resolution: ' || resolution END,
             CASE WHEN length(resolution_code) > 0 THEN 'Resolution code: ' || resolution_code END,
             CASE WHEN escalated THEN 'Escalated: True' END, 'Tags: ' || tag)) AS fields_md5, true AS has_text
    FROM tickets_d""")

_VOCABULARY = " UNION ALL ".join(
    f"SELECT '{c}' AS category, '{s}' AS valid" for c, subs in SUBCATEGORIES.items() for s in subs)
_in = lambda values: ", ".join(f"'{v}'" for v in values)
_PARSED = {
    "vocab": _VOCABULARY,
    "objects": r"""SELECT *, nullif(regexp_extract(raw, '\{[^}]+\}'), '') AS o FROM answers""",
    "parts": r"""SELECT *, nullif(regexp_extract(o, '"subcategory": "([^"]*)"', 1), '') AS s,
                   lower(nullif(regexp_extract(o, '"priority": "([^"]*)"', 1), '')) AS p,
                   lower(nullif(regexp_extract(o, '"sentiment": "([^"]*)"', 1), '')) AS m FROM objects""",
    "parsed": f"""SELECT parts.ticket_id, parts.category, valid AS new_subcategory,
                    CASE WHEN p IN ({_in(PRIORITIES)}) THEN p END AS new_priority,
                    CASE WHEN m IN ({_in(SENTIMENTS)}) THEN m END AS new_sentiment, raw,
                    subcategory, priority, customer_sentiment
                  FROM parts LEFT JOIN vocab ON vocab.category = parts.category AND lower(valid) = lower(s)""",
    "st": """SELECT *, CASE WHEN raw IS NULL THEN 'api_fail' WHEN coalesce(new_subcategory, new_priority,
               new_sentiment) IS NOT NULL THEN 'success' ELSE 'parse_fail' END AS status FROM parsed""",
}
ORACLES["parse_labels"] = query(
    "answers", "SELECT ticket_id, new_subcategory, new_priority, new_sentiment, status FROM st", _PARSED)
ORACLES["label_resumed"] = query("answers", """
    SELECT ticket_id, new_subcategory, new_priority, new_sentiment, status,
           CASE WHEN status = 'api_fail' THEN 2 ELSE 1 END AS attempts FROM st""", _PARSED)
ORACLES["label_status"] = query("answers", """
    SELECT status, count(*) AS n FROM st WHERE category NOT IN ('Data Issue', 'Other') GROUP BY status""", _PARSED)
ORACLES["apply_corrections"] = query("answers", """
    SELECT ticket_id, category, coalesce(new_subcategory, subcategory) AS subcategory,
           coalesce(new_priority, priority) AS priority,
           coalesce(new_sentiment, customer_sentiment) AS customer_sentiment FROM st""", _PARSED)
_CHANGED = "count(*) FILTER (new_{0} IS NOT NULL AND new_{0} IS DISTINCT FROM {1})"
ORACLES["label_change_stats"] = query("answers", " UNION ALL ".join(
    f"SELECT '{f}' AS field, {_CHANGED.format(f, c)} AS changed, count(*) AS total FROM st"
    for f, c in (("subcategory", "subcategory"), ("priority", "priority"),
                 ("sentiment", "customer_sentiment"))), _PARSED)

# ---- tables and logs ------------------------------------------------------------

ORACLES["latest_tickets"] = query("tickets_e", """
    SELECT ticket_id, product, category FROM tickets_e ORDER BY created_at DESC, ticket_id DESC LIMIT 500""")
ORACLES["label_prediction_log"] = query("pred_log latest_corrections", """
    SELECT ticket_id, predicted_category, corrected AS true_category,
           coalesce(predicted_category <> corrected, false) AS was_corrected
    FROM pred_log LEFT JOIN latest_corrections USING (ticket_id)""")
ORACLES["feedback_log"] = query("feedback", """
    SELECT corrected_category IS NOT NULL AS category_corrected, resolution_accepted, count(*) AS n
    FROM feedback GROUP BY 1, 2""")
ORACLES["event_rollup"] = query("system_events", f"""
    SELECT event_type, component, count(*) AS n,
           {r6("avg(CAST(coalesce(status, 'success') <> 'success' AS INTEGER))", 'error_rate')},
           {r6('avg(latency_ms)', 'mean_latency_ms')}, {r6('max(latency_ms)', 'max_latency_ms')},
           {r6('quantile_cont(latency_ms, 0.5)', 'p50_latency_ms')},
           {r6('quantile_cont(latency_ms, 0.95)', 'p95_latency_ms')}
    FROM system_events GROUP BY event_type, component""")
ORACLES["active_models"] = query("model_versions", """
    SELECT model_name, version FROM (SELECT *, row_number() OVER (
      PARTITION BY model_name ORDER BY trained_at DESC, version DESC) AS rn FROM model_versions) WHERE rn = 1""")
ORACLES["ticket_store"] = query("tickets_e", f"""
    SELECT category, product, count(*) AS n, {r6('avg(resolution_time_hours)', 'avg_hours')},
           epoch_us(date_trunc('milliseconds', min(created_at))) AS first_us, count(*) FILTER (escalated) AS escalated
    FROM tickets_e GROUP BY category, product""")
ORACLES["graph_store"] = query("tickets_d", """
    SELECT count(*) AS issues, CAST(sum(frequency) AS BIGINT) AS tickets,
           (SELECT count(*) FROM s) AS solutions, (SELECT CAST(sum(usage_count) AS BIGINT) FROM s) AS uses,
           (SELECT count(*) FROM m) AS mappings, (SELECT CAST(sum(occurrences) AS BIGINT) FROM m) AS occurrences
    FROM i""", {"i": _ISSUES, "s": _SOLUTIONS, "codes": _CODES, "m": _MAPPING})

ORACLES["ingest_job"] = query("tickets_d", """
    SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM s
    UNION ALL SELECT 'split', data_split, count(*) FROM s GROUP BY data_split
    UNION ALL SELECT 'category', category, count(*) FROM s GROUP BY category
    UNION ALL SELECT 'check', c.check_name, CAST(c.passed AS BIGINT) FROM checks c
    UNION ALL SELECT 'table', 'features', count(*) FROM s
    UNION ALL SELECT 'table', 'indexed', count(*) FROM s WHERE length(resolution) > 0
    UNION ALL SELECT 'table', 'vectors', count(*) FROM s WHERE length(resolution) > 0
    UNION ALL SELECT 'table', 'product_issues', count(*) FROM i
    UNION ALL SELECT 'table', 'issue_solutions', count(*) FROM sol
    UNION ALL SELECT 'table', 'error_code_mapping', count(*) FROM m""", {
    "s": _SPLIT.format("tickets_d"), "facts": _FACTS.format("tickets_d"), "checks": _CHECKS.format("true"),
    "i": _ISSUES, "sol": _SOLUTIONS, "codes": _CODES, "m": _MAPPING})

# ---- streaming ------------------------------------------------------------------


def _window(name: str, hours: int, slide: int) -> str:
    return f"""SELECT '{name}' AS "window", ((h // {slide}) - j) * {slide} * 3600000000 AS window_start, model_name,
                 count(*) AS n, sum(confidence) AS cs, count(*) FILTER (was_corrected) AS corrected
               FROM hours, unnest(range(0, {hours // slide})) AS t(j) GROUP BY ALL"""


ORACLES["stream_windows"] = query("pred_log", f"""
    SELECT "window", window_start, model_name, n, {r6('cs', 'confidence_sum')}, corrected
    FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3)""", {
    "hours": """SELECT *, epoch_us("timestamp") // 3600000000 AS h FROM pred_log""",
    "w1": _window("1h", 1, 1), "w2": _window("24h", 24, 1), "w3": _window("7d", 168, 24)})
ORACLES["stream_dedup"] = query("tickets_e", """
    SELECT ticket_id, category, product FROM tickets_e WHERE CAST(ticket_id AS BIGINT) % 50 <> 0
    UNION ALL
    SELECT NULL, category, product FROM tickets_e, range(2) WHERE CAST(ticket_id AS BIGINT) % 50 = 0""")
ORACLES["stream_hours"] = query("pred_log", f"""
    SELECT epoch_us(date_trunc('hour', "timestamp")) AS hour_us, model_name, count(*) AS n,
           round(CAST(sum(confidence) AS DOUBLE), 6) AS confidence_sum, CAST(count_if(was_corrected) AS BIGINT) AS corrected
    FROM pred_log GROUP BY date_trunc('hour', "timestamp"), model_name
    HAVING date_trunc('hour', "timestamp") < (SELECT max("timestamp") FROM pred_log) - INTERVAL 2 DAYS""")
ORACLES["stream_last_n"] = query("pred_log", f"""
    SELECT model_name, ticket_id, {r6('confidence')} FROM (SELECT *, row_number() OVER (
      PARTITION BY model_name ORDER BY "timestamp" DESC, ticket_id DESC) AS rn FROM pred_log) WHERE rn <= 1000""")
ORACLES["stream_monitoring"] = query("pred_log", _CONF_SIGNALS, _confidence("pred_log"))

_bin_cells = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, created_at FROM tickets_e WHERE {f} IS NOT NULL"
    for f in ("resolution_time_hours", "account_monthly_value"))
ORACLES["stream_bins"] = query("tickets_e", """
    SELECT (epoch_us(created_at) // 86400000000) * 86400000000 AS window_start, feature,
           CAST(CASE WHEN x > e[len(e)] THEN len(e) ELSE least(len(list_filter(e, lambda v: v <= x)), len(e) - 1) END AS INTEGER) AS bin,
           count(*) AS n
    FROM cells2 JOIN edges2 USING (feature) GROUP BY ALL""", {
    "cells2": _bin_cells,
    "edges2": """SELECT feature, list_sort(list_distinct(quantile_cont(x,
        [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e
        FROM cells2 WHERE created_at < TIMESTAMP '2024-01-08' GROUP BY feature"""})
