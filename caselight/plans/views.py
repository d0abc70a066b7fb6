"""The bindings as SQL, for checking results in another engine."""

from __future__ import annotations

from caselight.plans import bindings as b


def _list(values: list[str], index: str) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"([{items}])[CAST(1 + ({index}) % {len(values)} AS BIGINT)]"


_EVENT_LIST = "[" + ", ".join(f"'{v}'" for v in b.EVENT_TYPES) + "]"


def _shifted(every: int) -> str:
    return (
        f"CASE WHEN event_no % {every} = 0 "
        f"THEN {_list(b.EVENT_TYPES, f'list_position({_EVENT_LIST}, category)')} ELSE category END"
    )


_VIEWS = {
    "tickets_e": f"""
        SELECT CAST(event_id AS VARCHAR) AS ticket_id, event_id AS event_no, ts AS created_at,
               CAST(user_id AS VARCHAR) AS customer_id, event_type AS category,
               'S' || (k % 3) AS subcategory, 'P' || (k % 5) AS product, 'A' || (k % 20) AS agent_id,
               {_list(b.PRIORITIES, 'k')} AS priority, {_list(b.SEVERITIES, 'k + event_id')} AS severity,
               {_list(b.MOODS, 'event_id')} AS customer_sentiment,
               {_list(b.TIERS, 'user_id')} AS customer_tier, {_list(b.CHANNELS, 'event_id')} AS channel,
               {_list(b.SKILLS, 'k')} AS agent_specialization,
               CASE WHEN k % 4 <> 0 THEN k % 60 END AS agent_experience_months,
               value AS resolution_time_hours,
               CASE WHEN k % 10 <> 0 THEN CAST(1 + event_id % 5 AS INTEGER) END AS satisfaction_score,
               event_id % 9 = 0 AS escalated,
               CASE WHEN k % 7 <> 0 THEN event_id % 3 <> 0 END AS resolution_helpful,
               CAST(1 + event_id % 8 AS INTEGER) AS response_count,
               CAST(1 + event_id % 4 AS INTEGER) AS resolution_attempts, k % 3 AS transferred_count,
               CAST(100 + (event_id * 37) % 900 AS INTEGER) AS ticket_text_length,
               CAST(user_id % 20 AS INTEGER) AS previous_tickets,
               CAST((user_id * 13) % 1500 AS INTEGER) AS account_age_days,
               value * (10 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) AS account_monthly_value,
               CAST(event_id % 11 AS INTEGER) AS similar_issues_last_30_days,
               CASE WHEN k % 6 <> 0 THEN (k * 3) % 200 END AS product_version_age_days,
               CAST(1 + event_id % 40 AS INTEGER) AS affected_users, k % 4 AS attachments_count,
               event_id % 4 = 0 AS contains_error_code, event_id % 6 = 0 AS contains_stack_trace,
               isodow(ts) >= 6 AS weekend_ticket, (hour(ts) < 8 OR hour(ts) > 18) AS after_hours
        FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
    "tickets_d": f"""
        SELECT CAST(doc_id AS VARCHAR) AS ticket_id, doc_id AS doc_no,
               TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS BIGINT)) AS created_at,
               lang AS category, 'S' || (doc_id % 3) AS subcategory, source AS product,
               {_list(b.PRIORITIES, 'doc_id')} AS priority, {_list(b.MOODS, 'doc_id')} AS customer_sentiment,
               'C' || (doc_id % 97) AS customer_id, split_part(text, chr(10), 1) AS subject,
               text || ' ' || code AS description,
               CASE WHEN contains(text, chr(10))
                    THEN nullif(substr(text, instr(text, chr(10)) + 1), '') END AS resolution,
               'RC' || (doc_id % 6) AS resolution_code, quality = 1 AS resolution_helpful,
               toxic = 1 AS escalated, CAST(1 + doc_id % 5 AS INTEGER) AS satisfaction_score,
               n_chars / 100.0::DOUBLE AS resolution_time_hours,
               CASE WHEN doc_id % 3 <> 0 THEN code || ' retry ' || code || ' then ERROR_NET_'
                    || (doc_id % 5) || chr(10) || 'second line' END AS error_logs,
               'tag' || (doc_id % 9) AS tag,
               doc_id % 4 = 0 AS contains_error_code,
               CASE WHEN doc_id % 5 <> 0 THEN doc_id % 6 = 0 END AS contains_stack_trace,
               CASE WHEN doc_id % 6 <> 0 THEN CAST(doc_id % 200 AS INTEGER) END AS product_version_age_days
        FROM (SELECT documents.*, labels.quality, labels.toxic,
                     'ERROR_' || upper(source) || '_' || (documents.doc_id % 7) AS code
              FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)""",
    "tickets_o": """
        SELECT CAST(o_orderkey AS VARCHAR) AS ticket_id, o_orderdate AS created_at,
               CAST(o_custkey AS VARCHAR) AS customer_id, o_orderstatus AS category,
               o_orderpriority AS priority, c_mktsegment AS product,
               o_totalprice / 1000.0::DOUBLE AS resolution_time_hours
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "tickets_p": """
        SELECT CAST(page_id AS VARCHAR) AS ticket_id, url AS subject, html AS description,
               html AS resolution FROM pages""",
    "queries_b": f"""
        SELECT CAST(item_id AS VARCHAR) AS query_id, item_id AS item_no,
               split_part(text, chr(10), 1) AS subject,
               text || ' ERROR_SRC' || (item_id % 20) || '_' || (item_id % 7) || ' ERROR_NET_'
                    || (item_id % 5) AS description,
               'src' || (item_id % 20) AS product,
               {_list([*b.LANGS, 'xx'], 'item_id')} AS predicted_category,
               'S' || (item_id % 3) AS predicted_subcategory,
               {_list(b.PRIORITIES, 'item_id')} AS predicted_priority,
               {_list(b.MOODS, 'item_id')} AS predicted_sentiment
        FROM benchmark""",
    "vectors_v": """
        SELECT CAST(vec_id AS VARCHAR) AS ticket_id, 'L' || label AS category,
               'P' || (vec_id % 5) AS product, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings""",
    "pred_log": f"""
        SELECT ticket_id, created_at AS "timestamp", predicted_category,
               0.5::DOUBLE + (event_no % 50) / 100.0::DOUBLE AS confidence,
               'model_' || (event_no % 2) AS model_name, true_category,
               coalesce(predicted_category <> true_category, false) AS was_corrected,
               category AS actual_category, event_no
        FROM (SELECT *, {_shifted(6)} AS predicted_category,
                     CASE WHEN event_no % 4 = 0 THEN category END AS true_category FROM tickets_e)""",
    "shadow_log": f"""
        SELECT ticket_id, {_shifted(7)} AS predicted_category,
               0.52::DOUBLE + (event_no % 47) / 100.0::DOUBLE AS confidence FROM tickets_e""",
    "feedback": f"""
        SELECT ticket_id, category AS predicted_category,
               CASE WHEN event_no % 6 = 0 THEN
                 {_list(b.EVENT_TYPES, f'list_position({_EVENT_LIST}, category)')} END AS corrected_category,
               CASE WHEN event_no % 3 = 1 THEN true WHEN event_no % 3 = 2 THEN false END AS resolution_accepted,
               agent_id, created_at AS feedback_at FROM tickets_e""",
    "corrections": f"""
        SELECT ticket_id, CASE WHEN event_no % 5 = 0 THEN 'first' END AS corrected,
               created_at AS corrected_at FROM tickets_e
        UNION ALL
        SELECT ticket_id, CASE WHEN event_no % 5 = 0 THEN {_list(b.EVENT_TYPES, 'event_no')} END,
               created_at + INTERVAL 1 HOUR FROM tickets_e""",
    "latest_corrections": """
        SELECT ticket_id, arg_max(corrected, corrected_at) AS corrected FROM corrections
        WHERE corrected IS NOT NULL GROUP BY ticket_id""",
    "answers": f"""
        SELECT ticket_id, category, sub AS subcategory, lower(pri) AS priority,
               lower(mood) AS customer_sentiment, body,
               CASE n % 7
                 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```'
                 WHEN 1 THEN 'Here is the answer: ' || body || ' I hope it helps.'
                 WHEN 2 THEN '```' || body || '```'
                 WHEN 3 THEN '  ' || body || chr(10)
                 WHEN 4 THEN '{{"subcategory": "Corruption", '
                 WHEN 5 THEN '{{"priority": "' || pri || '"}}' END AS raw
        FROM (SELECT *, '{{"subcategory": "' || sub || '", "priority": "' || pri
                        || '", "sentiment": "' || mood || '"}}' AS body
              FROM (SELECT event_id AS n, CAST(event_id AS VARCHAR) AS ticket_id,
                      {_list(['Data Issue', 'Technical Issue', 'Feature Request', 'Other'], 'event_id')} AS category,
                      {_list(['Corruption', 'crash/bug', 'UI ENHANCEMENT', 'Sync Error', 'Billing'], 'event_id')} AS sub,
                      {_list(['Angry', 'neutral', 'grateful', 'bored'], 'event_id')} AS mood,
                      {_list(['HIGH', 'low', 'urgent'], 'event_id')} AS pri
                    FROM events))""",
    "system_events": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, ts AS "timestamp", value AS latency_ms,
               'component_' || (event_id % 3) AS component,
               CASE WHEN event_id % 10 = 0 THEN 'error' WHEN event_id % 25 = 1 THEN 'timeout' END AS status
        FROM events""",
    "model_versions": """
        SELECT 'model_' || (s_nationkey % 7) AS model_name, s_name AS version,
               TIMESTAMP '2024-01-01' + to_hours(CAST(s_suppkey * 7919 % 500 AS BIGINT)) AS trained_at
        FROM supplier""",
}

_VIEWS["tickets_a"] = """
    SELECT * REPLACE (
        ticket_id || '-' || copy AS ticket_id,
        CASE WHEN created_at >= newest - INTERVAL 2 DAY AND product = 'P4' AND event_no % 2 = 0 THEN 'outage' ELSE category END AS category,
        CASE WHEN created_at >= newest - INTERVAL 1 DAY AND product = 'P3' THEN 'angry' ELSE customer_sentiment END AS customer_sentiment)
    FROM (SELECT *, unnest(range(1, 1 + CASE WHEN created_at >= newest - INTERVAL 7 DAY AND product = 'P1' THEN 9
                                             WHEN created_at >= newest - INTERVAL 7 DAY AND product = 'P2' THEN 2 ELSE 1 END)) AS copy
          FROM tickets_e, (SELECT max(created_at) AS newest FROM tickets_e))"""

_NEEDS = {
    "tickets_a": ["tickets_e"],
    "pred_log": ["tickets_e"], "shadow_log": ["tickets_e"], "feedback": ["tickets_e"],
    "corrections": ["tickets_e"], "latest_corrections": ["corrections"],
}


def _closure(names) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in [*_closure(_NEEDS.get(n, [])), n]:
            if m not in out:
                out.append(m)
    return out


#: Steps that a statement reads more than once and that are dear to compute.
_KEPT = {"docs", "post", "raw", "terms"}


def query(views: str, body: str, steps: dict[str, str] | None = None) -> str:
    """A statement with the named views and further steps in front of ``body``."""
    parts = [f"{n} AS ({_VIEWS[n]})" for n in _closure(views.split())]
    parts += [f"{n} AS {'MATERIALIZED ' if n in _KEPT else ''}({s})" for n, s in (steps or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
