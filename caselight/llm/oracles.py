"""The queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .licenses import RULES, SENTENCES, normal, parts_of

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, separators: str = r"[\x20\x09-\x0D]+") -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{separators}'), lambda x: x <> '')"


OP1 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_words(_LOWER.format('text'))} AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS common
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2, 3
), l AS (
  SELECT a, b FROM c WHERE 100 * common >= 80 * (total - common)
), both_ways AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS reached FROM documents
  UNION
  SELECT r.doc_id, x.b FROM r JOIN both_ways x ON x.a = r.reached
), m AS (
  SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN m USING (doc_id)
"""

OP2 = f"""
WITH w AS (
  SELECT doc_id, {_words('text')} AS ws FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS t
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)
), later AS (
  SELECT doc_id, i FROM starts QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM later, range(20) AS r(k)
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) AS t
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w) p
  ANTI JOIN gone USING (doc_id, pos) GROUP BY 1
), removed AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY 1
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

_TERMS = _words(_LOWER.format("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
OP3 = f"""
WITH w AS (
  SELECT doc_id, {_TERMS} AS ws FROM documents
), items AS (
  SELECT item_id, ws, least(10, len(ws)) AS k FROM (SELECT item_id, {_TERMS} AS ws FROM benchmark) WHERE len(ws) > 0
), phrases AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i : i + k - 1], ' ') AS t
  FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM items)
), sizes AS (
  SELECT DISTINCT k FROM phrases
), places AS (
  SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS t
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, sizes)
), hits AS (
  SELECT doc_id, item_id, k, i FROM places JOIN phrases USING (k, t)
), inside AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(inside.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(inside.n, 0) > 0 AS contaminated
FROM w LEFT JOIN inside USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join(f"({_quoted(x)}, {_quoted(y)})" for x, y in rows)


def _op5() -> str:
    # a known sentence is the run of its parts; each distinct part has a token
    tokens: dict[str, str] = {}
    known: dict[str, str] = {}
    for name, sentence in SENTENCES.items():
        for own in ([normal(sentence)], parts_of(sentence)):
            known["".join(tokens.setdefault(x, f" {len(tokens)};") for x in own)] = name
    longest = "|".join(sorted(known, key=lambda r: -r.count(";")))
    runs = sorted({"".join(f" {x};" for x in run): name for name, run in RULES}.items(), key=lambda r: -r[0].count(";"))
    norm = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
WITH tokens(norm, token) AS (VALUES {_values([*tokens.items(), ("", "")])}), known(run, id) AS (VALUES {_values(known.items())}),
rules(run, license) AS (VALUES {_values(runs)}),
parts AS (
  SELECT doc_id, unnest(p) AS part, unnest(range(len(p))) AS pos FROM (
    SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;:])\s+|\n\s*\n', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents)
), whole AS (
  SELECT doc_id, part, pos, token FROM parts LEFT JOIN tokens ON norm = {norm.format('part')}
), lines AS (
  SELECT doc_id, pos, unnest(l) AS line, unnest(range(len(l))) AS sub
  FROM (SELECT doc_id, pos, string_split(part, chr(10)) AS l FROM whole WHERE token IS NULL)
), every AS (
  SELECT doc_id, pos, 0 AS sub, token FROM whole WHERE token IS NOT NULL
  UNION ALL
  SELECT doc_id, pos, sub, coalesce(token, ' -;') FROM lines LEFT JOIN tokens ON norm = {norm.format('line')}
), said AS (
  SELECT doc_id, regexp_extract_all(string_agg(token, '' ORDER BY pos, sub), {_quoted(longest)}) AS m FROM every GROUP BY 1
), sequences AS (
  SELECT doc_id, list(id ORDER BY place) AS ids
  FROM (SELECT doc_id, unnest(m) AS run, unnest(range(len(m))) AS place FROM said) JOIN known USING (run) GROUP BY 1
), matched AS (
  SELECT doc_id, regexp_extract_all(list_reduce(list_prepend('', list_transform(ids, lambda x: ' ' || x || ';')), lambda x, y: x || y),
    {_quoted('|'.join(r for r, _ in runs))}) AS m FROM sequences
), named AS (
  SELECT doc_id, string_agg(license, ',' ORDER BY license) AS names
  FROM (SELECT DISTINCT doc_id, license FROM (SELECT doc_id, unnest(m) AS run FROM matched) JOIN rules USING (run)) GROUP BY 1
)
SELECT d.doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids, CAST(coalesce(len(m), 0) AS BIGINT) AS n_matches, coalesce(names, '') AS licenses
FROM documents d LEFT JOIN sequences USING (doc_id) LEFT JOIN matched USING (doc_id) LEFT JOIN named USING (doc_id)
"""


OP7 = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_words('text')}) AS BIGINT) AS size,
    CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1
), weighed AS (
  SELECT *, 3 * source_size AS most, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM s
), steps AS (
  SELECT *, row_number() OVER o AS step,
    CAST((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
    CAST(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS share
  FROM weighed WINDOW o AS (ORDER BY most / weight, source NULLS LAST)
), fixed AS (
  SELECT rest, share FROM steps WHERE rest * weight <= most * share ORDER BY step LIMIT 1
), targets AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), CAST(f.rest * weight AS DOUBLE) / f.share) AS target FROM steps, fixed f
), placed AS (
  SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id) AS BIGINT) - size AS before
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS taken
FROM placed
"""

_ESCAPED = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"
OP8 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), loss AS (
  SELECT conv_id, string_agg(text, '' ORDER BY turn, role, text) AS l FROM t WHERE role = 'assistant' GROUP BY 1
), every AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(12 + length({_ESCAPED.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")}) + 1 + length({_ESCAPED.format('text')}) + 11) AS BIGINT) AS formatted_chars
  FROM t GROUP BY 1
)
SELECT conv_id, n_turns, turns_sha256, CAST(coalesce(length(l), 0) AS BIGINT) AS loss_chars, sha256(coalesce(l, '')) AS loss_sha256, formatted_chars
FROM every LEFT JOIN loss USING (conv_id)
"""

OP9 = r"""
WITH RECURSIVE bits(b, r, c) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) x(i)
  UNION ALL
  SELECT b, r + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE r < 8
), crc AS (
  SELECT list(c ORDER BY b) AS t FROM bits WHERE r = 8
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 16) AS UBIGINT) AS key FROM documents
), jumps(doc_id, k, b, j) AS (
  SELECT doc_id, CAST(key AS UHUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM d
  UNION ALL
  SELECT doc_id, k, b, CAST(((b + 1) * 2147483648) // CAST((k // 8589934592) + 1 AS BIGINT) AS BIGINT) FROM (
    SELECT doc_id, (k * CAST(2862933555777941757 AS UHUGEINT) + CAST(1 AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT) AS k, j AS b FROM jumps WHERE j < 25)
), placed AS (
  SELECT doc_id, max(j) FILTER (j < 24) AS shard, max(j) FILTER (j < 25) AS grown FROM jumps GROUP BY 1
), sums AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32 FROM d, crc
)
SELECT doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(text))) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM d JOIN placed USING (doc_id) JOIN sums USING (doc_id)
"""

OP12 = rf"""
WITH RECURSIVE bits(b, r, c) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) x(i)
  UNION ALL
  SELECT b, r + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE r < 8
), crc AS (
  SELECT list(c ORDER BY b) AS t FROM bits WHERE r = 8
), w AS (
  SELECT 'd' AS side, doc_id AS id, {_TERMS} AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, {_TERMS} FROM benchmark
), f AS (
  SELECT side, id, array_to_string(ws[i : i + k - 1], ' ') AS f
  FROM (SELECT side, id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 4) r(k))
), terms AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)
), hashed(f, h, k, c) AS (
  SELECT f, h, 1, CAST(4294967295 AS BIGINT) FROM terms
  UNION ALL
  SELECT f, h, k + 2, xor(c >> 8, t[(xor(c, CAST('0x' || substr(h, k, 2) AS BIGINT)) & 255) + 1]) FROM hashed, crc WHERE k < length(h)
), buckets AS (
  SELECT f, xor(4294967295, c) % 10000 AS bucket FROM hashed WHERE k > length(h)
), n AS (
  SELECT side, id, bucket, count(*) AS n FROM f JOIN buckets USING (f) GROUP BY 1, 2, 3
), sums AS (
  SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 'd'), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 'b'), 0) AS DOUBLE) AS t FROM n GROUP BY 1
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS BIGINT) AS gain FROM sums
), weights AS (
  SELECT id, CAST(sum(n * gain) AS BIGINT) AS weight, CAST(sum(n) AS BIGINT) AS n_features FROM n JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1
), scores AS (
  SELECT w.id AS doc_id, len(ws) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || w.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN weights USING (id) WHERE side = 'd'
), places AS (
  SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY fit) AS fits FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * fits // 100 THEN place END AS rank FROM places
"""

ORACLES = {
    "op1_near_dedup": OP1,
    "op2_substring_dedup": OP2,
    "op3_decontamination": OP3,
    "op5_license_scan": _op5(),
    "op7_mixing": OP7,
    "op8_chat_format": OP8,
    "op9_sharding": OP9,
    "op12_importance_resampling": OP12,
}
