"""What the corpus queries return, as SQL for DuckDB.

The others (a learned score, XXH64, a graph search, a tokenizer, CRC-32) are beyond
SQL; tests/llm compares them with brute force.
"""

from __future__ import annotations

from codeloom.llm.licenses import LICENSE_FILE, MIN_COSINE, NOTICE_LINE, TEMPLATES

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
    max(page_id) OVER (PARTITION BY h) AS m
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND m <> page_id THEN m END AS refers_to
FROM x
"""

_templates = ", ".join(f"('{t.license}', '{t.text}')" for t in TEMPLATES)
_tokens = f"unnest(regexp_extract_all({_FOLD.format('text')}, '[a-z0-9]+'))"
_module = "coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/m' || doc_id % 97"

_LICENSES = f"""
WITH RECURSIVE files AS (
  SELECT CASE
    WHEN coalesce(regexp_matches(text, '{NOTICE_LINE}'), false) AND doc_id % 2 = 0 THEN
      CASE doc_id % 3 WHEN 0 THEN coalesce(source, 'none')
        WHEN 1 THEN coalesce(source, 'none') || '/' || coalesce(lang, 'none')
        ELSE {_module} END || '/LICENSE.' || doc_id
    ELSE {_module} || '/f' || doc_id || '.txt' END AS path, text
  FROM documents
),
lines AS (SELECT path, unnest(string_split(text, chr(10))) AS text FROM files),
bags AS (
  SELECT path, token, count(*) AS tf FROM (
    SELECT path, {_tokens} AS token FROM lines WHERE regexp_matches(text, '{NOTICE_LINE}')
  ) GROUP BY ALL
),
terms AS (
  SELECT license, token, count(*) AS tf
  FROM (SELECT license, {_tokens} AS token FROM (VALUES {_templates}) v(license, text)) GROUP BY ALL
),
n AS (SELECT count(DISTINCT path) AS n FROM bags),
idf AS (
  SELECT token, ln((1.0::DOUBLE + (SELECT n FROM n)) / (1 + coalesce(df, 0))) + 1 AS idf
  FROM (SELECT DISTINCT token FROM terms)
  LEFT JOIN (SELECT token, count(*) AS df FROM bags GROUP BY token) USING (token)
),
vectors AS (SELECT license, token, tf * idf AS w FROM terms JOIN idf USING (token)),
lengths AS (SELECT license, sqrt(sum(w * w)) AS template_length FROM vectors GROUP BY license),
own AS (
  SELECT path, token, tf * coalesce(idf, ln((1.0::DOUBLE + (SELECT n FROM n)) / 2) + 1) AS weight
  FROM bags LEFT JOIN idf USING (token)
),
size AS (SELECT path, sqrt(sum(weight * weight)) AS length FROM own GROUP BY path),
scored AS (
  SELECT path, license, round(dot / (length * template_length), 6) AS cosine FROM (
    SELECT path, license, sum(weight * w) AS dot FROM own JOIN vectors USING (token) GROUP BY ALL
  ) JOIN size USING (path) JOIN lengths USING (license)
),
found AS (
  SELECT path, license, cosine FROM scored WHERE cosine >= {MIN_COSINE}
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, license) = 1
),
paths AS (SELECT DISTINCT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files),
licensed AS (
  SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, license, cosine FROM found
  WHERE regexp_matches(path, '{LICENSE_FILE}')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license) = 1
),
up AS (
  SELECT DISTINCT dir, dir AS ancestor FROM paths
  UNION
  SELECT dir, regexp_extract(ancestor, '^(.*)/[^/]*$', 1) FROM up WHERE ancestor <> ''
),
nearest AS (
  SELECT up.dir, up.ancestor, l.license, l.cosine FROM up JOIN licensed l ON l.dir = up.ancestor
  QUALIFY row_number() OVER (PARTITION BY up.dir ORDER BY length(up.ancestor) DESC) = 1
)
SELECT p.path, coalesce(f.license, a.license) AS license, coalesce(f.cosine, a.cosine) AS cosine,
  CASE WHEN f.license IS NOT NULL AND regexp_matches(p.path, '{LICENSE_FILE}') THEN 'file'
    WHEN f.license IS NOT NULL THEN 'header' WHEN a.dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN f.license IS NULL THEN a.ancestor END AS from_dir
FROM paths p LEFT JOIN found f ON f.path = p.path LEFT JOIN nearest a ON a.dir = p.dir
"""

# The problems of each kind of arguments under each tool's schema.
_ERRORS = {
    "search": {
        "a": [], "b": [], "c": ["missing:query", "unexpected:amount", "unexpected:unit"],
        "d": ["missing:query", "unexpected:exact", "unexpected:ids"], "e": ["type:query"],
    },
    "convert": {
        "a": ["missing:amount", "missing:unit", "unexpected:limit", "unexpected:query"],
        "b": ["missing:amount", "missing:unit", "unexpected:limit", "unexpected:query"],
        "c": [], "d": ["missing:amount", "missing:unit", "unexpected:exact", "unexpected:ids"],
        "e": ["missing:amount", "missing:unit", "unexpected:query"],
    },
    "lookup": {
        "a": ["missing:ids", "unexpected:limit", "unexpected:query"],
        "b": ["missing:ids", "unexpected:limit", "unexpected:query"],
        "c": ["missing:ids", "unexpected:amount", "unexpected:unit"], "d": [],
        "e": ["missing:ids", "unexpected:query"],
    },
}
_errors = ", ".join(
    f"('{tool}', '{kind}', {own}::VARCHAR[])" for tool, kinds in _ERRORS.items() for kind, own in kinds.items()
)

_CALLS = f"""
WITH RECURSIVE rows AS (
  SELECT *, conv_id * 7 + turn AS k, to_json(coalesce(text, ''))::VARCHAR AS q, coalesce(length(text), 0) AS n
  FROM conversations
),
schemas AS (SELECT * FROM (VALUES {_errors}) v(name, kind, own)),
made AS (
  SELECT conv_id, 'c' || CASE WHEN k % 13 = 0 AND turn > 2 THEN turn - 2 ELSE turn END AS call_id, turn,
    CASE k % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'convert' WHEN 2 THEN 'lookup' ELSE 'wipe' END AS name,
    CASE WHEN k % 35 = 0 OR k % 6 = 5 THEN 'x' ELSE substr('abcde', (k % 6 + 1)::INT, 1) END AS kind,
    CASE WHEN k % 35 = 0 THEN '{{"query":' || q || '}} tail'
      WHEN k % 6 = 0 THEN '{{"query":' || q || ',"limit":' || n || '}}'
      WHEN k % 6 = 1 THEN '{{ "limit": ' || n || ', "query": ' || q || ' }}'
      WHEN k % 6 = 2 THEN '{{"unit":' || q || ',"amount":' || n || '.5}}'
      WHEN k % 6 = 3 THEN '{{"ids":[' || n || ',' || q || '],"exact":true}}'
      WHEN k % 6 = 4 THEN '{{"query":[' || q || ']}}' ELSE '{{"query":' || q END AS raw,
    CASE WHEN k % 35 = 0 THEN NULL
      WHEN k % 6 <= 1 THEN '{{"limit":' || n || ',"query":' || q || '}}'
      WHEN k % 6 = 2 THEN '{{"amount":' || n || '.5,"unit":' || q || '}}'
      WHEN k % 6 = 3 THEN '{{"exact":true,"ids":[' || n || ',' || q || ']}}'
      WHEN k % 6 = 4 THEN '{{"query":[' || q || ']}}' END AS arguments,
    list_filter([
      CASE WHEN turn % 8 > 1 THEN 'c' || (turn - turn % 8 + 1) END,
      CASE WHEN turn % 4 = 3 THEN 'c' || (turn - 2) END,
      CASE WHEN conv_id % 50 = 7 AND turn = 1 THEN 'c5' END
    ], lambda x: x IS NOT NULL) AS after
  FROM rows WHERE role = 'assistant'
),
answers AS (
  SELECT conv_id, CASE WHEN role = 'user' THEN CASE WHEN k % 11 = 0 THEN 'x' || turn ELSE 'c' || (turn - 1) END END AS call_id,
    turn, text AS content
  FROM rows WHERE role IS NULL OR role <> 'assistant'
),
keyed_calls AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn NULLS FIRST, name NULLS FIRST, raw NULLS FIRST, after) AS place,
    count(*) OVER (PARTITION BY conv_id, call_id) AS total
  FROM made WHERE conv_id IS NOT NULL AND call_id IS NOT NULL
),
keyed_results AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn NULLS FIRST, content NULLS FIRST) AS place,
    count(*) OVER (PARTITION BY conv_id, call_id) AS total
  FROM answers WHERE conv_id IS NOT NULL AND call_id IS NOT NULL
),
calls AS (SELECT * FROM keyed_calls WHERE place = 1),
results AS (SELECT * FROM keyed_results WHERE place = 1),
needs AS (SELECT DISTINCT conv_id, call_id, unnest(after) AS dep FROM calls),
edges AS (SELECT n.* FROM needs n SEMI JOIN calls c ON c.conv_id = n.conv_id AND c.call_id = n.dep),
steps AS (
  SELECT conv_id, call_id, 0 AS level FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.conv_id = c.conv_id AND e.call_id = c.call_id)
  UNION
  SELECT e.conv_id, e.call_id, level + 1 FROM steps s JOIN edges e ON e.conv_id = s.conv_id AND e.dep = s.call_id
),
-- a call behind a cycle may be reached from elsewhere, but has no level
blocked AS (
  SELECT conv_id, call_id FROM calls ANTI JOIN steps USING (conv_id, call_id)
  UNION
  SELECT e.conv_id, e.call_id FROM blocked b JOIN edges e ON e.conv_id = b.conv_id AND e.dep = b.call_id
),
levels AS (SELECT conv_id, call_id, max(level) AS level FROM steps ANTI JOIN blocked USING (conv_id, call_id) GROUP BY ALL),
lost AS (
  SELECT conv_id, call_id, list('unknown_dependency:' || dep) AS lost FROM needs n
  ANTI JOIN calls c ON c.conv_id = n.conv_id AND c.call_id = n.dep GROUP BY ALL
),
sizes AS (
  SELECT conv_id, call_id, coalesce(c.total, 0) AS n_calls, coalesce(r.total, 0) AS n_results
  FROM calls c FULL JOIN results r USING (conv_id, call_id)
),
whole AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, c.name, c.kind,
    c.raw, c.arguments, r.turn AS result_turn, content, 1 AS repeat, 1 AS copies,
    CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS link
  FROM calls c FULL JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
  UNION ALL
  SELECT conv_id, call_id, turn, name, kind, raw, arguments, NULL, NULL,
    1 + row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn NULLS FIRST, name NULLS FIRST, raw NULLS FIRST, after),
    count(*), 'duplicate'
  FROM keyed_calls WHERE place > 1 GROUP BY conv_id, call_id, turn, name, kind, raw, arguments, after
  UNION ALL
  SELECT conv_id, call_id, NULL, NULL, NULL, NULL, NULL, turn, content,
    1 + row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn NULLS FIRST, content NULLS FIRST), count(*), 'duplicate'
  FROM keyed_results WHERE place > 1 GROUP BY conv_id, call_id, turn, content
  UNION ALL
  SELECT conv_id, call_id, turn, name, kind, raw, arguments, NULL, NULL, NULL, count(*), 'unkeyed'
  FROM made WHERE conv_id IS NULL OR call_id IS NULL GROUP BY conv_id, call_id, turn, name, kind, raw, arguments, after
  UNION ALL
  SELECT conv_id, call_id, NULL, NULL, NULL, NULL, NULL, turn, content, NULL, count(*), 'unkeyed'
  FROM answers WHERE conv_id IS NULL OR call_id IS NULL GROUP BY ALL
),
joined AS (
  SELECT w.*, CASE WHEN link IN ('linked', 'unanswered') THEN level END AS level,
    CASE WHEN link <> 'unkeyed' THEN n_calls WHEN raw IS NOT NULL THEN copies ELSE 0 END AS n_calls,
    CASE WHEN link <> 'unkeyed' THEN n_results WHEN raw IS NOT NULL THEN 0 ELSE copies END AS n_results,
    CASE WHEN raw IS NULL THEN [] ELSE list_sort(list_concat(
      CASE WHEN w.kind = 'x' THEN ['not_an_object'] ELSE coalesce(own, ['unknown_tool']) END,
      CASE link WHEN 'duplicate' THEN ['duplicate_identifier'] WHEN 'unkeyed' THEN ['no_identifier']
        ELSE list_concat(coalesce(lost, []), CASE WHEN level IS NULL THEN ['cycle'] ELSE [] END) END)) END AS problems
  FROM whole w
  LEFT JOIN schemas s ON s.name = w.name AND s.kind = w.kind
  LEFT JOIN levels l ON l.conv_id = w.conv_id AND l.call_id = w.call_id
  LEFT JOIN lost o ON o.conv_id = w.conv_id AND o.call_id = w.call_id
  LEFT JOIN sizes z ON z.conv_id = w.conv_id AND z.call_id = w.call_id
)
SELECT conv_id, level, turn, call_id, result_turn, link, repeat::BIGINT AS repeat, copies::BIGINT AS copies,
  n_calls::BIGINT AS n_calls, n_results::BIGINT AS n_results,
  raw IS NOT NULL AND len(problems) = 0 AS valid, array_to_string(problems, ';') AS errors,
  '{{' || CASE WHEN arguments IS NULL THEN '' ELSE '"arguments":' || arguments || ',' END
  || CASE WHEN call_id IS NULL THEN '' ELSE '"call_id":"' || call_id || '",' END
  || CASE WHEN conv_id IS NULL THEN '' ELSE '"conv_id":' || conv_id || ',' END
  || '"errors":' || to_json(problems)::VARCHAR
  || CASE WHEN level IS NULL THEN '' ELSE ',"level":' || level END || ',"link":"' || link || '"'
  || CASE WHEN name IS NULL THEN '' ELSE ',"name":"' || name || '"' END
  || CASE WHEN raw IS NULL OR arguments IS NOT NULL THEN '' ELSE ',"raw_arguments":' || to_json(raw)::VARCHAR END
  || CASE WHEN repeat IS NULL THEN '' ELSE ',"repeat":' || repeat END
  || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content)::VARCHAR END || '}}' AS json
FROM joined
"""

# Backslashes and control characters are given by number, as the pattern must reach RE2 as it is.
_WORDS = f"regexp_extract_all({_FOLD.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, len(part) AS n, array_to_string(part, ' ') AS part FROM (
    SELECT item_id, list_slice(w, i, i + 9) AS part
    FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
  )
),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS part FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n
  )
),
occurrences AS (SELECT doc_id, item_id, i, p.n FROM places p JOIN windows w ON w.part = p.part AND w.n = p.n),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM occurrences) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM occurrences) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_PHRASES = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM d),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM starts, (SELECT unnest(range(1, 5)) AS m) sizes WHERE i + m - 1 <= len(w)
),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS p FROM f WHERE m >= 2 AND f >= 30),
cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, l.f AS l, r.f AS r,
    ((2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(p[1 : k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(p[k + 1 : c.m], ' ')
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, a, array_to_string(p[i : i + s - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, m)) AS i FROM c WHERE m > 2), (SELECT unnest(range(2, 4)) AS s) sizes
  WHERE s < m AND i + s - 1 <= m
),
most AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY lang, phrase),
kept AS (
  SELECT best.* FROM best LEFT JOIN most USING (lang, phrase)
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM kept
) JOIN n USING (lang) WHERE rank <= 2000
"""

CHECKS = {
    "op2_warc_bundles": _WARC,
    "op3_license_scan": _LICENSES,
    "op7_tool_calls": _CALLS,
    "op9_benchmark_decontamination": _DECONTAMINATION,
    "op12_phrase_mining": _PHRASES,
}
