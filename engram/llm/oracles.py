"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from .decontaminate import SHARE, WINDOW
from .divergence import LEAST_DOCUMENTS, TOP, UNIT
from .licenses import RARE, TEMPLATES
from .ngram_join import PERCENT
from .ngram_join import WORDS as SHINGLE
from .quality import KEEP_SHARE, LINE_DOCUMENTS, MIN_WORDS
from .sharding import ROW_BYTES, SHARDS
from .url_filter import LISTED, RULES

_RULES = sorted(RULES, key=lambda r: -len(r[0] + r[1]))


def _rule_case(column: int) -> str:
    when = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[column]}'" for h, p, v in _RULES)
    return f"CASE {when} END"


URL_FILTER = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), listed AS (SELECT unnest({list(LISTED)!r}) AS k)
SELECT page_id, host, path, {_rule_case(0)} AS rule,
       coalesce({_rule_case(1)}, CASE WHEN EXISTS (SELECT 1 FROM listed WHERE host = k OR ends_with(host, '.' || k)) THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed
"""

#: CRC-32 (reflected polynomial 0xEDB88320): a table by its rule, then one step per byte.
SHARDING = f"""
WITH table_of AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)
), sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), sums AS (
  SELECT doc_id, size::BIGINT AS size,
         xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32
  FROM sized, table_of
), placed AS (
  SELECT *, sum(size) OVER w AS upto, sum(size) OVER () AS total, row_number() OVER w AS place
  FROM sums WINDOW w AS (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING)
), cut AS (
  SELECT *, least({SHARDS} - 1, ((2 * upto - size) * {SHARDS}) // (2 * total))::INTEGER AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM cut
"""

CHAT_FORMATTING = r"""
WITH probe AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, replace(replace(text, '\', '\b'), '<', '\l') AS safe,
         CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) THEN 0 ELSE 1 END AS opens FROM probe
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(safe) + CASE WHEN opens = 1 THEN length('<turn >') + length(role) + 1 + length('</turn>') + 1 ELSE length('<part>') END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"[^\x20\x09-\x0D]+"

DECONTAMINATION = rf"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, len, array_to_string(w[p:p + len - 1], ' ') AS win
  FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS len, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS p FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), spots AS (
  SELECT doc_id, p, len, array_to_string(w[p:p + len - 1], ' ') AS win
  FROM (SELECT doc_id, w, l.len, unnest(range(1, len(w) - l.len + 2)) AS p FROM doc_words, (SELECT DISTINCT len FROM windows) AS l)
), hits AS (
  SELECT doc_id, p, len, item_id FROM spots JOIN windows USING (len, win)
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + len)) AS place FROM (SELECT DISTINCT doc_id, p, len FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit > 0 AND {SHARE} * n_hit >= len(w), false) AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NGRAM_JACCARD = rf"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_WORDS}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, least({SHINGLE}, len(w)) AS k, unnest(range(1, greatest(1, len(w) - {SHINGLE} + 1) + 1)) AS p FROM doc_words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * same >= {PERCENT} * (a.n + b.n - same)
), ends AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT x, y FROM ends UNION SELECT r.x, e.y FROM reached r JOIN ends e ON r.y = e.x
), least AS (
  SELECT x, min(y) AS y FROM reached GROUP BY x
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON x = doc_id
"""

QUALITY_RULES = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents
), windows AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS times FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM docs)
), repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS place FROM windows WHERE times > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, text, line, regexp_extract_all(line, '{_WORDS}') AS lw FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM docs)
), norms AS (
  SELECT *, translate(array_to_string(lw, ' '), {_LOWER}) AS norm FROM lines WHERE len(lw) > 0
), twice AS (
  SELECT doc_id, (count(*) - count(DISTINCT line)) AS n FROM norms GROUP BY doc_id
), common AS (
  SELECT source, norm FROM norms GROUP BY source, norm HAVING count(DISTINCT text) > {LINE_DOCUMENTS}
), gone AS (
  SELECT doc_id, sum(len(lw)) AS n FROM norms JOIN common ON common.norm = norms.norm AND common.source IS NOT DISTINCT FROM norms.source GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(twice.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM docs LEFT JOIN twice USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= {KEEP_SHARE} * n_words AS kept
FROM counted
"""

_TEMPLATE_ROWS = ", ".join(f"({k}, {t.label!r}, {t.base}, {t.slack}, {t.words!r}, {t.phrases!r})" for k, t in enumerate(TEMPLATES))

LICENSE_SCAN = rf"""
WITH templates(t, label, base, slack, tw, phrases) AS (VALUES {_TEMPLATE_ROWS}
), docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), spelled AS (
  SELECT t, j, tw[j + 1] AS word FROM (SELECT t, tw, unnest(range(len(tw))) AS j FROM templates)
), total AS (
  SELECT count(*) AS n FROM docs
), spots AS (
  SELECT doc_id, i, w[i + 1] AS word FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM docs) WHERE w[i + 1] IN (SELECT word FROM spelled)
), holding AS (
  SELECT word, count(DISTINCT doc_id) AS df FROM spots GROUP BY word
), weighed AS (
  SELECT t, j, word, coalesce(df, 0) AS df, length(bin((n + 1) // (coalesce(df, 0) + 1))) AS weight FROM spelled LEFT JOIN holding USING (word), total
), entries AS (
  SELECT t, word, place FROM (
    SELECT t, word, place, row_number() OVER (PARTITION BY t ORDER BY df, place) AS k FROM (SELECT t, word, min(j) AS place, min(df) AS df FROM weighed GROUP BY t, word)
  ) WHERE k <= {RARE}
), candidates AS (
  SELECT doc_id, t, i - place AS start FROM spots JOIN entries USING (word) JOIN (SELECT t, (count(*) + 1) // 2 AS need FROM entries GROUP BY t) USING (t)
  GROUP BY doc_id, t, i - place HAVING count(*) >= min(need)
), read AS (
  SELECT doc_id, t, start, label, base, phrases, tw, w,
         ' ' || array_to_string(w[greatest(start - slack, 0) + 1:greatest(start - slack, 0) + len(tw) + 2 * slack], ' ') || ' ' AS around
  FROM candidates JOIN templates USING (t) JOIN docs USING (doc_id) WHERE start >= 0 OR slack > 0
), found AS (
  SELECT doc_id, t, start, label, base FROM read WHERE len(list_filter(phrases, lambda k: NOT contains(around, k))) = 0
), scored AS (
  SELECT doc_id, t, start, any_value(label) AS label, any_value(base) AS base, (coalesce(sum(weight) FILTER (WHERE start + j >= 0 AND w[start + j + 1] = word), 0))::DOUBLE / sum(weight)::DOUBLE AS score
  FROM found JOIN weighed USING (t) JOIN docs USING (doc_id) GROUP BY doc_id, t, start
), sums AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM scored GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN sums USING (doc_id)
"""

#: CRC-32 of the decimal conv_id as in SHARDING; nodes are told apart by the text of their turns.
PREFIX_TRIE = """
WITH table_of AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS head, xor(list_reduce(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), table_of
), rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS d, role, text FROM (
    SELECT c.conv_id, 0 AS own, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.head AND place <= h
    UNION ALL SELECT c.conv_id, 1, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place > h)
), told AS (
  SELECT conv_id, d, length(text) AS chars, list(length(role) || ':' || role || text) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM rebuilt
), openings AS (
  SELECT conv_id, d, chars, path FROM told UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[] FROM convs
), sizes AS (
  SELECT conv_id, max(d) AS size FROM openings GROUP BY conv_id
), nodes AS (
  SELECT path, any_value(d) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = size) AS ends
  FROM openings JOIN sizes USING (conv_id) GROUP BY path
), kids AS (
  SELECT path[:len(path) - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)
), sums AS (
  SELECT a.path, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved FROM full_nodes a JOIN full_nodes b ON b.path[:a.depth] = a.path GROUP BY a.path
)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_nodes f JOIN sums USING (path) LEFT JOIN full_nodes p ON f.depth > 0 AND p.path = f.path[:f.depth - 1]
"""

SOURCE_DIVERGENCE = rf"""
WITH cut AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), sources_of AS (
  SELECT DISTINCT lang, source FROM cut
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM cut) GROUP BY lang, term HAVING count(*) >= {LEAST_DOCUMENTS}
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM cut) JOIN kept USING (lang, term) GROUP BY ALL
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), filled AS (
  SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM sources_of JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), weighed AS (
  SELECT lang, source, term, n, 1 + ({UNIT}::HUGEINT * (n + 2)) // ((sum(n) OVER (PARTITION BY lang, source))::HUGEINT + 2 * v) AS p FROM filled JOIN v USING (lang)
), whole AS (
  SELECT lang, term, 1 + ({UNIT}::HUGEINT * (n + 2)) // ((sum(n) OVER (PARTITION BY lang))::HUGEINT + 2 * v) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM filled GROUP BY lang, term) JOIN v USING (lang)
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM sources_of a JOIN sources_of b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM weighed x JOIN weighed y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM weighed JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
