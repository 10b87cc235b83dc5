"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = """
WITH turns AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn, role, text) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                    ORDER BY turn, role, text) AS text
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)
SELECT conv_id, CAST(0 AS BIGINT) AS part, len(turns) AS n_turns, text FROM turns a
WHERE NOT EXISTS (SELECT 1 FROM turns b WHERE len(b.turns) > len(a.turns) AND b.turns[1:len(a.turns)] = a.turns)
  AND NOT EXISTS (SELECT 1 FROM turns b WHERE b.conv_id < a.conv_id AND b.turns = a.turns)
"""

OP3 = r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hits AS (
  SELECT *,
    CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule,
    CASE WHEN contains('.' || host || path, '.free-bets.') THEN 'bets'
         WHEN contains('.' || host, '.ads-track.') THEN 'tracker'
         WHEN contains('.' || host, '.casino-') THEN 'casino'
         WHEN contains('.' || host, '.adult-') THEN 'adult'
         WHEN contains('.' || host, '.cheap-pills.') THEN 'pills'
         WHEN contains('.' || host, '.spam-farm.') THEN 'spam' END AS unwanted
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN unwanted IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN unwanted END AS pattern
FROM hits
"""

OP7 = rf"""
WITH split AS (
  SELECT doc_id, text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
wins AS (
  SELECT *, list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i + 7], ' ')) AS win FROM split),
reps AS (
  SELECT doc_id, row_id, count(DISTINCT pos) AS n FROM (
    SELECT doc_id, row_id, unnest(range(i, i + 8)) AS pos FROM (
      SELECT doc_id, row_id, i, count(*) OVER (PARTITION BY row_id, g) AS n FROM (
        SELECT doc_id, row_id, unnest(win) AS g, generate_subscripts(win, 1) AS i
        FROM (SELECT *, row_number() OVER () AS row_id FROM wins))) WHERE n > 1) GROUP BY ALL),
counts AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(length(regexp_replace(coalesce(text, ''), '\P{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, row_number() OVER () AS row_id FROM wins) s LEFT JOIN reps r USING (row_id)),
bits AS (
  SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_upper > 30 * word_chars THEN 32 ELSE 0 END AS BIGINT) AS fail_bits
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM bits
"""


OP13 = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY pos) AS turns FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, turns, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                               lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) % 6 AS h
  FROM own),
built AS (
  SELECT a.conv_id, list_concat(b.turns[1:a.h], a.turns[a.h + 1:]) AS path
  FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
steps AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM built),
nodes AS (
  SELECT path[1:depth] AS pre, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256
  FROM steps GROUP BY ALL),
children AS (SELECT pre[1:depth - 1] AS pre, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own_sums AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children,
    CASE WHEN depth > 0 THEN (n_convs - 1) * length(pre[depth].x) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN children c USING (pre, depth)),
subtrees AS (
  SELECT pre[1:d] AS pre, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM own_sums) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM own_sums n JOIN subtrees s USING (pre, depth)
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.pre = n.pre[1:n.depth - 1]
"""


def all_oracles() -> dict[str, str]:
    return {"op2_chat_formatting": OP2, "op3_url_filters": OP3, "op7_quality_rules": OP7, "op13_prefix_trie": OP13}
