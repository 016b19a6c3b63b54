"""SQL for the corpus queries that SQL can express; the others are tested by brute force."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = f"""
WITH item AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_lower("coalesce(text, '')")}, {_WORD}) AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0) x
), doc AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_lower("coalesce(text, '')")}, {_WORD}) AS w FROM documents
), hit AS (
  SELECT d.r, d.i, k.n, k.item
  FROM (SELECT r, w, i, n FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc) q,
        (SELECT DISTINCT n FROM item_window) l WHERE i + n - 1 <= len(w)) d
  JOIN item_window k ON k.n = d.n AND k.win = array_to_string(d.w[d.i:d.i + d.n - 1], ' ')
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) x GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM hit GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_SPACED = r"'[^\x20\x09-\x0D]+'"

OP3 = rf"""
WITH doc AS (
  SELECT doc_id, source, row_number() OVER () AS r, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM doc) x
  WHERE regexp_matches(line, {_SPACED}) GROUP BY r
), three AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n
  FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) > 2) x) y
), rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM three WHERE n > 1) x GROUP BY r
), base AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
  FROM doc LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)
), host AS (
  SELECT source, count(*) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS bad FROM base GROUP BY source
), sums AS (
  SELECT sum(bad) / sum(n) AS m, sum(n * (bad / n) * (bad / n)) / sum(n) AS sq, count(*) / sum(n) AS share FROM host
), prior AS (
  SELECT m, least(greatest(m * (1 - m) / greatest(sq - m * m - m * (1 - m) * share, 1e-9) - 1, 1.0), 1e6) AS s FROM sums
), judged AS (
  SELECT source, (bad + m * s) / (n + s) <= 0.5 AS good FROM host, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, good AND NOT base_failed AS kept
FROM base JOIN judged ON base.source IS NOT DISTINCT FROM judged.source
"""

OP8 = f"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT r, doc_id, i, lines[i] AS line, {_lower(f"trim(lines[i], {_BLANK})")} AS key
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM doc) x
), frequent AS (
  SELECT key, max(doc_id) AS last FROM line WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5
), kept AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
  FROM (SELECT line.*, f.key IS NOT NULL AND f.last IS DISTINCT FROM doc_id AS gone
        FROM line LEFT JOIN frequent f ON line.key = f.key) x GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM doc JOIN kept USING (r)
"""

OP10 = r"""
WITH part AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), named AS (
  SELECT page_id, translate(raw, '""" + _UPPER + "', '" + _LOWER + r"""') AS host, path FROM part
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
    regexp_matches(host, '(^|\.)(ads-track\.example\.com|casino-win\.example\.net|cheap-pills\.example\.net|free-bets\.example\.net)$') AS listed
  FROM named
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


_OF_LIST = OP10[OP10.index("regexp_matches(host"):OP10.index(" AS listed")]
OP10_LISTED = OP10.replace(_OF_LIST, r"""EXISTS (
      SELECT 1 FROM (SELECT DISTINCT regexp_replace(host, '^(www|m|blog)\.', '') AS domain FROM named) d
      WHERE contains(split_part(domain, '.', 1), '-') AND (host = domain OR suffix(host, '.' || domain)))""")


# CRC-32 of a decimal number's characters: for each byte an xor, then eight shifts.
def _crc32(number: str) -> str:
    steps = (f"list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST({number} AS VARCHAR), ''), "
             "lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), "
             "lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END)")
    return f"xor({steps}, 4294967295)"


OP13 = f"""
WITH turn AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT c, {_crc32("c")} % 6 AS h, c - c % 100 AS base FROM (SELECT DISTINCT c FROM turn) q
), taken AS (
  SELECT conv.c, any_value(h) AS h, count(b.p) AS n
  FROM conv LEFT JOIN turn b ON b.c = base AND b.p < h GROUP BY conv.c
), whole AS (
  SELECT conv.c, b.p, digest, x FROM conv JOIN turn b ON b.c = base AND b.p < h
  UNION ALL SELECT c, n + p - h, digest, x FROM taken JOIN turn USING (c) WHERE p >= h
), listed AS (
  SELECT c, list(digest ORDER BY p) AS l, list(length(x) ORDER BY p) AS n FROM whole GROUP BY c
  UNION ALL SELECT c, [], [] FROM conv WHERE c NOT IN (SELECT c FROM whole)
), prefix AS (
  SELECT c, d, len(l) AS size, CASE WHEN d = 0 THEN '' ELSE md5(array_to_string(l[1:d], ',')) END AS node,
    CASE WHEN d = 1 THEN '' WHEN d > 1 THEN md5(array_to_string(l[1:d - 1], ',')) END AS parent,
    CASE WHEN d = 0 THEN 0 ELSE n[d] END AS chars
  FROM (SELECT c, l, n, unnest(range(0, len(l) + 1)) AS d FROM listed) q
), node AS (
  SELECT node, any_value(d) AS depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE d = size), '')) AS ends_sha256
  FROM prefix GROUP BY node
), kids AS (
  SELECT parent AS node, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY parent
), total AS (
  SELECT p.node, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM node v LEFT JOIN kids k ON k.node = v.node JOIN prefix p ON p.c = v.conv_id AND p.d <= v.depth GROUP BY p.node
)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM node v JOIN total t ON t.node = v.node LEFT JOIN kids k ON k.node = v.node LEFT JOIN node u ON u.node = v.parent
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": OP1, "op3_host_quality": OP3, "op8_line_dedup": OP8, "op10_url_cascade": OP10,
        "op10_url_cascade_listed": OP10_LISTED, "op13_prefix_trie": OP13,
    }
