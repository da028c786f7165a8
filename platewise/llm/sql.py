"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from .url_filter import PATTERN_RULES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {}

ORACLES["op2_mix_sources"] = f"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> 2) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS w,
             source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source IS NULL, source
                            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
t AS (SELECT source, source_size,
             coalesce(least(cap, w * max(rate) FILTER (rate * w <= cap) OVER ()), cap) AS target FROM r),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS passes FROM t),
b AS (SELECT *, target - passes * source_size AS budget FROM p),
c AS (SELECT source, h, sum(size) AS words,
             sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM sized GROUP BY source, h),
edge AS (SELECT c.source, min(h) AS h, arg_min(words, h) AS words, arg_min(upto, h) AS upto
         FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
         WHERE budget > 0 AND upto >= budget GROUP BY c.source),
cut AS (SELECT b.*, coalesce(CASE WHEN e.upto - budget <= budget - (e.upto - e.words) THEN e.h + 1 ELSE e.h END, 0) AS threshold
        FROM b LEFT JOIN edge e ON b.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * least(passes + CASE WHEN d.h < threshold THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM sized d JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""

ORACLES["op6_quality_rules"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 3)) AS i,
             unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' '))) AS five
      FROM d WHERE len(w) >= 5),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM g),
x AS (SELECT r, count(DISTINCT p)::BIGINT AS n
      FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM k WHERE n > 1) GROUP BY r),
l AS (SELECT d.r, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n FROM l
       WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
base AS (SELECT d.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                coalesce(dl.n, 0) AS n_dup_lines, coalesce(x.n, 0) AS n_repeat_words,
                len(string_split(text, chr(10))) AS n_lines
         FROM d LEFT JOIN x USING (r) LEFT JOIN dl USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT 10 * n_symbols > 3 * n_words
  AND word_chars >= 2 * n_words
  AND length(regexp_replace(array_to_string(w, ''),
        '[\\x{{0E00}}-\\x{{0EFF}}\\x{{1000}}-\\x{{109F}}\\x{{1780}}-\\x{{17FF}}\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) <= 25 * n_words
  AND NOT 2 * len(list_filter(w, lambda v: regexp_matches(v, '[A-Z]') AND NOT regexp_matches(v, '[a-z]'))) > n_words
  AND NOT (n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines)
  AND NOT 2 * len(list_filter(w, lambda v: regexp_matches(v, '[A-Za-z]|[^\\x00-\\x7F]'))) < n_words
  AND NOT 10 * len(list_filter(string_split(regexp_replace(text, '\\n+$', ''), chr(10)),
                               lambda v: v LIKE '%...' OR v LIKE '%…')) > 3 * len(string_split(regexp_replace(text, '\\n+$', ''), chr(10)))
  AS kept
FROM judged
"""

_BLOCKED = " OR ".join(f"regexp_matches(lower(url), '{r.pattern}')" for r in PATTERN_RULES)
ORACLES["op10_url_filters"] = f"""
WITH u AS (SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1)) AS host,
                  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT *, CASE
        WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
        WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
        WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
        WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN url IS NOT NULL AND ({_BLOCKED}) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

ORACLES["op9_substring_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
g AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i,
             unnest(list_transform(range(1, len(w) - 11), lambda j: array_to_string(w[j:j + 12], ' '))) AS k
      FROM d WHERE len(w) >= 13),
m AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM g)
      WHERE first < doc_id),
p AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM m),
x AS (SELECT r, list(p) AS ps, count(*)::BIGINT AS n FROM p GROUP BY r),
o AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT o.r, string_agg(word, ' ' ORDER BY o.p) AS t FROM o ANTI JOIN p ON o.r = p.r AND o.p = p.p GROUP BY o.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(x.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN x USING (r) LEFT JOIN kept USING (r)
"""

_NORMAL = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
           "'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')")
ORACLES["op12_benchmark_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_NORMAL} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_NORMAL} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS n,
             unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda j: array_to_string(w[j:j + 9], ' '))) AS k
      FROM b WHERE len(w) > 0),
p AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
m AS (SELECT p.r, p.i, p.n, g.item FROM p JOIN g ON p.n = g.n AND array_to_string(w[i:i + p.n - 1], ' ') = g.k),
h AS (SELECT r, count(DISTINCT q)::BIGINT AS n_hit
      FROM (SELECT r, unnest(range(i, i + n)) AS q FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
t AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

# crc32 from its polynomial; then a walk over the turns with the last role as state (0 none, 1 s, 2 u, 3 a)
ORACLES["op13_conversation_repair"] = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) AS x(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
how AS (SELECT k.*, xor(list_reduce(list_concat([4294967295::BIGINT],
                 list_transform(range(1, len(s) + 1), lambda j: ord(substr(s, j, 1))::BIGINT)),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS how FROM k, tab),
conv AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
dam AS (SELECT c, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role,
               CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE how WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM how JOIN conv ON how.conv_id IS NOT DISTINCT FROM conv.conv_id WHERE how <> 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS p FROM dam),
f AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
               WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY p) > 1 THEN 'duplicate'
               WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
             lag(left(role, 1)) OVER (PARTITION BY c ORDER BY p) AS before FROM ord),
sums AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
                count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal,
                count(*) AS n FROM f GROUP BY c),
edit AS (SELECT c, p, 'D' AS e, 4 AS cost, NULL AS r FROM f
         UNION ALL SELECT c, p, 'K', CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, i FROM f
                   WHERE fault NOT IN ('blank', 'duplicate') AND i IN ('s', 'u', 'a')
         UNION ALL SELECT c, p, 'R', CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, r
                   FROM f, (VALUES ('u'), ('a')) AS x(r) WHERE fault NOT IN ('blank', 'duplicate')),
walk AS (
  SELECT c, 0::BIGINT AS p, q, {'cost': cost, 'audit': audit} AS best
  FROM sums, (VALUES (0, 0, ''), (2, 3, 'I'), (3, 6, 'II')) AS x(q, cost, audit)
  UNION ALL
  SELECT c, p, q, min({'cost': cost, 'audit': audit}) FROM (
    SELECT c, p, CASE WHEN n = 0 THEN q WHEN (q = 2) = (n = 1) THEN 3 ELSE 2 END AS q,
           cost + 3 * n AS cost, audit || repeat('I', n) AS audit
    FROM (SELECT w.c, e.p, CASE e.r WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE w.q END AS q,
                 w.best.cost + e.cost AS cost, w.best.audit || e.e AS audit
          FROM walk w JOIN edit e ON w.c = e.c AND e.p = w.p + 1
          WHERE e.r IS NULL OR (e.r = 's' AND w.q = 0) OR (e.r = 'u' AND w.q <> 2) OR (e.r = 'a' AND w.q = 2)),
         (VALUES (0), (1), (2)) AS x(n)) GROUP BY c, p, q),
done AS (SELECT w.c, min(best) AS best FROM walk w JOIN sums s ON w.c = s.c AND w.p = s.n WHERE q IN (0, 3) GROUP BY w.c),
letter AS (SELECT c, l, e, count(*) FILTER (e <> 'I') OVER (PARTITION BY c ORDER BY l) AS p FROM (
  SELECT c, unnest(range(1, len(best.audit) + 1)) AS l, unnest(string_split(best.audit, '')) AS e
  FROM done WHERE best.audit <> '')),
kept AS (SELECT letter.*, f.role, f.text, f.i, row_number() OVER (PARTITION BY letter.c ORDER BY l) AS o
         FROM letter LEFT JOIN f ON letter.c = f.c AND letter.p = f.p AND letter.e <> 'I' WHERE e <> 'D'),
role AS (SELECT *, bool_or(e = 'K' AND i = 's') OVER (PARTITION BY c) AS system FROM kept),
line AS (SELECT c, string_agg(CASE e WHEN 'K' THEN role
                  ELSE CASE WHEN (o - system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END END
                || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY o) AS t FROM role GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(done.best.cost, 0)::BIGINT AS cost, coalesce(done.best.audit, '') AS audit,
       sha256(coalesce(t, '')) AS repaired_sha256
FROM conv LEFT JOIN sums USING (c) LEFT JOIN done USING (c) LEFT JOIN line USING (c)
"""
