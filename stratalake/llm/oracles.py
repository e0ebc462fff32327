"""DuckDB SQL with the rows of those registered queries that SQL can express."""

OP1 = r"""
WITH split AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT DISTINCT host, path, rule_host || rule_path AS rule, verdict, length(rule_host || rule_path) AS n
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT host, path, max_by(rule, n) AS rule, max_by(verdict, n) AS verdict FROM fits GROUP BY host, path)
SELECT page_id, split.host AS host, split.path AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN best ON split.host = best.host AND split.path = best.path
"""

OP4 = r"""
WITH narrow AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS source_key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
leveled AS (SELECT *, CASE WHEN size < 10 THEN 1 WHEN size < 100 THEN 2 WHEN size < 1000 THEN 3 ELSE 4 END AS level FROM narrow),
levels AS (SELECT source_key, source, level, sum(size)::BIGINT AS level_size FROM leveled GROUP BY ALL),
sources AS (
  SELECT source_key, source, sum(level_size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM levels GROUP BY source_key, source),
filled AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(3 * source_size) OVER before, 0) AS full_before, coalesce(sum(w) OVER before, 0) AS w_before
  FROM sources WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, 3 * source_size * (all_w - w_before) <= w * (total - full_before) AS is_full FROM filled),
rest AS (
  SELECT *, total - sum(CASE WHEN is_full THEN 3 * source_size ELSE 0 END) OVER () AS remaining, all_w - sum(CASE WHEN is_full THEN w ELSE 0 END) OVER () AS remaining_w
  FROM marked),
targets AS (
  SELECT source_key, source_size, CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE w::DOUBLE * remaining::DOUBLE / remaining_w::DOUBLE END AS target FROM rest),
l1 AS (
  SELECT levels.source_key, level, level_size, source_size, target, sum(level * level_size) OVER (PARTITION BY levels.source_key) AS all_w,
         coalesce(sum(3 * level_size) OVER before, 0) AS full_before, coalesce(sum(level * level_size) OVER before, 0) AS w_before
  FROM levels JOIN targets USING (source_key)
  WINDOW before AS (PARTITION BY levels.source_key ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l2 AS (SELECT *, all_w > w_before AND (3 * (all_w - w_before))::DOUBLE <= level::DOUBLE * (target - full_before::DOUBLE) AS is_full FROM l1),
l3 AS (
  SELECT *, sum(CASE WHEN is_full THEN 3 * level_size ELSE 0 END) OVER s AS full_size, all_w - sum(CASE WHEN is_full THEN level * level_size ELSE 0 END) OVER s AS remaining_w
  FROM l2 WINDOW s AS (PARTITION BY source_key)),
l4 AS (
  SELECT *, greatest(0e0, least(3e0, CASE WHEN is_full THEN 3e0 WHEN remaining_w > 0 THEN level::DOUBLE * (target - full_size::DOUBLE) / remaining_w::DOUBLE ELSE 0e0 END)) AS copies FROM l3),
plan AS (
  SELECT source_key, level, source_size, target, floor(copies) AS whole, copies - floor(copies) AS p,
         target - sum(floor(copies) * level_size) OVER (PARTITION BY source_key) AS rest FROM l4),
ranked AS (
  SELECT d.*, source_size, target, whole, p, rest, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds
  FROM leveled d JOIN plan USING (source_key, level)),
valued AS (SELECT *, odds / (1 + odds) AS v FROM ranked),
summed AS (
  SELECT *, sum(CASE WHEN p > 0 THEN size END) OVER (PARTITION BY source_key ORDER BY v NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY source_key, v) AS tied FROM valued)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN p > 0 AND 2 * upto - tied <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""

OP10 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
windows AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM tokens)),
often AS (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows),
repeated AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM often WHERE n > 1) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n, count(*) AS lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
measured AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS host, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(dup.lines, 0) AS n_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM tokens LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r)),
ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base, 100 * n_symbols > 100 * n_words OR 100 * n_dup_lines > 30 * n_lines AS sign FROM measured),
hosts AS (SELECT host, count(*)::DOUBLE AS n, sum((base OR sign)::INT)::DOUBLE AS bad FROM ruled GROUP BY host),
sums AS (SELECT count(*) AS k, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS squares, sum(bad * bad / n) AS ratios FROM hosts),
moments AS (
  SELECT greatest(1e-6, least(1 - 1e-6, bad / n)) AS m, CASE WHEN n - squares / n > 0 THEN (ratios - bad * bad / n - (k - 1) * greatest(1e-6, least(1 - 1e-6, bad / n)) * (1 - greatest(1e-6, least(1 - 1e-6, bad / n)))) / (n - squares / n) ELSE 0 END AS own
  FROM sums),
prior AS (SELECT m, greatest(2, least(1000, CASE WHEN own > 0 THEN m * (1 - m) / own - 1 ELSE 1000 END)) AS w FROM moments),
rates AS (SELECT host, (bad + m * w) / (n + w) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed,
       NOT (base OR rate > 0.5 OR (rate > 0.05 AND sign)) AS kept
FROM ruled JOIN rates USING (host)
"""

ORACLES = {"op1_url_filters": OP1, "op4_source_mixing": OP4, "op10_quality_rules": OP10}
