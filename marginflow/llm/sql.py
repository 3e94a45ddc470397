"""DuckDB SQL that gives the rows of the registered queries, written apart from them."""

QUALITY_RULES = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs)
),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS times
  FROM (
    SELECT doc_id, i, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p || ' '
                        || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS win
    FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)
  ) WHERE win IS NOT NULL
),
repeats AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words
  FROM windows, range(5) AS r(j) WHERE times > 1 GROUP BY doc_id
),
lines AS (
  SELECT doc_id, line, k, n,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again,
         100 * len(list_filter(ws, lambda x: regexp_full_match(x, '[|»«›‹>•·–—/\\-]+'))) > 15 * n
         OR regexp_matches(line, '(?i)(all rights reserved|copyright (?:©|\(c\)|\d{4})|licensed under|released under the|this work is licensed|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|accept (?:all )?cookies|enable javascript|sign up for|subscribe to|log in to|click here|skip to (?:main )?content|lorem ipsum)')
         OR 100 * len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>]'))) > 30 * n
         OR 100 * len(list_filter(range(2, n + 1), lambda i: ws[i] = ws[i - 1])) > 30 * n
         OR (n >= 3 AND NOT regexp_matches(line, '[.!?:;,…。！？]'))
         OR (n >= 5 AND NOT regexp_matches(line, '\p{Ll}') AND regexp_matches(line, '\p{Lu}')) AS bad
  FROM (
    SELECT doc_id, line, k, ws, len(ws) AS n
    FROM (
      SELECT doc_id, line, k, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws
      FROM (
        SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k
        FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM docs)
      )
    ) WHERE len(ws) > 0
  )
),
by_line AS (
  SELECT doc_id, count(*) FILTER (WHERE again) AS n_dup_lines,
         count(*) FILTER (WHERE bad OR again) AS n_removed_lines,
         coalesce(sum(n) FILTER (WHERE bad OR again), 0) AS n_removed_words
  FROM lines GROUP BY doc_id
),
figures AS (
  SELECT doc_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_removed_lines, 0) AS n_removed_lines,
         coalesce(n_removed_words, 0) AS n_removed_words
  FROM docs LEFT JOIN by_line USING (doc_id) LEFT JOIN repeats USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words
         AND 100 * n_removed_words <= 50 * n_words AS kept,
       CAST(n_removed_lines AS BIGINT) AS n_removed_lines,
       CAST(n_removed_words AS BIGINT) AS n_removed_words
FROM figures
"""

SOURCE_MIX = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce('0' || source, '1') AS src,
         md5('1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
),
sizes AS (SELECT src, CAST(sum(size) AS BIGINT) AS s FROM docs GROUP BY src),
weighted AS (SELECT src, s, (row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS w FROM sizes),
filled AS (
  SELECT *, row_number() OVER p AS nth,
         (SELECT sum(s) FROM sizes)
           - coalesce(sum(3 * s) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
  FROM weighted WINDOW p AS (ORDER BY CAST(s AS DOUBLE) / w, src)
),
level AS (
  SELECT CAST(rest AS DOUBLE) / CAST(heavy AS DOUBLE) AS l FROM filled
  WHERE rest * w <= 3 * s * heavy ORDER BY nth LIMIT 1
),
targets AS (SELECT src, s, least(l * w, CAST(3 * s AS DOUBLE)) AS target FROM filled, level),
parts AS (
  SELECT *, CASE WHEN s = 0 THEN 0 ELSE CAST(floor(target / s) AS BIGINT) END AS epochs,
         target - (CASE WHEN s = 0 THEN 0 ELSE floor(target / s) END) * s AS r
  FROM targets
),
run AS (
  SELECT d.src, d.k, d.size, p.r,
         sum(d.size) OVER (PARTITION BY d.src ORDER BY k[1:9]) AS upto
  FROM docs d JOIN parts p USING (src)
),
drawn AS (SELECT src, k FROM run WHERE upto <= r),
rest0 AS (
  SELECT src, max(r) - coalesce(sum(size) FILTER (WHERE upto <= r), 0) AS r FROM run GROUP BY src
),
free AS (SELECT src, k, size FROM run WHERE upto > r AND size > 0),
top1 AS (
  SELECT f.src, max(struct_pack(size, k)) AS b FROM free f JOIN rest0 USING (src)
  WHERE size <= r GROUP BY f.src
),
rest1 AS (SELECT src, r - coalesce(b.size, 0) AS r FROM rest0 LEFT JOIN top1 USING (src)),
top2 AS (
  SELECT f.src, max(struct_pack(size, k)) AS b FROM free f JOIN rest1 USING (src)
  WHERE size <= r AND k NOT IN (SELECT b.k FROM top1) GROUP BY f.src
),
rest2 AS (SELECT src, r - coalesce(b.size, 0) AS r FROM rest1 LEFT JOIN top2 USING (src)),
top3 AS (
  SELECT f.src, max(struct_pack(size, k)) AS b FROM free f JOIN rest2 USING (src)
  WHERE size <= r AND k NOT IN (SELECT b.k FROM top1) AND k NOT IN (SELECT b.k FROM top2)
  GROUP BY f.src
),
rest3 AS (SELECT src, r - coalesce(b.size, 0) AS r FROM rest2 LEFT JOIN top3 USING (src)),
tops AS (
  SELECT src, b.k AS k FROM top1 UNION ALL SELECT src, b.k FROM top2
  UNION ALL SELECT src, b.k FROM top3
),
ends AS (
  SELECT run.src, min(k[1:9]) AS pos FROM run JOIN parts p ON p.src = run.src AND p.r > 0
  WHERE upto > run.r GROUP BY run.src
),
later AS (
  SELECT f.src, f.k, f.size FROM free f JOIN ends USING (src)
  WHERE f.k[1:9] > pos AND f.k NOT IN (SELECT k FROM tops)
),
steps AS (
  SELECT src, 0 AS step, '' AS after, pos, CAST(0 AS DOUBLE) AS most, r AS rest
  FROM rest3 JOIN ends USING (src)
  UNION ALL
  SELECT src, step + 1, pos, coalesce(min(k) FILTER (WHERE through > rest), 'g'), rest,
         rest - coalesce(sum(size) FILTER (WHERE through <= rest), 0)
  FROM (
    SELECT s.src, s.step, s.pos, s.rest, l.k[1:9] AS k, l.size,
           sum(l.size) OVER (PARTITION BY s.src ORDER BY l.k[1:9]) AS through
    FROM steps s JOIN later l ON l.src = s.src AND l.k[1:9] > s.pos AND l.size <= s.rest
  ) GROUP BY src, step, pos, rest
),
went AS (
  SELECT l.src, l.k FROM later l JOIN steps s
  ON l.src = s.src AND s.step > 0 AND l.k[1:9] > s.after AND l.k[1:9] < s.pos AND l.size <= s.most
),
part AS (SELECT src, k FROM drawn UNION ALL SELECT src, k FROM went),
last AS (
  SELECT p.src, p.epochs,
         CASE WHEN s.pos IS NULL THEN -1 WHEN s.pos = 'g' THEN 255
              ELSE CAST('0x' || s.pos[1:2] AS INTEGER) END AS last
  FROM parts p LEFT JOIN (SELECT src, arg_max(pos, step) AS pos FROM steps GROUP BY src) s USING (src)
),
blocks AS (
  SELECT src, epoch, unnest(range(0, top + 1)) AS block
  FROM (
    SELECT src, epoch, CASE WHEN epoch < epochs THEN 255 ELSE last END AS top
    FROM last, range(0, 4) e(epoch) WHERE epoch <= epochs
  ) WHERE top >= 0
),
level0 AS (SELECT src, 0 AS lo, 8 AS hi, count(*) AS q FROM blocks GROUP BY src),
LEVELS
quotas AS (
  SELECT src, lo AS shard, sum(q) OVER p - q AS low, sum(q) OVER p AS high
  FROM level3 WINDOW p AS (PARTITION BY src ORDER BY lo)
),
dealt AS (
  SELECT b.src, b.epoch, b.block, q.shard
  FROM (
    SELECT src, epoch, block, row_number() OVER (
      PARTITION BY src ORDER BY md5('1|' || src || '|' || epoch || '|' || block), epoch, block
    ) - 1 AS place FROM blocks
  ) b JOIN quotas q ON q.src = b.src AND place >= low AND place < high
),
taken AS (
  SELECT d.doc_id, d.src, d.size, d.k,
         epochs + CASE WHEN d.k IN (SELECT k FROM part) THEN 1 ELSE 0 END AS times,
         CASE WHEN d.k IN (SELECT k FROM tops) THEN 1 ELSE 0 END AS extra
  FROM docs d JOIN parts USING (src)
),
placed AS (
  SELECT t.doc_id, t.k, x.epoch AS nth, x.shard FROM taken t
  JOIN dealt x ON x.src = t.src AND x.block = CAST('0x' || t.k[1:2] AS INTEGER) AND x.epoch < t.times
  UNION ALL
  SELECT t.doc_id, t.k, 9, x.shard FROM taken t JOIN last l ON l.src = t.src AND t.extra = 1
  JOIN dealt x ON x.src = t.src AND x.block = l.last AND x.epoch = l.epochs
),
listed AS (
  SELECT doc_id, k, string_agg(CAST(shard AS VARCHAR), ',' ORDER BY nth) AS shards
  FROM placed GROUP BY doc_id, k
)
SELECT t.doc_id, t.size, s AS source_size, target, CAST(t.size * (times + extra) AS BIGINT) AS taken,
       coalesce(shards, '') AS shards
FROM taken t JOIN parts USING (src) LEFT JOIN listed USING (doc_id, k)
"""


def _level(n: int) -> str:
    """One level of the tree of draws: the blocks of each node by their digests, left ones first."""
    return f"""level{n} AS (
  SELECT src, CASE WHEN nth <= share THEN lo ELSE mid END AS lo,
         CASE WHEN nth <= share THEN mid ELSE hi END AS hi, count(*) AS q
  FROM (
    SELECT src, lo, hi, (lo + hi) // 2 AS mid,
           row_number() OVER (
             PARTITION BY lo, hi ORDER BY md5('1|' || lo || '|' || hi || '|' || src || '|' || i), src, i
           ) AS nth,
           floor(count(*) OVER (PARTITION BY lo, hi) * ((lo + hi) // 2 - lo) / (hi - lo)) AS share
    FROM (SELECT src, lo, hi, unnest(range(1, q + 1)) AS i FROM level{n - 1})
  ) GROUP BY ALL
),"""


SOURCE_MIX = SOURCE_MIX.replace("LEVELS", "\n".join(_level(n) for n in (1, 2, 3)))

URL_FILTERS = r"""
WITH captures AS (
  SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
         nullif(regexp_replace(lower(regexp_extract(url,
           '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host,
         lower(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''),
           '[?#][\s\S]*$', ''), '/+$', '')) AS u
  FROM pages
),
hosts AS (
  SELECT DISTINCT host, md5(host) AS h, string_split(host, '.') AS labels FROM captures
  WHERE host IS NOT NULL
),
listed AS (
  SELECT h, CAST('0x' || h[3:4] AS INTEGER) AS n,
         CASE WHEN h[2:2] < '8' OR len(labels) < 4 THEN 'host' ELSE 'domain' END AS kind,
         CASE WHEN h[2:2] < '8' OR len(labels) < 4 THEN host
              ELSE array_to_string(labels[2:], '.') END AS pattern,
         CASE WHEN h[7:7] < '8' THEN 'spam' ELSE 'adult' END AS category
  FROM hosts WHERE regexp_matches(host, 'casino|bets|pills') OR h[1:1] < '4'
),
entries AS (
  SELECT kind, pattern, true AS listing, n AS d, category FROM listed
  UNION SELECT kind, pattern, false, n + 45, category FROM listed WHERE h[5:5] < 'c'
  UNION SELECT kind, pattern, true, n + 90, category FROM listed WHERE h[6:6] < '8'
  UNION SELECT 'url', u, true, CAST('0x' || md5(u)[3:4] AS INTEGER), 'single' FROM captures
        WHERE md5(u)[1:1] = '0' AND md5(u)[2:2] < '4'
),
one AS (
  SELECT kind, pattern, CAST(DATE '2024-01-01' + d AS DATE) AS since,
         arg_max(listing, (listing, category)) AS listing,
         arg_max(category, (listing, category)) AS category
  FROM entries GROUP BY ALL
),
intervals AS (
  SELECT *, lead(since, 1, DATE '9999-12-31') OVER (PARTITION BY kind, pattern ORDER BY since) AS until
  FROM one
),
hits AS (
  SELECT page_id, kind, pattern, category, since,
         row_number() OVER (
           PARTITION BY page_id
           ORDER BY CASE kind WHEN 'url' THEN 0 WHEN 'host' THEN 1 ELSE 2 END, length(pattern) DESC
         ) AS nth
  FROM captures JOIN intervals
    ON listing AND since <= fetched AND fetched < until
   AND (kind = 'url' AND pattern = u OR kind = 'host' AND pattern = host
        OR kind = 'domain' AND (pattern = host OR ends_with(host, '.' || pattern))
           AND contains(pattern, '.'))
)
SELECT page_id, fetched, host, kind IS NOT NULL AS blocked, kind, pattern, category, since
FROM captures LEFT JOIN (SELECT * FROM hits WHERE nth = 1) h USING (page_id)
"""

FILL_MIDDLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
),
draws AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a,
         CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS d
  FROM docs
),
cuts AS (
  SELECT doc_id, t, n, least(a, b) AS i, greatest(a, b) AS j,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM draws
),
outputs AS (
  SELECT doc_id, n, i, j, form,
         CASE form WHEN 'plain' THEN t
              WHEN 'psm' THEN '<P>' || substr(t, 1, i) || '<S>' || substr(t, j + 1) || '<M>'
                              || substr(t, i + 1, j - i)
              ELSE '<S>' || substr(t, j + 1) || '<P>' || substr(t, 1, i) || '<M>'
                   || substr(t, i + 1, j - i) END AS o
  FROM cuts
),
marks AS (
  SELECT *, strpos(o, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS s, strpos(o, '<M>') AS m
  FROM outputs
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(i AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(j - i AS BIGINT) END AS middle_chars,
       sha256(o) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN o
              WHEN 'psm' THEN substr(o, 4, s - 4) || substr(o, m + 3) || substr(o, s + 3, m - s - 3)
              ELSE substr(o, s + 3, m - s - 3) || substr(o, m + 3) || substr(o, 4, s - 4) END)
         AS restored_sha256
FROM marks
"""
