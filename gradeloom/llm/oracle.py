"""The queries in DuckDB SQL, where SQL can express them."""

_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents
), starts AS (
  SELECT rid, i, md5(array_to_string(ws[i : i + 34], ' ')) AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs)
), repeated AS (
  SELECT rid, i FROM starts WHERE k IN (SELECT k FROM starts GROUP BY k HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM repeated
), kept AS (
  SELECT rid, string_agg(w, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM docs) ANTI JOIN gone USING (rid, p)
  GROUP BY rid
)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""

OP7 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM documents
), items AS (
  SELECT item_id, ws, least(10, len(ws)) AS n
  FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM benchmark) WHERE len(ws) > 0
), wanted AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS k
  FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM items)
), kinds AS (
  SELECT DISTINCT n, k FROM wanted
), hits AS (
  SELECT rid, i, n, k
  FROM (
    SELECT rid, i, n, array_to_string(ws[i : i + n - 1], ' ') AS k
    FROM (
      SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM kinds) lengths
    )
  ) JOIN kinds USING (n, k)
), covered AS (
  SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), named AS (
  SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits JOIN wanted USING (n, k) GROUP BY rid
)
SELECT
  doc_id,
  len(ws) AS n_words,
  coalesce(n_hit, 0) AS n_hit,
  coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""

OP11 = f"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws
  FROM documents
), marked AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT
    part,
    CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
      + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
      + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask,
    CASE WHEN good THEN 1 ELSE 0 END AS good,
    CASE WHEN toxic THEN 1 ELSE 0 END AS toxic
  FROM texts LEFT JOIN marked USING (doc_id)
), counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask
), filters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM filters a, filters b, filters c, filters d, filters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), steps_of_parts AS (
  SELECT
    part, filter_order, step, bit,
    sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, (SELECT filter_order, step, CAST(bit AS BIGINT) AS bit, CAST(before AS BIGINT) AS before FROM steps)
  GROUP BY part, filter_order, step, bit
)
SELECT
  part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM steps_of_parts
"""

ORACLE = {
    "op7_decontamination": OP7,
    "op10_substring_dedup": OP10,
    "op11_filter_audit": OP11,
}
