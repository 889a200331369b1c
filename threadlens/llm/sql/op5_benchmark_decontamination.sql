WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)
), it AS (
  SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i WHERE len(w) >= 5)
), size AS (
  SELECT item_id, count(*) AS n_item FROM it GROUP BY item_id
), hit AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN it USING (s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shared, n_item, n_shared::DOUBLE / n_item AS containment
FROM hit JOIN size USING (item_id)
WHERE n_shared >= 0.8 * n_item
