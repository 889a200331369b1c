WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least(e.vec_id, coalesce(r.least, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(r.least, e.vec_id)) AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n_links FROM link GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON r.a = e.vec_id
