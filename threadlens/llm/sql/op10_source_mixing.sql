WITH RECURSIVE n AS (
  SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS weight FROM documents GROUP BY source
), rate AS (
  SELECT source, weight / (SELECT sum(weight) FROM n) * (SELECT sum(n) FROM n)::DOUBLE / n AS rate FROM n
), part AS (
  SELECT source, ceil(rate / 16.0)::INT AS parts, rate / ceil(rate / 16.0) AS mean FROM rate WHERE rate > 0
), cdf AS (
  SELECT source, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
  FROM part, (SELECT unnest(range(0, 80)) AS k)
), tables AS (
  SELECT source, list(p ORDER BY k) AS p FROM cdf GROUP BY source
), draw AS (
  SELECT d.doc_id, d.source, d.text, t.p,
         (('0x' || md5('1:' || coalesce(d.doc_id::VARCHAR, '') || ':' || i::VARCHAR)[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM (SELECT *, unnest(range(1, parts + 1)) AS i FROM documents d JOIN part USING (source)) d JOIN tables t USING (source)
), counted AS (
  SELECT doc_id, source, text, sum(len(list_filter(p, lambda x: x < u)))::BIGINT AS n FROM draw GROUP BY doc_id, source, text
)
SELECT doc_id, source, text, unnest(range(1, n + 1))::INT AS copy FROM counted WHERE n > 0
