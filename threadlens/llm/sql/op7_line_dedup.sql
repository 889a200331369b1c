WITH cut AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents
), line AS (
  SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM cut
), first AS (
  SELECT line, min((doc_id, line_no)) AS first FROM line WHERE line <> '' GROUP BY line
), long AS (
  SELECT line, first, string_split(line, ' ') AS w, len(string_split(line, ' ')) AS n FROM first WHERE len(string_split(line, ' ')) >= 5
), variant AS (
  SELECT line, first, n, gap, array_to_string(list_concat(w[1:gap - 1], w[gap + 1:]), ' ') AS v
  FROM (SELECT *, unnest(range(1, n + 1)) AS gap FROM long)
), near AS (
  SELECT line FROM (SELECT line, first, min(first) OVER (PARTITION BY n, gap, v) AS earliest FROM variant) WHERE earliest < first
  UNION
  SELECT a.line FROM variant a JOIN long b ON b.line = a.v WHERE b.first < a.first
  UNION
  SELECT b.line FROM variant a JOIN long b ON b.line = a.v WHERE a.first < b.first
), judged AS (
  SELECT l.*, l.line <> '' AND ((l.doc_id, l.line_no) > f.first OR n.line IS NOT NULL) AS gone
  FROM line l LEFT JOIN first f ON f.line = l.line LEFT JOIN near n ON n.line = l.line
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(j.text, '') END AS text,
  coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone) AS text, count(*) AS n_lines,
    count(*) FILTER (WHERE gone) AS n_dropped
  FROM judged GROUP BY doc_id) j USING (doc_id)
