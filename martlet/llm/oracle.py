"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

SIZED = r"SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents"

MIX = rf"""
WITH sized AS ({SIZED}),
per AS (SELECT source, SUM(size)::BIGINT AS source_size, COUNT(*) AS docs FROM sized GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, SUM(source_size) OVER () AS total FROM per),
shared AS (
  SELECT *, COALESCE(SUM(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         SUM(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed),
stops AS (SELECT *, (total - 3 * before) * weight > 3 * source_size * rest AS stopped FROM shared),
targets AS (
  SELECT source, source_size, docs,
         CASE WHEN stopped THEN (3 * source_size)::DOUBLE
              ELSE (total - 3 * SUM(CASE WHEN stopped THEN source_size ELSE 0 END) OVER ())::DOUBLE * weight
                   / SUM(CASE WHEN stopped THEN 0 ELSE weight END) OVER () END AS target
  FROM stops),
goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size) ELSE 0 END AS certain FROM targets),
parts AS (
  SELECT *, target - certain * source_size AS goal,
         CASE WHEN source_size > 0 THEN (target - certain * source_size) / source_size ELSE 0 END AS fraction FROM goals),
ranked AS (
  SELECT d.doc_id, d.size, p.*,
         (('0x' || substr(md5('mix:' || COALESCE(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u,
         CASE WHEN d.size > 0 THEN 1.0 + d.size / (d.size + p.source_size::DOUBLE / p.docs) ELSE 1.0 END::DOUBLE AS preference
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
ordered AS (
  SELECT *, COALESCE(SUM(size) OVER (PARTITION BY source ORDER BY CASE WHEN fraction > 0 THEN u / (1 - u) / (fraction / (1 - fraction) * preference) ELSE 0 END, doc_id NULLS FIRST
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM ranked),
counted AS (SELECT *, (certain + CASE WHEN fraction > 0 AND ahead + size / 2.0 <= goal THEN 1 ELSE 0 END)::BIGINT AS copies FROM ordered)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM counted
"""

URLS = r"""
WITH urls AS (
  SELECT page_id, translate(COALESCE(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         COALESCE(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hosts AS (
  SELECT DISTINCT host, list_has_any(regexp_split_to_array(host, '[.-]'), ['adult', 'ads', 'bet', 'bets', 'casino', 'gambling', 'loan', 'loans', 'pills', 'poker', 'porn', 'sex', 'spam', 'viagra', 'xxx']) AS listed FROM urls),
fitting AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM (SELECT DISTINCT host, path FROM urls) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, urls.host, urls.path, rule, COALESCE(v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM urls JOIN hosts USING (host) LEFT JOIN fitting USING (host, path)
"""

LINES = r"""
WITH raw AS (SELECT doc_id, t, unnest(range(len(ls))) AS pos, unnest(ls) AS line
             FROM (SELECT DISTINCT doc_id, text AS t, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
masked AS (SELECT doc_id, t, pos, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS body FROM raw),
lines AS (SELECT *, len(body) AS n, {'n': len(body), 'lead': body[1:3]} AS leaf FROM masked WHERE len(body) > 0),
bodies AS (SELECT leaf, body, any_value(n) AS n, COUNT(DISTINCT (doc_id, t)) AS docs FROM lines GROUP BY leaf, body),
wide AS (SELECT leaf, COUNT(*) AS bodies FROM bodies GROUP BY leaf HAVING COUNT(*) > 1 AND SUM(docs) >= 3),
cells AS (SELECT leaf, body, n, bodies, unnest(range(n)) AS pos, unnest(body) AS token FROM bodies JOIN wide USING (leaf)),
fixed AS (SELECT leaf, any_value(n) AS n, pos, token FROM cells GROUP BY leaf, pos, token HAVING COUNT(*) * 2 > any_value(bodies)),
enough AS (SELECT leaf, COUNT(*) AS constants FROM fixed GROUP BY leaf HAVING COUNT(*) >= any_value(n) * 0.7::DOUBLE),
joined AS (SELECT leaf, body FROM cells JOIN fixed USING (leaf, pos, token) JOIN enough USING (leaf) GROUP BY leaf, body HAVING COUNT(*) >= any_value(constants) * 0.8::DOUBLE),
placed AS (SELECT l.*, CASE WHEN j.leaf IS NULL THEN l.body END AS of FROM lines l LEFT JOIN joined j ON l.leaf = j.leaf AND l.body = j.body),
recurring AS (SELECT leaf, of, MIN(doc_id) AS first FROM placed GROUP BY leaf, of HAVING COUNT(DISTINCT (doc_id, t)) >= 3),
drops AS (SELECT doc_id, t, list(pos) AS d FROM placed p JOIN recurring r ON p.leaf = r.leaf AND p.of IS NOT DISTINCT FROM r.of AND p.doc_id <> r.first GROUP BY doc_id, t)
SELECT documents.doc_id, COALESCE(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, COALESCE(len(d), 0)::BIGINT AS n_dropped,
       CASE WHEN d IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(d, i - 1)), chr(10)) END AS text
FROM documents LEFT JOIN drops ON documents.doc_id = drops.doc_id AND documents.text = drops.t
"""

LEAKS = r"""
WITH items AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, LEAST(len(w), 5) AS n FROM items WHERE len(w) > 0),
listed AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s FROM sized),
counted AS (SELECT item_id, COUNT(*) AS q FROM listed GROUP BY item_id),
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
held AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
         FROM docs, (SELECT DISTINCT n FROM sized))
SELECT doc_id, item_id, q AS shingles, COUNT(*) AS found, COUNT(*) / q::DOUBLE AS containment
FROM held JOIN listed USING (s) JOIN counted USING (item_id) GROUP BY doc_id, item_id, q HAVING COUNT(*) >= CEIL(q * 0.8::DECIMAL(9, 6))
"""

PHRASES = r"""
WITH texts AS (SELECT COALESCE(lang, 'und') AS lang, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS phrase
  FROM listed, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(ws) >= n),
totals AS (SELECT lang, COUNT(*)::BIGINT AS n FROM grams WHERE n = 1 GROUP BY lang),
counted AS (SELECT lang, n, phrase, COUNT(*)::BIGINT AS f, string_split(phrase, ' ') AS ws FROM grams GROUP BY ALL HAVING COUNT(*) >= 30),
cuts AS (SELECT lang, n, phrase, f, ws, unnest(range(1, n)) AS k FROM counted WHERE n > 1),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, c.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.f) // (l.f + r.f))::BIGINT AS score
  FROM cuts c JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.k], ' ')
              JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1:], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, ws, n, f, unnest(range(2, n)) AS m FROM counted WHERE n > 2),
inner_ AS (SELECT lang, f, unnest(list_transform(range(1, n - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM spans),
outer_ AS (SELECT lang, phrase, MAX(f) AS f FROM inner_ GROUP BY ALL),
kept AS (
  SELECT w.* FROM weakest w LEFT JOIN outer_ o ON o.lang = w.lang AND o.phrase = w.phrase
  WHERE o.f IS NULL OR 100::HUGEINT * o.f < 80::HUGEINT * w.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, t.n, score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

SQL = {"op1_pareto_mix": MIX, "op6_url_cascade": URLS, "op8_line_templates": LINES, "op10_minhash_containment": LEAKS, "op12_misra_gries_phrases": PHRASES}
