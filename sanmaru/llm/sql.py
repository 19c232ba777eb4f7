"""DuckDB SQL for the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op3_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

ORACLE["op5_top_k_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE["op6_url_filter"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
bad AS (SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY 1 HAVING bad IS NOT NULL),
c AS (
  SELECT host, count(*) AS n, sum(bad)::DOUBLE AS x, regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix
  FROM seen JOIN bad USING (page_id) WHERE host <> '' GROUP BY host),
s0 AS (SELECT suffix, sum(n) AS n, sum(x) AS x, (SELECT sum(x) / sum(n) FROM c) AS pm FROM c GROUP BY 1),
sm AS (SELECT sum(n) AS n, count(*) AS k, sum(n * n) AS nn, sum(n * pm) / sum(n) AS p, sum(n * (x / n - pm) ** 2) AS s FROM s0),
s1 AS (SELECT greatest(0.001, least(0.999, coalesce((s - p * (1 - p) * (k - 1)) / nullif(p * (1 - p) * (n - nn / n - (k - 1)), 0), 0.1))) AS g FROM sm),
s2 AS (SELECT suffix, (x + (1 - g) / g * pm) / (n + (1 - g) / g) AS pm FROM s0, s1),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(x) AS x, any_value(pm) AS pm FROM c JOIN s2 USING (suffix) GROUP BY 1, 2),
dm AS (SELECT sum(n) AS n, count(*) AS k, sum(n * n) AS nn, sum(n * pm) / sum(n) AS p, sum(n * (x / n - pm) ** 2) AS s FROM d0),
d1 AS (SELECT greatest(0.001, least(0.999, coalesce((s - p * (1 - p) * (k - 1)) / nullif(p * (1 - p) * (n - nn / n - (k - 1)), 0), 0.1))) AS g FROM dm),
d2 AS (SELECT domain, (x + (1 - g) / g * pm) / (n + (1 - g) / g) AS pm FROM d0, d1),
named AS (SELECT DISTINCT host, regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix FROM seen WHERE host <> ''),
h0 AS (
  SELECT host, coalesce(c.n, 0) AS n, coalesce(c.x, 0) AS x, coalesce(d2.pm, s2.pm, (SELECT sum(x) / sum(n) FROM c), 0) AS pm
  FROM named LEFT JOIN c USING (host) LEFT JOIN d2 ON d2.domain = named.domain LEFT JOIN s2 ON s2.suffix = named.suffix),
hm AS (SELECT sum(n) AS n, count(*) AS k, sum(n * n) AS nn, sum(n * pm) / sum(n) AS p, sum(n * (x / n - pm) ** 2) AS s FROM h0 WHERE n > 0),
h1 AS (SELECT greatest(0.001, least(0.999, coalesce((s - p * (1 - p) * (k - 1)) / nullif(p * (1 - p) * (n - nn / n - (k - 1)), 0), 0.1))) AS g FROM hm),
h2 AS (SELECT host, n + (1 - g) / g AS size, (x + (1 - g) / g * pm) / (n + (1 - g) / g) AS mean FROM h0, h1),
h3 AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) AS low FROM h2),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM seen LEFT JOIN h3 USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN low >= 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

ORACLE["op8_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
f AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM (SELECT * FROM x SEMI JOIN f USING (g)) a JOIN (SELECT * FROM x SEMI JOIN f USING (g)) b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id FROM n LEFT JOIN m USING (doc_id)
"""

#: Rows of ``embeddings`` whose vectors are finite, with whole-number components.
WHOLE = """
  SELECT row_number() OVER () AS rid, *, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"""


def _coding_round(n: int) -> str:
    """Assignment ``a{n}`` by the books ``b{n}``, and the books ``b{n + 1}`` that follow."""
    return f"""
a{n} AS (
  SELECT rid, part, any_value(y) AS y, min(struct_pack(d := list_dot_product(y, y) - 2 * list_dot_product(y, c) + list_dot_product(c, c), e := entry)) AS m
  FROM p JOIN b{n} USING (part) GROUP BY rid, part),
m{n} AS (SELECT part, m.e AS entry, pos, floor(sum(y[pos]) / count(*)) AS s FROM a{n}, (SELECT unnest(range(1, len(y) + 1)) AS pos FROM p LIMIT 4) GROUP BY ALL),
b{n + 1} AS (
  SELECT part, entry, coalesce(any_value(z), any_value(c)) AS c
  FROM b{n} LEFT JOIN (SELECT part, entry, list(s ORDER BY pos) AS z FROM m{n} GROUP BY ALL) USING (part, entry) GROUP BY ALL),"""


ORACLE["op11_vector_codes"] = f"""
WITH v AS ({WHOLE.format(scale=256)}),
p AS (SELECT rid, vec_id, part, x[part * 4 + 1:part * 4 + 4] AS y FROM v, (SELECT unnest(range(16)) AS part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, y AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
{_coding_round(0)}
{_coding_round(1)}
{_coding_round(2)}
h AS (SELECT sha256(string_agg(c[pos]::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b2, (SELECT unnest(range(1, 5)) AS pos)),
r AS (SELECT rid, string_agg(lower(printf('%02x', m.e)), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (rid), h
"""


def _cluster_round(n: int) -> str:
    """Assignment ``a{n}`` to the centroids ``c{n}``, and the centroids ``c{n + 1}`` that follow."""
    return f"""
a{n} AS (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x,
         min(struct_pack(d := list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), k := cluster)) AS m
  FROM v, c{n} GROUP BY rid),
m{n} AS (SELECT m.k AS cluster, pos, floor(sum(x[pos]) / count(*)) AS s FROM a{n}, (SELECT unnest(range(1, 65)) AS pos) GROUP BY ALL),
c{n + 1} AS (
  SELECT cluster, coalesce(any_value(z), any_value(c)) AS c
  FROM c{n} LEFT JOIN (SELECT cluster, list(s ORDER BY pos) AS z FROM m{n} GROUP BY ALL) USING (cluster) GROUP BY ALL),"""


ORACLE["op13_centroid_clusters"] = f"""
WITH v AS (SELECT * FROM ({WHOLE.format(scale=64)}) WHERE len(embedding) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS cluster, x AS c FROM v ORDER BY cluster LIMIT 16),
{_cluster_round(0)}
{_cluster_round(1)}
{_cluster_round(2)}
{_cluster_round(3)}
h AS (SELECT cluster, sha256(string_agg(c[pos]::BIGINT::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c3, (SELECT unnest(range(1, 65)) AS pos) GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, m.d::BIGINT AS distance, sum(m.d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(m.d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a3 JOIN h ON cluster = m.k
"""
