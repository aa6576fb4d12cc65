"""DuckDB SQL of the operators that SQL can express on whole tables; tests hold the others against plain Python."""

from . import mixing
from .centroids import OP11_SQL
from .chat import OP6_SQL

WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 398)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
cut AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM hit),
s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM cut) GROUP BY doc_id, g),
p AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS x, a AS y, b FROM s),
piece AS (SELECT doc_id, x, y FROM p UNION ALL SELECT d.doc_id, coalesce(max(s.b), 1), any_value(length(h) // 2 + 1) FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x - 1, 2 * (y - x)), '' ORDER BY x) AS k FROM piece JOIN d USING (doc_id) WHERE y > x GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(from_hex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM s GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS m FROM w GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM w JOIN f USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, j, ws[j] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM d)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS k FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
m AS (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")})::BIGINT AS size, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
u AS (SELECT *, source_size * {float(mixing.MOST)}::DOUBLE AS cap, source_size * {float(mixing.MOST)}::DOUBLE / weight AS ratio FROM t),
v AS (SELECT *, ((SELECT sum(source_size) FROM t)::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM u WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
g AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(lam, ratio) FROM v WHERE lam <= ratio), 0) * weight) AS target FROM v),
b AS (SELECT *, (SELECT greatest(1.0, round(sum(target) / {mixing.SEATS})) FROM g) AS block, (SELECT sum(target) FROM g) AS total FROM g),
bid AS (SELECT source, target, block, total, unnest(range(0, least(floor(source_size * {mixing.MOST} / block), floor(target / block) + 2)::BIGINT)) AS s FROM b),
won AS (SELECT source, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * s + 1) DESC, source NULLS LAST, s) AS r FROM bid) WHERE r <= round(total / block) GROUP BY source),
q AS (SELECT b.*, least((coalesce(quota, 0) * block)::BIGINT, source_size * {mixing.MOST}) AS won FROM b LEFT JOIN won ON won.source IS NOT DISTINCT FROM b.source),
o AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % {mixing.RANGES} AS part FROM d),
z AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY part, h, size ROWS UNBOUNDED PRECEDING) - size AS start FROM o)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size > 0 THEN won // source_size ELSE 0 END * size + greatest(0, least(size, CASE WHEN source_size > 0 THEN won % source_size ELSE 0 END - start)))::BIGINT AS taken
FROM z JOIN q ON q.source IS NOT DISTINCT FROM z.source
"""

ORACLES = {"op2_suffix_dedup": OP2_SQL, "op5_fingerprint_dedup": OP5_SQL, "op6_chat": OP6_SQL, "op8_near_dedup": OP8_SQL, "op10_mixing": OP10_SQL, "op11_centroids": OP11_SQL}
