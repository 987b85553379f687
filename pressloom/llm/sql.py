"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

OP4 = """
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS key,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, '')) AS draw,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
src AS (
  SELECT key, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY key = 'n', key) AS pos FROM src),
weighed AS (
  SELECT *, [5, 2, 1][((pos - 1) % 3 + 1)::INT] AS w, 3 * source_size AS cap FROM ordered),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::BIGINT
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (
  SELECT level FROM levels WHERE cap / w >= level ORDER BY cap / w, pos LIMIT 1),
targets AS (
  SELECT key, pos, source_size, CASE WHEN cap / w < level THEN cap::DOUBLE ELSE w * level END AS target,
         1 + source_size // 1048576 AS n_shards
  FROM weighed, final),
seats_all AS (
  SELECT (sum(source_size) // 64)::BIGINT AS seats FROM targets),
quotients AS (
  SELECT key, pos, target / (2 * s + 1) AS quotient
  FROM targets, range(0, (SELECT seats FROM seats_all)) r(s)
  WHERE target > 0 AND s <= target / 64 + 2),
seats AS (
  SELECT key, count(*) AS seats FROM (
    SELECT key, row_number() OVER (ORDER BY quotient DESC, pos) AS place FROM quotients)
  WHERE place <= (SELECT seats FROM seats_all) GROUP BY key),
drawn AS (
  SELECT s.*, t.source_size, t.target, coalesce(e.seats, 0) AS seats,
         ('0x' || substr(draw, 1, 8))::BIGINT % t.n_shards AS shard
  FROM sized s JOIN targets t USING (key) LEFT JOIN seats e USING (key)),
shards AS (
  SELECT key, shard, sum(size)::BIGINT AS shard_size, any_value(seats) AS seats FROM drawn GROUP BY key, shard),
shard_quotients AS (
  SELECT key, shard, seats, shard_size / (2 * s + 1) AS quotient
  FROM shards, range(0, (SELECT max(seats) + 1 FROM shards)) r(s) WHERE shard_size > 0 AND s < seats),
quota AS (
  SELECT key, shard, count(*) AS quota FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY quotient DESC, shard) AS place FROM shard_quotients)
  WHERE place <= seats GROUP BY key, shard),
plan AS (
  SELECT key, shard, shard_size, ceil(shard_size / 64)::BIGINT AS blocks,
         least(coalesce(quota, 0) * 64, shard_size * 3) AS want,
         ('0x' || substr(md5('mix-1|' || key || '|' || shard), 1, 8))::BIGINT AS start
  FROM shards LEFT JOIN quota USING (key, shard)),
picks AS (
  SELECT key, shard, blocks,
         CASE WHEN shard_size > 0 THEN want // shard_size ELSE 0 END AS passes,
         CASE WHEN shard_size > 0 THEN floor(want % shard_size / 64 + 0.5)::BIGINT ELSE 0 END AS picks,
         CASE WHEN blocks > 0 THEN start % blocks ELSE 0 END AS off
  FROM plan),
laid AS (
  SELECT d.*, p.blocks, p.passes, p.picks, p.off,
         (sum(size) OVER (PARTITION BY key, shard ORDER BY draw, doc_id, size
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS hi
  FROM drawn d JOIN picks p USING (key, shard)),
marks AS (
  SELECT *, hi - size AS lo FROM laid)
SELECT doc_id, size, source_size, target,
  (passes * size + CASE WHEN blocks > 0 THEN
     ((hi // 64 + off) * picks // blocks - off * picks // blocks) * 64
     + CASE WHEN (hi // 64 + 1 + off) * picks // blocks > (hi // 64 + off) * picks // blocks THEN hi % 64 ELSE 0 END
     - ((lo // 64 + off) * picks // blocks - off * picks // blocks) * 64
     - CASE WHEN (lo // 64 + 1 + off) * picks // blocks > (lo // 64 + off) * picks // blocks THEN lo % 64 ELSE 0 END
   ELSE 0 END)::BIGINT AS taken
FROM marks
"""

OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND len(a.q) = len(b.q)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP7 = """
WITH chats AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(text, '([<\\[])(\\\\*)(/?s>|/?INST\\]|</?SYS>>)', '\\1\\\\\\2\\3', 'g') AS written FROM chats)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(written) + 9)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP10 = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n) AS nu, any_value(b.n) AS nv
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
edges AS (
  SELECT u, v FROM common WHERE 100 * c >= 80 * (nu + nv - c)),
both_ways AS (
  SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM sets
  UNION SELECT b.v, r.root FROM reach r JOIN both_ways b ON b.u = r.node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.root) AS component_id, s.doc_id = min(r.root) AS kept
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.s
"""



def _op11(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds written out, one after the other, over all rows."""
    near = """
      SELECT code, c AS cluster, d AS distance, w FROM (
        SELECT code, c, w, d, row_number() OVER (PARTITION BY code ORDER BY d, c) AS place FROM (
          SELECT x.code, x.w, y.c, list_sum(list_transform(list_zip(x.code, y.at), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
          FROM weighed x CROSS JOIN c{i} y)) WHERE place = 1"""
    steps = [f"""
    WITH kept AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS code FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    weighed AS (SELECT code, count(*) AS w FROM kept GROUP BY code),
    c0 AS (
      SELECT (row_number() OVER (ORDER BY h, code) - 1)::INT AS c, code AS at
      FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, code FROM kept WHERE vec_id IS NOT NULL ORDER BY h, code LIMIT {k}))"""]
    for i in range(rounds):
        steps.append(f"""
    n{i} AS ({near.format(i=i)}),
    s{i} AS (SELECT cluster, pos, floor(sum(x * w)::DOUBLE / sum(w))::BIGINT AS x
             FROM (SELECT cluster, w, unnest(code) AS x, unnest(range(64)) AS pos FROM n{i}) GROUP BY cluster, pos),
    c{i + 1} AS (SELECT c.c, coalesce(m.at, c.at) AS at FROM c{i} c LEFT JOIN (SELECT cluster, list(x ORDER BY pos) AS at FROM s{i} GROUP BY cluster) m ON m.cluster = c.c)""")
    steps.append(f"""
    last AS ({near.format(i=rounds)}),
    sums AS (SELECT cluster, sum(distance * w)::BIGINT AS cluster_inertia FROM last GROUP BY cluster)""")
    return ",".join(steps) + f"""
    SELECT k.vec_id, l.cluster, l.distance, s.cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM sums) AS inertia,
      sha256(array_to_string(list_transform(c.at, lambda v: v::VARCHAR), ',')) AS centroid_sha256
    FROM kept k JOIN last l USING (code) JOIN sums s USING (cluster) JOIN c{rounds} c ON c.c = l.cluster"""


OP12 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x,
    coalesce(vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
  FROM embeddings),
links AS (
  SELECT a.r AS u, b.r AS v, b.vec_id AS other
  FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.r <> b.r AND a.ok AND b.ok
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.93),
reach AS (
  SELECT r AS node, vec_id AS root FROM v
  UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, t.root AS component_id, coalesce(v.vec_id = t.root, true) AS kept
FROM v JOIN roots t ON t.node = v.r LEFT JOIN counts c ON c.u = v.r
"""

OP13 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
sizes AS (SELECT unnest(range(1, 6)) AS k),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, sizes WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT * FROM f WHERE k >= 2),
left_over AS (
  SELECT c.* FROM cand c WHERE NOT EXISTS (
    SELECT 1 FROM cand x WHERE x.lang = c.lang AND x.k > c.k AND 100 * x.a >= 100 * c.a AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, array_to_string(string_split(c.phrase, ' ')[1:j], ' ') AS head, array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ') AS tail
  FROM left_over c, (SELECT unnest(range(1, 5)) AS j) WHERE j < c.k),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.a AS l, y.a AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

ORACLES = {
    "op11_centroids": _op11(),
    "op12_near_vectors": OP12,
    "op13_collocations": OP13,
    "op10_near_duplicates": OP10,
    "op7_chat_format": OP7,
    "op8_exact_top_k": OP8,
    "op4_mix_sources": OP4,
}
