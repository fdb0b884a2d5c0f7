"""SQL, for DuckDB, that states the results of the operators that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Least id reachable over the pairs of ``links(a, b)``, given both ways.
REACH = """reach(id, other) AS (
  SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (SELECT id, least(id, min(other)) AS component_id FROM reach GROUP BY id)"""

EMBEDDINGS = f"""WITH RECURSIVE raw AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
usable AS (SELECT * FROM raw WHERE len(list_filter(x, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(x, lambda v: v <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), {REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN least ON vec_id = least.id"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWERED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)), {REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON d.doc_id = least.id"""

BYTES = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49, 100)) AS base, h FROM h WHERE length(h) >= 100),
part AS (SELECT doc_id, base, substr(h, 2 * base + 1, 298) AS p FROM starts),
win AS (SELECT doc_id, base + i AS i, md5(substr(p, 2 * i - 1, 100)) AS g FROM (SELECT *, unnest(range(1, least(100, length(p) // 2 - 49) + 1)) AS i FROM part)),
least AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM win JOIN least USING (g) WHERE doc_id > first),
isle AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
span AS (SELECT doc_id, k, min(i) AS lo, max(i) + 49 AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM isle) GROUP BY 1, 2),
keep AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before, hi FROM span),
cut AS (SELECT h.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (lo - before - 1)), '' ORDER BY lo) AS front, max(hi) AS last, count(*) AS n_spans, sum(hi - lo + 1)::BIGINT AS n_removed FROM keep JOIN h USING (doc_id) GROUP BY 1)
SELECT h.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)"""

RUNS = f"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i:i + 12], ' ')))) AS g FROM w WHERE len(w) >= 13),
least AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN least USING (g) WHERE doc_id > first),
lists AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1),
rest AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (SELECT rest.doc_id, string_agg(word, ' ' ORDER BY rest.i) AS t FROM rest LEFT JOIN gone ON rest.doc_id = gone.doc_id AND rest.i = gone.i WHERE gone.i IS NULL GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN lists ON w.doc_id = lists.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id"""

#: One round of clustering: assignment of the vectors to centroids ``c{0}``.
ASSIGN = """d{0} AS (SELECT v.r, v.vec_id, v.x, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM v, c{0} c),
a{0} AS (SELECT * FROM d{0} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),"""
UPDATE = """s{0} AS (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range(1, 65)) AS i FROM a{0}) GROUP BY c, i),
c{1} AS (SELECT p.c, coalesce(x.x, p.x) AS x FROM c{0} p LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{0} GROUP BY c) x USING (c)),"""
ROUNDS = " ".join(ASSIGN.format(r) + " " + UPDATE.format(r, r + 1) for r in range(3)) + " " + ASSIGN.format(3)

CLUSTERS = f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT x, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT 16)), {ROUNDS}
per AS (SELECT c, sum(d) AS s FROM a3 GROUP BY c)
SELECT vec_id, a3.c::INT AS cluster, d AS distance, per.s::BIGINT AS cluster_inertia, (SELECT sum(s) FROM per)::BIGINT AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a3 JOIN per USING (c) JOIN c3 ON a3.c = c3.c"""

INNER = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""

AUDIT = f"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS.format('text')} AS w FROM documents),
f AS (SELECT part, coalesce(quality = 1, false)::INT AS good, coalesce(toxic = 1, false)::INT AS bad, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
  regexp_matches(t, '[#$%&*|]'), w.doc_id > min(w.doc_id) OVER (PARTITION BY t)] AS fails FROM w LEFT JOIN labels USING (doc_id)),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
m AS (SELECT *, list_transform(string_split(filter_order, ''), lambda x: fails[ascii(x) - 64]) AS seq FROM g, o),
k AS (SELECT *, coalesce(list_position(seq, true), 6) AS gone, len(list_filter(fails, lambda x: x)) AS many FROM m),
r AS (SELECT part, filter_order, step, sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN seq[step] AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN seq[step] AND many = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN gone = step THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM k, range(1, 6) s(step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM r"""

ORACLES = {
    "op1_embedding_dedup": EMBEDDINGS,
    "op2_suffix_array_dedup": BYTES,
    "op3_ngram_jaccard_join": JACCARD,
    "op7_substring_dedup": RUNS,
    "op11_exact_top_k": INNER,
    "op12_centroid_clustering": CLUSTERS,
    "op13_filter_interaction_audit": AUDIT,
}
