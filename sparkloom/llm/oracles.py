"""DuckDB SQL for the training-data queries that SQL can express, written from their contracts."""

from __future__ import annotations

_LM = r"""
WITH words AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM
       (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
 places AS (SELECT doc_id, i, w, lag(w) OVER d AS c, lag(w, 2) OVER d AS cc FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
 uni AS (SELECT w, count(*) AS n FROM words GROUP BY w), uni_own AS (SELECT doc_id, w, count(*) AS n FROM words GROUP BY ALL),
 bi AS (SELECT c, w, count(*) AS n FROM places WHERE c IS NOT NULL GROUP BY ALL), bi_own AS (SELECT doc_id, c, w, count(*) AS n FROM places WHERE c IS NOT NULL GROUP BY ALL),
 tri AS (SELECT cc, c, w, count(*) AS n FROM places WHERE cc IS NOT NULL GROUP BY ALL), tri_own AS (SELECT doc_id, cc, c, w, count(*) AS n FROM places WHERE cc IS NOT NULL GROUP BY ALL),
 size AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id), total AS (SELECT count(*) AS n FROM words),
 parts AS (SELECT p.doc_id, p.c, p.cc, u.n - uo.n AS w1, s.n AS own, t.n AS n, b.n - bo.n AS w2, uc.n - uco.n AS c1, g.n - go.n AS w3, bc.n - bco.n AS c2
   FROM places p CROSS JOIN total t JOIN size s USING (doc_id) JOIN uni u ON u.w = p.w JOIN uni_own uo ON uo.doc_id = p.doc_id AND uo.w = p.w
   LEFT JOIN bi b ON b.c = p.c AND b.w = p.w LEFT JOIN bi_own bo ON bo.doc_id = p.doc_id AND bo.c = p.c AND bo.w = p.w
   LEFT JOIN uni uc ON uc.w = p.c LEFT JOIN uni_own uco ON uco.doc_id = p.doc_id AND uco.w = p.c
   LEFT JOIN tri g ON g.cc = p.cc AND g.c = p.c AND g.w = p.w LEFT JOIN tri_own go ON go.doc_id = p.doc_id AND go.cc = p.cc AND go.c = p.c AND go.w = p.w
   LEFT JOIN bi bc ON bc.c = p.cc AND bc.w = p.c LEFT JOIN bi_own bco ON bco.doc_id = p.doc_id AND bco.c = p.cc AND bco.w = p.c),
 one AS (SELECT *, CASE WHEN w1 > 0 THEN w1::DOUBLE / (n - own) ELSE 1::DOUBLE / n END AS s1 FROM parts),
 two AS (SELECT *, CASE WHEN c IS NULL THEN s1 WHEN w2 > 0 AND c1 > 0 THEN w2::DOUBLE / c1 ELSE 0.4::DOUBLE * s1 END AS s2 FROM one),
 logs AS (SELECT doc_id, sum(ln(CASE WHEN cc IS NULL THEN s2 WHEN w3 > 0 AND c2 > 0 THEN w3::DOUBLE / c2 ELSE 0.4::DOUBLE * s2 END)) AS s FROM two GROUP BY doc_id)
SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_words, round(coalesce(logs.s, 0), 3) AS log_score, round(logs.s / size.n, 4) AS score
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN logs USING (doc_id)
"""

_QUALITY = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 listed AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
 grams AS (SELECT doc_id, ks.k, g.i, hash(array_to_string(w[g.i : g.i + ks.k - 1], ' ')) AS gram FROM listed, unnest([2, 3, 4, 5, 6, 8, 10]) AS ks(k), unnest(range(1, len(w) - ks.k + 2)) AS g(i)),
 twice AS (SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, gram) AS n FROM grams) WHERE n > 1),
 places AS (SELECT DISTINCT doc_id, k, i + o.j AS place FROM twice, unnest(range(0, k)) AS o(j)),
 covered AS (SELECT doc_id, k, count(*) AS n, sum(len(w[place])) AS chars, any_value(len(array_to_string(w, ''))) AS size FROM places JOIN listed USING (doc_id) GROUP BY doc_id, k),
 repeats AS (SELECT doc_id, coalesce(max(n) FILTER (k = 5), 0) AS n, bool_or(chars > size * CASE k WHEN 2 THEN 0.60::DOUBLE WHEN 3 THEN 0.40::DOUBLE WHEN 4 THEN 0.25::DOUBLE WHEN 6 THEN 0.20::DOUBLE WHEN 8 THEN 0.18::DOUBLE WHEN 10 THEN 0.16::DOUBLE END) AS repetitive FROM covered GROUP BY doc_id),
 lines AS (SELECT doc_id, l, len(array_to_string(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), '')) AS chars FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM texts)),
 dups AS (SELECT doc_id, sum(n - 1) AS n, sum((n - 1) * chars) AS chars FROM (SELECT doc_id, l, chars, count(*) AS n FROM lines WHERE chars > 0 GROUP BY ALL) GROUP BY doc_id),
 measured AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
   coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(dups.chars, 0) AS dup_chars, coalesce(repetitive, false) AS repetitive FROM listed LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id)),
 judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(word_chars, 1) AS size FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR dup_chars > 0.30::DOUBLE * size OR n_symbols > 0.10::DOUBLE * size OR repetitive) AS kept FROM judged
"""

_NEIGHBOURS = r"""
WITH vecs AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 pairs AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
   FROM vecs q JOIN vecs c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, "rank", vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS "rank" FROM pairs) WHERE "rank" <= 10
"""

_MIXTURE = r"""
WITH RECURSIVE sized AS (SELECT doc_id, source, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1)::BIGINT AS tokens FROM documents),
 totals AS (SELECT source, sum(tokens)::BIGINT AS total, count(*) AS n_docs FROM sized GROUP BY source),
 shape AS (SELECT max(total)::DOUBLE AS top, sum(total)::DOUBLE AS every, list(total::DOUBLE / (SELECT max(total) FROM totals)::DOUBLE) AS rel, count(*) AS n FROM totals),
 tempered AS (SELECT 0 AS i, 0::DOUBLE AS low, 8::DOUBLE AS high UNION ALL
   SELECT i + 1, CASE WHEN e >= 0.9::DOUBLE THEN mid ELSE low END, CASE WHEN e >= 0.9::DOUBLE THEN high ELSE mid END FROM
     (SELECT *, CASE WHEN n = 1 THEN 1 ELSE (ln(z) - list_sum(list_transform(rel, lambda t: pow(t, mid) * mid * ln(t))) / z) / ln(n) END AS e FROM
       (SELECT *, list_sum(list_transform(rel, lambda t: pow(t, mid))) AS z FROM (SELECT i, low, high, (low + high) / 2 AS mid, rel, n FROM tempered, shape WHERE i < 42)))),
 free AS (SELECT low AS x FROM tempered WHERE i = 42),
 held AS (SELECT 0 AS i, 1::DOUBLE AS good, x AS bad FROM free UNION ALL
   SELECT i + 1, CASE WHEN m <= 3 THEN mid ELSE good END, CASE WHEN m <= 3 THEN bad ELSE mid END FROM
     (SELECT *, list_sum(rel) * list_max(list_transform(rel, lambda t: pow(t, mid) / t)) / list_sum(list_transform(rel, lambda t: pow(t, mid))) AS m FROM
       (SELECT i, good, bad, (good + bad) / 2 AS mid, rel FROM held, shape WHERE i < 42))),
 chosen AS (SELECT round(CASE WHEN list_sum(rel) * list_max(list_transform(rel, lambda t: pow(t, x) / t)) / list_sum(list_transform(rel, lambda t: pow(t, x))) <= 3 THEN x ELSE (SELECT good FROM held WHERE i = 42) END, 6) AS x FROM free, shape),
 powers AS (SELECT source, total, n_docs, every, pow(total / top, x) AS power FROM totals, shape, chosen),
 shares AS (SELECT source, total, greatest(0, ceil(log2(n_docs::DOUBLE / 2048)))::INT AS bits, power / (SELECT sum(power) FROM powers) AS weight, every FROM powers),
 budgets AS (SELECT *, budget // total AS whole, budget % total AS rest FROM (SELECT *, round(weight * every)::BIGINT AS budget FROM shares)),
 dealt AS (SELECT doc_id, source, tokens, weight, whole, rest, ('0x' || substr(md5('7:' || doc_id), 1, 15))::BIGINT >> (60 - bits) AS block, ('0x' || substr(md5('7:' || whole || ':' || doc_id), 1, 15))::BIGINT AS place FROM sized JOIN budgets USING (source)),
 placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('7:' || whole || ':block:' || block), 1, 15))::BIGINT, block, place, doc_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "at" FROM dealt)
SELECT doc_id, source, tokens, round(weight, 9) AS weight, (whole + CASE WHEN "at" + tokens / 2 <= rest THEN 1 ELSE 0 END)::BIGINT AS copies, block, "at" FROM placed
"""

_SHARDS = r"""
WITH sized AS (SELECT doc_id, (strlen(coalesce(text, '')) + 64)::BIGINT AS bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
 levels AS (SELECT doc_id, bytes, d.depth::INT AS depth, h >> (60 - d.depth)::INT AS prefix FROM sized, range(0, 31) AS d(depth)),
 nodes AS (SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes FROM levels GROUP BY ALL),
 placed AS (SELECT doc_id, bytes, depth, prefix, shard_bytes, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS n FROM levels JOIN nodes USING (depth, prefix) WHERE shard_bytes <= 4194304)
SELECT doc_id, bytes, depth || ':' || prefix AS shard, shard_bytes FROM placed WHERE n = 1
"""

_NEAR = r"""
WITH listed AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 shingles AS (SELECT DISTINCT doc_id, hash(array_to_string(w[g.i : g.i + 4], ' ')) AS s FROM listed, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS g(i)),
 sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
 common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 links AS (SELECT x, y FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c.n >= 85 * (a.n + b.n - c.n)),
 ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
 reach AS (WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, ways.y FROM r JOIN ways ON ways.x = r.b) SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach USING (doc_id)
"""

ORACLES = {"op2_lm_score": _LM, "op5_ann": _NEIGHBOURS, "op6_mixing": _MIXTURE, "op7_near_dedup": _NEAR, "op8_sharding": _SHARDS, "op9_quality_rules": _QUALITY}
