"""DuckDB SQL that says what queries return, where SQL can."""

#: Words of lower-cased (A-Z) texts.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_DECONTAMINATION = f"""
WITH b AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS key, item_id
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
pos AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS key
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win))),
hit AS (SELECT doc_id, pos.size, i, item_id FROM pos JOIN win USING (size, key)),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id),
place AS (SELECT least(13, len(w)) AS size, j, array_to_string(w[j:j + least(13, len(w)) - 1], ' ') AS key, item_id::VARCHAR AS item
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM b WHERE len(w) > 0)),
run AS (SELECT doc_id, item, size, i, i - j AS diagonal, i - row_number() OVER (PARTITION BY doc_id, item, size, i - j ORDER BY i) AS island FROM pos JOIN place USING (size, key)),
long AS (SELECT doc_id, item, min(i) - 1 AS at_word, size + count(*) - 1 AS words FROM run GROUP BY doc_id, item, size, diagonal, island),
top AS (SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, at_word, item) = 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(words, 0)::BIGINT AS longest_words, at_word::BIGINT AS longest_at_word, top.item AS longest_item
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN top USING (doc_id)
"""
OP9_SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT *, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT doc_id, p FROM w JOIN m USING (s) WHERE first < doc_id),
i AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM g)),
span AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, k),
cut AS (SELECT doc_id, k, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS x, a AS y FROM span UNION ALL SELECT doc_id, 1000000000000, max(b), NULL FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN y IS NULL THEN substr(h, 2 * x + 1) ELSE substr(h, 2 * x + 1, 2 * (y - x)) END, '' ORDER BY k) AS h FROM cut JOIN d USING (doc_id) GROUP BY doc_id),
r AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
OP10_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
k AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS key, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT key, min(doc_id) AS rep, count(*) AS copies, min(n) AS n FROM k GROUP BY key),
t AS (SELECT rep, n, g FROM s JOIN c ON s.doc_id = c.rep),
p AS (SELECT x.rep AS a, y.rep AS b FROM t x JOIN t y ON x.g = y.g AND x.rep < y.rep GROUP BY x.rep, y.rep, x.n, y.n HAVING 9 * count(*) >= 4 * (x.n + y.n)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
top AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
l AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(rep, d.doc_id) AS copy_of, coalesce(links, 0)::BIGINT AS n_links, coalesce(copies, 1)::BIGINT AS n_copies
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (key) LEFT JOIN top ON top.a = rep LEFT JOIN l ON l.a = rep
"""
