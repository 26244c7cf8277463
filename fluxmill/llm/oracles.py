"""DuckDB SQL for those of the queries that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce({_LOWER}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM shingles),
each AS (SELECT doc_id, n, hash(unnest(s)) AS h FROM shingles JOIN sizes USING (doc_id)),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.h = b.h AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS kept
FROM sizes s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n
"""

OP9 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS width, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS p
  FROM b WHERE len(w) > 0
), widths AS (SELECT DISTINCT width FROM windows),
places AS (
  SELECT doc_id, width, unnest(range(1, len(w) - width + 2)) AS pos, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i : i + width - 1], ' '))) AS p
  FROM w, widths WHERE len(w) >= width
), hits AS (SELECT doc_id, pos, width, item_id FROM places JOIN windows USING (width, p)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(pos, pos + width)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list_distinct(list(item_id::VARCHAR))) AS items FROM hits GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(len(i.items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(i.items, ','), '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings
), ok AS (SELECT vec_id, list_transform(e, lambda x: x / n) AS u FROM v WHERE n > 0 AND isfinite(n)),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_inner_product(a.u, b.u) >= 0.9),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
n AS (SELECT a, count(*) AS n FROM edges GROUP BY a), m AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m.m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(m.m, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN m ON m.a = v.vec_id
"""

OP5 = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(0, len(l)))::BIGINT AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), full_ AS (SELECT *, regexp_full_match(line, '\s*') AS blank, length(line) AS n FROM lines),
firsts AS (SELECT line, n, min((doc_id, line_no)) AS f FROM full_ WHERE NOT blank GROUP BY line, n),
halves AS (
  SELECT line, n, f, s, k, CASE WHEN s = 0 THEN left(line, k) ELSE right(line, k) END AS h
  FROM (SELECT *, unnest([n // 2, (n - 1) // 2]) AS k FROM firsts WHERE n >= 16), (VALUES (0), (1)) t(s)
), pairs AS (
  SELECT DISTINCT a.line AS x, b.line AS y, a.f AS fx, b.f AS fy FROM halves a JOIN halves b
  ON a.s = b.s AND a.k = b.k AND a.h = b.h AND b.n BETWEEN a.n - 1 AND a.n + 1 AND b.f < a.f
), near AS (
  SELECT DISTINCT x AS line FROM pairs WHERE
    (length(x) = length(y) AND len(list_filter(range(0, length(x)), lambda i: left(x, i) = left(y, i) AND substr(x, i + 2) = substr(y, i + 2))) > 0)
    OR (length(x) = length(y) + 1 AND len(list_filter(range(0, length(x)), lambda i: left(x, i) || substr(x, i + 2) = y)) > 0)
    OR (length(y) = length(x) + 1 AND len(list_filter(range(0, length(y)), lambda i: left(y, i) || substr(y, i + 2) = x)) > 0)
)
SELECT a.doc_id, a.line_no, a.blank OR (near.line IS NULL AND f.f = (a.doc_id, a.line_no)) AS kept, f.f[1] AS first_doc, f.f[2] AS first_line
FROM full_ a LEFT JOIN firsts f ON NOT a.blank AND f.line = a.line LEFT JOIN near ON NOT a.blank AND near.line = a.line
"""

LISTED = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, p.path, r.h || r.p AS rule, coalesce(r.v, 'allow') AS verdict
FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC NULLS LAST, r.h || r.p DESC) = 1
"""
_TERMS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS w FROM documents),
q AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS}) AS w FROM benchmark),
size AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
t AS (SELECT item, unnest(w) AS term FROM q),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, size GROUP BY term, n),
damping AS (SELECT k, doc_id, 20 * (50 + (50 * len(w)::BIGINT * n) // l) AS m FROM d, size WHERE len(w) > 0),
scores AS (
  SELECT item, k, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + m)))::BIGINT AS score
  FROM t JOIN p USING (term) JOIN weights USING (term) JOIN damping USING (k) GROUP BY item, k
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked JOIN q USING (item) WHERE rank <= 50
"""

#: The dynamic program with whole strings: each state keeps its cheapest edits, audit and repaired text. crc32 is by bits.
OP12 = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS key FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: ord(key[i])::BIGINT),
    lambda crc, b: list_reduce(range(0, 8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS code FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE code <> 0
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
marked AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, E' \t\n\x0b\x0c\r') AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM placed
), rows_ AS (
  SELECT *, CASE WHEN bare = '' THEN 3 WHEN again THEN 2 WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault FROM marked
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 3)::BIGINT AS blank,
    count(*) FILTER (fault = 2)::BIGINT AS duplicate, count(*) FILTER (fault = 1)::BIGINT AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM rows_) GROUP BY conv_id
), runs(f, run, mid, rc, made) AS (VALUES (0, '', 0, 0, ''), (1, '', 1, 0, ''), (2, '', 2, 0, ''), (3, '', 3, 0, ''), (0, 'I', 2, 5, E'user:\n'), (1, 'I', 2, 5, E'user:\n'), (2, 'I', 3, 5, E'assistant:\n'), (3, 'I', 2, 5, E'user:\n'),
  (0, 'II', 3, 10, E'user:\nassistant:\n'), (1, 'II', 3, 10, E'user:\nassistant:\n'), (2, 'II', 2, 10, E'assistant:\nuser:\n'), (3, 'II', 3, 10, E'user:\nassistant:\n')),
edits(mid, initial, edit, t, ec, becomes) AS (VALUES (0, NULL, 'D', 0, 2, NULL), (1, NULL, 'D', 1, 2, NULL), (2, NULL, 'D', 2, 2, NULL), (3, NULL, 'D', 3, 2, NULL),
  (0, 's', 'K', 1, 0, NULL), (0, 'u', 'K', 2, 0, NULL), (1, 'u', 'K', 2, 0, NULL), (3, 'u', 'K', 2, 0, NULL), (2, 'a', 'K', 3, 0, NULL),
  (0, NULL, 'R', 2, 1, 'user'), (1, NULL, 'R', 2, 1, 'user'), (3, NULL, 'R', 2, 1, 'user'), (2, NULL, 'R', 3, 1, 'assistant')),
macro AS (SELECT f, t, initial, edit, run || edit AS code, rc + ec AS c, made, becomes FROM runs JOIN edits USING (mid)),
dp AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS state, {'c': 0, 'a': '', 'r': ''} AS m FROM (SELECT DISTINCT conv_id FROM rows_)
  UNION ALL
  SELECT dp.conv_id, dp.pos + 1, x.t, min({'c': m.c + x.c + CASE WHEN x.edit <> 'D' AND r.fault = 1 THEN 5 ELSE 0 END, 'a': m.a || x.code,
    'r': m.r || x.made || CASE x.edit WHEN 'D' THEN '' WHEN 'K' THEN r.role || ':' || r.text || chr(10) ELSE x.becomes || ':' || r.text || chr(10) END})
  FROM dp JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.pos = dp.pos + 1 JOIN macro x ON x.f = dp.state AND (x.initial IS NULL OR x.initial = r.initial) AND (x.edit = 'D' OR r.fault < 2)
  GROUP BY dp.conv_id, dp.pos, x.t
), ends AS (
  SELECT dp.conv_id, min({'c': m.c + e.c, 'a': m.a || e.run, 'r': m.r || e.made}) AS m FROM dp JOIN counted n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.pos
  JOIN (VALUES (0, 0, '', ''), (1, 10, 'II', E'user:\nassistant:\n'), (2, 5, 'I', E'assistant:\n'), (3, 0, '', '')) e(state, c, run, made) USING (state) GROUP BY dp.conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(m.c, 0)::BIGINT AS cost, coalesce(m.a, '') AS audit, sha256(coalesce(left(m.r, length(m.r) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""

OP13 = f"""
WITH t AS (SELECT doc_id, {_LOWER.replace('text', "coalesce(text, '')", 1)} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""

ORACLES = {"listed_url_rules": LISTED, "op3_minhash": OP3, "op5_line_dedup": OP5, "op9_decontamination": OP9, "op10_embeddings": OP10, "op11_ranked_search": OP11, "op12_conversation_repair": OP12, "op13_exact_dedup": OP13}
