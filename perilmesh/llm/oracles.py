"""DuckDB SQL for the queries that SQL can express."""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, u.line AS line, u.i AS i,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) u
), firsts AS (
  SELECT k, min(doc_id) AS keeper FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT l.*, f.keeper IS NOT NULL AND f.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN firsts f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')"

CONTAMINATION = f"""
WITH texts AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + 12], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), hits AS (
  SELECT DISTINCT doc_id, item, p, n
  FROM (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM texts, (SELECT DISTINCT n FROM windows))) JOIN windows USING (n, g)
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
), tokens AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM texts
), counted AS (
  SELECT word, count(*) AS n FROM tokens GROUP BY word
), placed AS (
  SELECT DISTINCT item, w, i, least(i + 12, len(w)) AS j, unnest(range(i, least(i + 12, len(w)) + 1)) AS p
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), ranked AS (
  SELECT item, w, i, w[p] AS word, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY item, w, i ORDER BY coalesce(n, 0), p) AS r FROM placed LEFT JOIN counted ON word = w[p]
), pairs AS (
  SELECT DISTINCT x.item, x.word AS a, y.word AS b FROM ranked x JOIN ranked y ON x.item = y.item AND x.w = y.w AND x.i = y.i WHERE x.r = 1 AND y.r = 2 AND x.n > 0
), near AS (
  SELECT x.doc_id, count(DISTINCT item) AS n_near FROM pairs JOIN tokens x ON x.word = a JOIN tokens y ON y.doc_id = x.doc_id AND y.word = b AND y.p <> x.p AND abs(y.p - x.p) < 13 GROUP BY x.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
"""

PREFIX_TRIE = """
WITH bytes AS (SELECT unnest(range(256)) AS b),
rounds AS (SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM bytes),
lookup AS (SELECT list(v ORDER BY b) AS t FROM rounds),
convs AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a // 256, t[(xor(a, x) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), lookup
), own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT convs.c, i, role, text FROM convs JOIN own ON own.c = convs.c - convs.c % 5 AND i <= h
  UNION ALL SELECT convs.c, i, role, text FROM convs JOIN own USING (c) WHERE i > h
), listed AS (
  SELECT convs.c, coalesce(list(struct_pack(role := role, text := text) ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS s FROM convs LEFT JOIN rebuilt USING (c) GROUP BY convs.c
), prefixes AS (
  SELECT c, d, len(s) = d AS ended, sha256(s[1:d]::VARCHAR) AS node, CASE WHEN d > 0 THEN sha256(s[1:d - 1]::VARCHAR) END AS parent, CASE WHEN d > 0 THEN strlen(s[d].text) ELSE 0 END AS bytes
  FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM listed)
), nodes AS (
  SELECT node, d AS depth, any_value(parent) AS parent, any_value(bytes) AS bytes, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ended), '') AS ends FROM prefixes GROUP BY node, d
), counted AS (
  SELECT n.*, (SELECT count(*) FROM nodes x WHERE x.parent = n.node AND x.depth = n.depth + 1) AS n_children FROM nodes n
), above AS (
  SELECT DISTINCT x.node, x.d, y.node AS upper, y.d AS upper_d FROM prefixes x JOIN prefixes y ON x.c = y.c AND y.d <= x.d
), sums AS (
  SELECT upper AS node, upper_d AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM above JOIN counted ON counted.node = above.node AND depth = d GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN sums s ON s.node = n.node AND s.depth = n.depth LEFT JOIN nodes p ON p.node = n.parent AND p.depth = n.depth - 1
"""

RANKED_SEARCH = f"""
WITH texts AS (SELECT doc_id, {_WORDS} AS w FROM documents),
counted AS (SELECT doc_id, len(w) AS n, w FROM texts WHERE len(w) > 0),
all_docs AS (SELECT count(*) AS big_n, sum(n) AS big_l FROM counted),
wanted AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS t FROM benchmark) GROUP BY item_id, t),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM counted) WHERE t IN (SELECT t FROM wanted) GROUP BY doc_id, n, t),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, all_docs GROUP BY t),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM tf JOIN weights USING (t) JOIN wanted USING (t), all_docs GROUP BY item_id, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""

ORACLES = {"op4_decontaminate": CONTAMINATION, "op9_line_dedup": LINE_DEDUP, "op12_prefix_trie": PREFIX_TRIE, "op13_ranked_search": RANKED_SEARCH}
