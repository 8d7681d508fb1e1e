"""SQL that the longer queries are checked against."""

OP11_MERKLE_MANIFEST = """
WITH RECURSIVE fields AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head,
         list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS digits
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(list_reduce(digits, lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b)), 4294967295), 4294967295) % 3 = 0
              THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS tampered
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), up AS (
  SELECT lang, 0 AS level, i, leaf AS hash, n FROM placed
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(hash, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM up WHERE n > 1 GROUP BY lang, level, i // 8
), subroots AS (
  SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS level, i, subroot AS hash, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(hash, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY level, i // 8
), sides AS (
  SELECT coalesce('=' || lang, '') AS tree, level, i,
         coalesce(string_agg(hash, '') OVER (PARTITION BY lang, level, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(hash, '') OVER (PARTITION BY lang, level, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM up WHERE n > 1
), top_sides AS (
  SELECT level, i,
         coalesce(string_agg(hash, '') OVER (PARTITION BY level, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(hash, '') OVER (PARTITION BY level, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM top WHERE n > 1
), walk AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, i AS leaf_i, leaf, 0 AS level, i, coalesce(tampered, leaf) AS fold, '' AS proof FROM placed
  UNION ALL
  SELECT w.doc_id, w.tree, w.leaf_i, w.leaf, w.level + 1, w.i // 8, sha256(s.l || w.fold || s.r), w.proof || s.l || s.r
  FROM walk w JOIN sides s ON w.tree = s.tree AND w.level = s.level AND w.i = s.i
), at_subroot AS (
  SELECT w.*, s.subroot, s.i AS tree_i FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY tree, leaf_i ORDER BY level DESC) = 1) w
  JOIN subroots s ON w.tree = coalesce('=' || s.lang, '')
), climb AS (
  SELECT doc_id, tree, leaf_i, leaf, subroot, 0 AS level, tree_i AS i, fold, proof FROM at_subroot
  UNION ALL
  SELECT c.doc_id, c.tree, c.leaf_i, c.leaf, c.subroot, c.level + 1, c.i // 8, sha256(s.l || c.fold || s.r), c.proof || s.l || s.r
  FROM climb c JOIN top_sides s ON c.level = s.level AND c.i = s.i
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY tree, leaf_i ORDER BY level DESC) = 1), (SELECT hash AS root FROM top WHERE n = 1)
"""

OP12_CONVERSATION_TRIE = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS o
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, max(o) AS n, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS digits FROM turns GROUP BY conv_id
), heads AS (
  SELECT c.conv_id, h, least(h, coalesce(b.n, 0)) AS taken
  FROM (SELECT conv_id, xor(list_reduce(digits, lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b)), 4294967295), 4294967295) % 6 AS h FROM convs) c
  LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100
), rebuilt AS (
  SELECT k.conv_id, t.o AS d, role, text FROM heads k JOIN turns t ON t.conv_id = k.conv_id - k.conv_id % 100 AND t.o <= h
  UNION ALL
  SELECT k.conv_id, taken + t.o - h, role, text FROM heads k JOIN turns t ON t.conv_id = k.conv_id AND t.o > h
), steps AS (
  SELECT conv_id, d, length(text) AS chars, string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d) AS prefix FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM heads
), paths AS (
  SELECT conv_id, d, chars, sha256(prefix) AS node, lag(sha256(prefix)) OVER (PARTITION BY conv_id ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM steps
), nodes AS (
  SELECT node, min(d) AS depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids
  FROM paths GROUP BY node
), kids AS (
  SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT DISTINCT a.node, b.node AS lower FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.d >= a.d
), sums AS (
  SELECT below.node, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM below JOIN nodes ON lower = nodes.node LEFT JOIN kids ON kids.parent = lower GROUP BY below.node
)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(x.ids) AS ends_sha256
FROM nodes x JOIN sums USING (node) LEFT JOIN nodes p ON p.node = x.parent LEFT JOIN kids ON kids.parent = x.node
"""

OP13_REPEATED_PASSAGES = """
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(translate(coalesce(text, ''), concat(chr(9), chr(10), chr(11), chr(12), chr(13)), '     '), ' '), lambda w: w <> '') AS words
  FROM documents
), windows AS (
  SELECT r, i, list_slice(words, i, i + 34) AS seq FROM split, unnest(range(1, len(words) - 33)) AS u(i)
), again AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY seq) > 1
), gone AS (
  SELECT r, list_distinct(flatten(list(range(i, i + 35)))) AS places FROM again GROUP BY r
), kept AS (
  SELECT r, doc_id, len(words) AS n_words, len(coalesce(places, [])) AS n_removed,
         array_to_string(list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: NOT list_contains(coalesce(places, []), z[2])), lambda z: z[1]), ' ') AS rest
  FROM split LEFT JOIN gone USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(rest) AS kept_sha256 FROM kept
"""
