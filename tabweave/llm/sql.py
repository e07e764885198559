"""SQL that the queries of this subpackage are checked against."""

OP4 = r"""
WITH RECURSIVE
t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, reached) AS (SELECT x, x FROM e UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.reached)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(reached) AS m FROM r GROUP BY id) USING (doc_id)
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix:' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 1)::DOUBLE / 4503599627370496.0)
    / CASE WHEN length(coalesce(text, '')) = 0 THEN 1.0
           ELSE greatest(0.1, 1 - 5 * (1 - length(translate(text, '#*$%&|<>!', ''))::DOUBLE / length(text))) END AS mix_key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
    [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (
  SELECT d.*, e.source_size, target, epochs, target - epochs * e.source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY mix_key, doc_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS reached
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  ((epochs + CASE WHEN reached <= rest OR (reached - size < rest AND reached - rest <= rest - (reached - size)) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM p
"""

OP9 = r"""
WITH u AS (
  SELECT page_id,
    CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') ELSE '' END AS raw_host,
    CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM pages),
h AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM h)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block'
    ELSE CASE WHEN regexp_matches(host, '^(.*[.])?(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)[.]example[.](com|net|org)$') THEN 'block' ELSE 'allow' END END AS verdict
FROM r
"""

# words in repeats of n words or more are those in n-word windows that the text holds twice
OP8 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
v AS (
  SELECT doc_id, i, length(w[i]) AS chars,
    CASE WHEN i + 2 <= len(w) THEN array_to_string(w[i:i + 2], ' ') END AS w3,
    CASE WHEN i + 7 <= len(w) THEN array_to_string(w[i:i + 7], ' ') END AS w8,
    CASE WHEN i + 60 <= len(w) THEN md5(array_to_string(w[i:i + 60], ' ')) END AS w61 FROM x),
c AS (
  SELECT doc_id, i, chars,
    w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w3) > 1 AS r3,
    w8 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w8) > 1 AS r8,
    w61 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w61) > 1 AS r61 FROM v),
m AS (
  SELECT doc_id, chars, r61,
    bool_or(r3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
    bool_or(r8) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c8 FROM c),
g AS (
  SELECT doc_id, sum(chars)::BIGINT AS word_chars, count_if(c3)::BIGINT AS n_repeat_words,
    coalesce(sum(chars) FILTER (WHERE c8), 0)::DOUBLE / greatest(sum(chars), 1)::DOUBLE AS covered_fraction, bool_or(r61) AS too_long FROM m GROUP BY doc_id),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
     - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(covered_fraction, 0.0)::DOUBLE AS covered_fraction, coalesce(too_long, false) AS too_long
  FROM d LEFT JOIN g USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND covered_fraction <= 0.4 AND NOT too_long AS kept, covered_fraction FROM b
"""

# the checksum goes bit by bit over the digits; a node is the digests of its turns, one after the other
OP11 = """
WITH RECURSIVE
o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda s, x:
    list_reduce(list_prepend(xor(s, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM o)),
r AS (
  SELECT c.conv_id, o.i AS part, 0 AS own, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 5 AND o.i <= h
  UNION ALL SELECT c.conv_id, o.i, 1, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > h),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, part) AS d, md5(strlen(role)::VARCHAR || ':' || role || text) AS turn, strlen(text) AS size FROM r),
p AS (SELECT conv_id, d, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY d) AS key, size FROM t UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT key, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM p GROUP BY key),
e AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(key, d) AS key FROM p GROUP BY conv_id) GROUP BY key),
k AS (SELECT left(key, length(key) - 32) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
u AS (SELECT key AS of, unnest(list_transform(range(0, depth + 1), lambda i: left(key, (32 * i)::INT))) AS key FROM n),
s AS (
  SELECT u.key, count(*) FILTER (k.key IS NULL) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
  FROM u JOIN n ON n.key = u.of LEFT JOIN k ON k.key = u.of GROUP BY u.key)
SELECT n.conv_id, n.depth::BIGINT AS depth, CASE WHEN n.depth > 0 THEN a.conv_id END AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN n a ON a.key = left(n.key, greatest(length(n.key) - 32, 0)) JOIN s ON s.key = n.key LEFT JOIN k ON k.key = n.key LEFT JOIN e ON e.key = n.key
"""

OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, list_inner_product(a.v, d.v)::BIGINT AS score
  FROM v a JOIN v d ON a.vec_id <> d.vec_id WHERE a.vec_id % 100 = 0),
g AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM g JOIN p USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""
