"""SQL (DuckDB) for the operators of this subpackage that SQL can express."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Components of the symmetric edges in ``edges`` (a, b).
_REACH = """
reach(node, other) AS (
  SELECT a, b FROM edges
  UNION
  SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a
)"""

ORACLES = {
    "op1_chat": r"""
WITH RECURSIVE rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), t AS (
  SELECT *, row_number() OVER w AS nth, sum(cost) OVER w AS upto FROM (
    SELECT conv_id, turn, role, text, (ceil(strlen(body) / 4.0) + 6)::BIGINT AS cost, 24 + length(name) + length(body) AS chars
    FROM (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body, replace(replace(role, '\', '\\'), '<|', '<\|') AS name FROM rows_)
  ) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
), conv AS (
  SELECT conv_id, count(*) AS n, max(CASE WHEN nth = 1 AND role = 'system' THEN 1 ELSE 0 END) AS sys,
         max(CASE WHEN nth = 1 AND role = 'system' THEN cost ELSE 0 END) AS sys_cost FROM t GROUP BY conv_id
), nxt AS (
  SELECT b.conv_id, b.nth - 1 AS lo,
         min(CASE WHEN a.upto - b.upto + b.cost > 512 THEN a.nth - 1 END) AS first_hi,
         min(CASE WHEN a.upto - b.upto + b.cost > greatest(1, 384 - c.sys_cost) THEN a.nth - 1 END) AS later_hi
  FROM t b JOIN t a ON a.conv_id = b.conv_id AND a.nth > b.nth JOIN conv c ON c.conv_id = b.conv_id GROUP BY 1, 2
), cut(conv_id, win, lo) AS (
  SELECT conv_id, 0, 0::BIGINT FROM conv
  UNION ALL
  SELECT c.conv_id, c.win + 1, CASE WHEN c.win = 0 THEN n.first_hi ELSE n.later_hi END
  FROM cut c JOIN nxt n ON n.conv_id = c.conv_id AND n.lo = c.lo WHERE (CASE WHEN c.win = 0 THEN n.first_hi ELSE n.later_hi END) IS NOT NULL
), again AS (
  SELECT c.conv_id, c.win, sum(CASE WHEN c.win > 0 AND (h.nth <= v.sys OR (h.nth > v.sys AND p.upto - h.upto + h.cost <= 128)) THEN h.chars ELSE 0 END) AS chars
  FROM cut c JOIN conv v ON v.conv_id = c.conv_id JOIN t p ON p.conv_id = c.conv_id AND p.nth = c.lo JOIN t h ON h.conv_id = c.conv_id AND h.nth <= c.lo GROUP BY 1, 2
), extra AS (SELECT conv_id, sum(chars) AS chars FROM again GROUP BY 1),
wins AS (SELECT conv_id, count(*) AS n_windows FROM cut GROUP BY 1)
SELECT t.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY nth), '')) AS loss_sha256,
       (sum(t.chars) + coalesce(any_value(extra.chars), 0))::BIGINT AS formatted_chars, any_value(wins.n_windows)::BIGINT AS n_windows
FROM t LEFT JOIN extra ON extra.conv_id = t.conv_id JOIN wins ON wins.conv_id = t.conv_id GROUP BY t.conv_id""",
    "op3_substring": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
least_ AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least_ USING (k) WHERE m < doc_id) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(ps, i) THEN NULL ELSE w[i] END), lambda x: x IS NOT NULL), ' ') END) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)""",
    "op4_neighbours": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
{_REACH},
comp AS (SELECT node, least(node, min(other)) AS c FROM reach GROUP BY node),
links AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM v LEFT JOIN links ON a = vec_id LEFT JOIN comp ON node = vec_id""",
    "op6_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.replace("text", "coalesce(text, '')"))} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
edges AS (SELECT a, b FROM pairs WHERE 100 * c >= 75 * (na + nb - c)),
{_REACH},
comp AS (SELECT node, least(node, min(other)) AS c FROM reach GROUP BY node),
same AS (SELECT a, least(a, min(b)) AS c FROM pairs WHERE c = na AND c = nb GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(same.c, doc_id) AS class_id, coalesce(comp.c, doc_id) AS component_id
FROM sets LEFT JOIN same ON a = doc_id LEFT JOIN comp ON node = doc_id""",
    "op12_urls": r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)) WHERE k = 1""",
    "op13_negatives": r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) QUALIFY row_number() OVER w <= 10""",
    "op11_resampling": rf"""
WITH w AS (SELECT 0 AS kind, doc_id AS id, regexp_extract_all({_LOWER.replace("text", "coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all({_LOWER.replace("text", "coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT kind, id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS f FROM w, range(1, 4) r(n) WHERE len(w) >= n),
crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x) // 2 + 1), lambda k: ('0x' || substr(x, 2 * k - 1, 2))::BIGINT)), lambda c, y: xor(c // 256, tab[xor(c % 256, y) + 1])), 4294967295) % 10000 AS b
      FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)), crc),
fb AS (SELECT kind, id, b FROM f JOIN b USING (f)),
n AS (SELECT b, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM fb GROUP BY b),
g AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
d AS (SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM fb JOIN g USING (b) WHERE kind = 0 GROUP BY id),
s AS (SELECT id AS doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM w LEFT JOIN d USING (id) WHERE kind = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS k, count(*) FILTER (fit) OVER () AS m FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND k <= 5 * m // 100 THEN k END::BIGINT AS rank FROM r""",
}
