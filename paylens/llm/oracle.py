"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others apply a fitted model, a pseudorandom permutation or a method that adds
to what SQL could state; their tests compare with plain-Python versions.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"'[\x20\x09-\x0D]+'"
_WORDS = "list_filter(string_split_regex(COALESCE({}, ''), {}), lambda x: x <> '')"

DECONTAMINATE = rf"""
WITH split AS (
  SELECT 'd' AS side, doc_id AS id, {_WORDS.format("lower(text)", r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'")} AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, {_WORDS.format("lower(text)", r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'")} FROM benchmark),
grams AS (
  SELECT side, id, list_distinct(CASE WHEN len(w) >= 5
      THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM split),
each AS (SELECT side, id, len(g) AS n, unnest(g) AS s FROM grams)
SELECT d.id AS doc_id, i.id AS item_id, CAST(i.n AS BIGINT) AS n_item, CAST(COUNT(*) AS BIGINT) AS n_shared,
  CAST(COUNT(*) AS DOUBLE) / i.n AS containment
FROM each d JOIN each i ON d.side = 'd' AND i.side = 'i' AND d.s = i.s
GROUP BY d.id, i.id, i.n HAVING COUNT(*) * 100 >= i.n * 80"""

SUBSTRING_DEDUP = f"""
WITH split AS (SELECT doc_id, {_WORDS.format("text", _SPACE)} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM split WHERE len(w) >= 13)),
firsts AS (SELECT s, MIN(doc_id) AS first_doc FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos
  FROM windows JOIN firsts USING (s) WHERE first_doc < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM split),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS t, COUNT(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - COALESCE(n, 0) AS BIGINT) AS n_removed,
  sha256(COALESCE(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)"""

VECTOR_SEARCH = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5"""

NEAR_DUP = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, {_WORDS.format(f"translate(text, '{_UPPER}', '{_LOWER}')", _SPACE)} AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2
      THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END) AS g
  FROM split),
each AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM each a JOIN each b ON a.s = b.s AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 80 * (a.n + b.n - COUNT(*))),
reach AS (
  SELECT doc_id, doc_id AS root FROM sets
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id WHERE r.root < l.b)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, r.root AS component_id, s.doc_id = r.root AS kept
FROM sets s JOIN (SELECT doc_id, MIN(root) AS root FROM reach GROUP BY doc_id) r USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {
    "op7_decontaminate": DECONTAMINATE,
    "op8_substring_dedup": SUBSTRING_DEDUP,
    "op9_vector_search": VECTOR_SEARCH,
    "op10_near_dup": NEAR_DUP,
}
