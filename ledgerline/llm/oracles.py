"""What registered queries return, said in SQL that compares everything with everything; for small tables."""

from __future__ import annotations

from ledgerline.llm.common import LOWER

_REACH = """e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT id AS a, id AS b FROM ids UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
 c AS (SELECT a AS id, min(b) AS component_id FROM r GROUP BY 1)"""

#: All pairs of documents that share a shingle, and reachability by links.
MINHASH_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w
), sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p WHERE 100 * n >= 75 * (na + nb - n)), ids AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON doc_id = id
"""

#: All pairs of vectors with equal labels.
EMBEDDINGS_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, coalesce(label IS NOT NULL AND len(embedding) > 0
    AND len([y FOR y IN embedding IF y IS NULL OR isnan(y) OR isinf(y)]) = 0 AND len([y FOR y IN embedding IF y <> 0]) > 0, false) AS good FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.good AND b.good AND a.vec_id < b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), ids AS (SELECT vec_id AS id FROM embeddings), {_REACH},
 n AS (SELECT a AS id, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON vec_id = c.id LEFT JOIN n ON vec_id = n.id
"""

_ESCAPES = r"len(regexp_extract_all({c}, '(\\|<\||</?s>|<</?SYS>>|\[/?INST\])'))"

#: Turns in order, and the length of their template with a backslash for each character that is escaped.
CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE role END, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length(role) + length(text) + {_ESCAPES.format(c='role')} + {_ESCAPES.format(c='text')})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

#: One row with the byte table of CRC-32.
_CRC = "crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], LAMBDA c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i))"


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, beside the table ``crc``."""
    codes = f"[('0x' || substr(hex(encode({text})), 2 * j + 1, 2))::BIGINT FOR j IN range(len(hex(encode({text}))) // 2)]"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), LAMBDA c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


_LOWER = f"'{LOWER[0]}', '{LOWER[1]}'"

#: Near words by what is left of them without a letter, at the same place for an exchange.
SPELLING_SQL = rf"""
WITH RECURSIVE {_CRC}, runs AS (
  SELECT id, translate(run, {_LOWER}) AS run FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) WHERE length(run) >= 7
), kinds AS (SELECT id, run, count(*) AS n FROM runs GROUP BY 1, 2), h AS (SELECT run, n, {_crc32("(id || ':' || run)")} AS h FROM kinds, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, (h % length(run)) + 2) ELSE run END AS word, n FROM h
), v AS (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2
), d AS (SELECT DISTINCT word, i, rest FROM (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v))
), near AS (
  SELECT a.word, b.word AS near FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM d WHERE rest IN (SELECT word FROM v) UNION SELECT rest, word FROM d WHERE rest IN (SELECT word FROM v)
), best AS (
  SELECT near.word, count(*)::BIGINT AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM near JOIN v ON v.word = near GROUP BY 1
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)
), r AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT r.word, f.form, k + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, form, roots.root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, k) AS root FROM r GROUP BY 1) roots USING (word)
"""

#: All ranks from one window.
RESAMPLING_SQL = rf"""
WITH {_CRC}, both_ AS (
  SELECT true AS mine, doc_id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark
), w AS (
  SELECT row_number() OVER () AS r, mine, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM both_
), f AS (SELECT r, mine, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS f FROM w
), names AS (SELECT f, {_crc32('f')} % 10000 AS b FROM (SELECT DISTINCT f FROM f), crc
), rows_ AS (SELECT r, mine, b, count(*) AS n FROM f JOIN names USING (f) GROUP BY 1, 2, 3
), c AS (SELECT i AS b, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM (SELECT unnest(range(10000)) AS i) LEFT JOIN (SELECT b, sum(n) FILTER (mine) AS s, sum(n) FILTER (NOT mine) AS t FROM rows_ GROUP BY 1) ON i = b
), g AS (
  SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM c
), weights AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM rows_ JOIN g USING (b) WHERE mine GROUP BY 1
), s AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weights USING (r) WHERE mine
), o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) FILTER (n_words >= 20) OVER () AS fit FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND rank <= 25 * fit // 100 THEN rank END AS rank FROM o
"""
