"""SQL for the queries that it can express, over the whole tables; plain self-joins, so for small data."""

from __future__ import annotations

from .chat import ORACLE as _CHAT

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _words(source: str, key: str, split: str) -> str:
    """(key, pos, word) of every word."""
    return f"SELECT {key}, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM (SELECT {key}, {split} AS ws FROM {source})"


_BY_SPACE = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_BY_SPACE_LOWER = f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+')"
_ALNUM = f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _gram(n: int, key: str) -> str:
    return f"string_agg(word, chr(1)) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"


SUBSTRING = f"""
WITH w AS ({_words('documents', 'doc_id', _BY_SPACE)}),
g AS (SELECT doc_id, pos, word, {_gram(35, 'doc_id')} AS win, count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS n FROM w),
d AS (SELECT doc_id, pos, word, n = 35 AND count(*) FILTER (n = 35) OVER (PARTITION BY win) > 1 AS dup FROM g),
c AS (SELECT doc_id, pos, word, max(dup) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM d),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE w AS ({_words('documents', 'doc_id', _BY_SPACE_LOWER)}),
t AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
g AS (SELECT doc_id, {_gram(5, 'doc_id')} AS gram, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, n FROM w JOIN t USING (doc_id)),
s AS (SELECT DISTINCT doc_id, gram FROM g WHERE i <= greatest(n - 4, 1)),
z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * common >= 75 * (x.size + y.size - common)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, coalesce(size, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM documents LEFT JOIN z USING (doc_id) LEFT JOIN m USING (doc_id)
"""

DECONTAMINATION = f"""
WITH i AS ({_words('benchmark', 'item_id', _ALNUM)}),
t AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
ph AS (SELECT DISTINCT item_id, gram, least(n, 10) AS n FROM (SELECT item_id, {_gram(10, 'item_id')} AS gram, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS k, n FROM i JOIN t USING (item_id)) WHERE k <= greatest(n - 9, 1)),
w AS ({_words('documents', 'doc_id', _ALNUM)}),
dg AS ({" UNION ALL ".join(f"SELECT doc_id, pos, {n} AS n, {_gram(n, 'doc_id')} AS gram FROM w WHERE EXISTS (SELECT 1 FROM ph WHERE n = {n})" for n in range(1, 11))}),
o AS (SELECT DISTINCT doc_id, pos, n, item_id FROM dg JOIN ph USING (gram, n)),
h AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM o),
c AS (SELECT doc_id, count(*) AS n_hit FROM h GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
u AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM e WHERE list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / a.norm / b.norm >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS vec_id, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)
"""

ORACLES = {
    "op3_embedding_dedup": EMBEDDINGS, "op4_substring_dedup": SUBSTRING, "op5_ngram_jaccard": JACCARD, "op7_decontamination": DECONTAMINATION, "op9_chat_formatting": _CHAT,
}
