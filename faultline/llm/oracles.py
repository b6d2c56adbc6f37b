"""DuckDB SQL of the operators whose results SQL can express, from their definitions."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard_join(words: int, percent: int) -> str:
    """Sets of shingles, links of all pairs that share one, and the least id that links reach."""
    low = _LOWER.format("coalesce(text, '')")
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({low}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(list_slice(w, i, i + {words} - 1), ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
g AS (SELECT sha256(string_agg(shingle, chr(10) ORDER BY shingle)) AS class, doc_id FROM s GROUP BY doc_id),
c AS (SELECT class, min(doc_id) AS v FROM g GROUP BY class),
t AS (SELECT s.* FROM s JOIN c ON c.v = s.doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b USING (shingle) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
    WHERE a.doc_id <> b.doc_id AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) GROUP BY ALL HAVING 100 * count(*) >= {percent} * (any_value(x.n) + any_value(y.n) - count(*))),
r AS (SELECT v AS a, v AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a AS v, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN c USING (class) LEFT JOIN k ON k.v = c.v"""


def decontamination(width: int) -> str:
    """Windows of items, their occurrences among the documents' windows of the same size, and the words inside these."""
    words = f"regexp_extract_all({_LOWER.format('''coalesce(text, '')''')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item, {words} AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(len(w), {width}) AS size, unnest(list_transform(range(1, greatest(1, len(w) - {width} + 1) + 1), lambda k: array_to_string(list_slice(w, k, k + {width} - 1), ' '))) AS x FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM i),
o AS (SELECT doc_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda k: struct_pack(pos := k, x := array_to_string(list_slice(w, k, k + size - 1), ' ')))) AS s FROM d, sizes WHERE len(w) >= size),
f AS (SELECT o.doc_id, o.s.pos AS pos, o.size, i.item FROM o JOIN i ON i.size = o.size AND i.x = o.s.x),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM f) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM f GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(items.l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""
