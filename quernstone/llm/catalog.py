"""Every query of the training-data operators with its SQL where SQL can say it."""

from __future__ import annotations

from quernstone.llm import abuse, encoding, maincontent, mixing, nearsets, neighbours, pairs, personal, repeats

QUERIES = {
    "p1_found": personal.found,
    "p1_redacted": personal.redacted,
    "p2_found": repeats.found,
    "p2_clean": repeats.clean,
    "p4_found": pairs.found,
    "p5_found": nearsets.found,
    "p5_groups": nearsets.groups,
    "p6_found": neighbours.found,
    "p7_found": maincontent.found,
    "p8_ids": encoding.ids,
    "p9_mix": mixing.selection,
    "p9_shares": mixing.shares,
    "p10_found": abuse.found,
    "p10_rates": abuse.rates,
}


def _sets(table: str, key: str, text: str, words: int) -> str:
    """Distinct word sequences of each row, and how many it has."""
    gram = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(words))
    return rf"""w AS (SELECT {key} AS id, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+') AS w FROM {table} WHERE {text} IS NOT NULL),
g AS (SELECT DISTINCT id, {gram} AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - {words - 1})) AS i FROM w WHERE len(w) >= {words})),
n AS (SELECT id, count(*) AS n, CAST(bit_xor(hash(g)) AS VARCHAR) || count(*) AS cls FROM g GROUP BY id)"""


def _near(threshold: float) -> str:
    return f"""near AS (SELECT a.id AS a, b.id AS b, x.cls AS ca, y.cls AS cb FROM g a JOIN g b ON a.g = b.g AND a.id < b.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id
GROUP BY a.id, b.id, x.cls, y.cls, x.n, y.n HAVING count(*) / CAST(x.n + y.n - count(*) AS DOUBLE) >= {threshold})"""


SIMILAR_SQL = f"WITH {_sets('docs', 'ord', 'markdown', 3)}, {_near(0.7)} SELECT a AS ord_a, b AS ord_b FROM near"
GROUPS_SQL = f"""WITH {_sets('documents', 'doc_id', 'text', 5)}, {_near(0.8)},
link AS (SELECT DISTINCT ca, cb FROM near WHERE ca <> cb UNION SELECT DISTINCT cb, ca FROM near WHERE ca <> cb), links AS (SELECT ca AS cls, count(*) AS links FROM link GROUP BY ca),
first AS (SELECT cls, min(id) AS rep FROM n GROUP BY cls)
SELECT n.id, f.rep, coalesce(l.links, 0) AS links FROM n JOIN first f ON f.cls = n.cls LEFT JOIN links l ON l.cls = n.cls"""
NEAREST_SQL = """
WITH c AS (SELECT chunk_id, any_value(vector ORDER BY vector IS NULL) AS v FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
h AS (SELECT chunk_id, arg_min(vector, (query_id, ord)) AS v FROM hits WHERE chunk_id IS NOT NULL AND vector IS NOT NULL GROUP BY chunk_id),
u AS (SELECT coalesce(c.chunk_id, h.chunk_id) AS id, coalesce(c.v, h.v)::DOUBLE[] AS v FROM c LEFT JOIN h ON h.chunk_id = c.chunk_id),
g AS (SELECT id, v FROM u WHERE len(v) = 64 AND NOT list_bool_or([x IS NULL OR isnan(x) FOR x IN v]) AND list_sum([x * x FOR x IN v]) > 0),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM g a, g b WHERE a.id <> b.id),
t AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS n FROM s WHERE sim >= 0.9)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM t WHERE n <= 5"""

ORACLES = {
    "p2_found": repeats.FOUND_SQL,
    "p2_clean": repeats.CLEAN_SQL,
    "p5_found": SIMILAR_SQL,
    "p5_groups": GROUPS_SQL,
    "p6_found": NEAREST_SQL,
}
