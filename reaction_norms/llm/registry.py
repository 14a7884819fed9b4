"""The named queries of the subpackage and the reference SQL of those that SQL expresses."""

from reaction_norms.llm.centroids import op13_centroids
from reaction_norms.llm.codes import op11_codes
from reaction_norms.llm.html import op10_html
from reaction_norms.llm.mixing import op8_mixing
from reaction_norms.llm.packing import op1_packing
from reaction_norms.llm.quality import op3_quality
from reaction_norms.llm.rules import op4_rules
from reaction_norms.llm.sharding import op7_sharding
from reaction_norms.llm.simhash import op6_simhash
from reaction_norms.llm.substrings import op5_substrings
from reaction_norms.llm.tokens import op12_token_counts
from reaction_norms.llm.toxicity import op2_toxicity
from reaction_norms.llm.winnowing import op9_winnowing

QUERIES = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_rules": op4_rules,
    "op5_substrings": op5_substrings,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_winnowing": op9_winnowing,
    "op10_html": op10_html,
    "op11_codes": op11_codes,
    "op12_token_counts": op12_token_counts,
    "op13_centroids": op13_centroids,
}

#: Vectors as whole numbers, those with a null or non-finite component left out.
_KEPT = """
kept AS MATERIALIZED (
    SELECT row_number() OVER () AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND {length} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""

_SQUARED = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
#: floor(sum / count) of whole numbers.
_FLOOR = "(sum({0}) - ((sum({0}) % count(*)) + count(*)) % count(*)) // count(*)"


def codes_sql(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round assigns each part to the nearest entry and moves the entries."""
    steps = [
        _KEPT.format(scale=4096, length="len(embedding) > 0"),
        f"""
part AS MATERIALIZED (SELECT i, p, v[p * {width} + 1 : (p + 1) * {width}] AS v FROM kept, range({parts}) AS r(p))""",
        f"""
book0 AS MATERIALIZED (
    SELECT p, e, v FROM part JOIN (SELECT i, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (i) WHERE e < {entries}
)""",
    ]
    for r in range(rounds):
        steps.append(f"""
near{r} AS MATERIALIZED (
    SELECT i, p, v, arg_min(e, (d, e)) AS e
    FROM (SELECT part.i, part.p, part.v, book.e, {_SQUARED.format("part.v", "book.v")} AS d FROM part JOIN book{r} AS book ON book.p = part.p)
    GROUP BY i, p, v
)""")
        steps.append(f"""
mean{r} AS MATERIALIZED (
    SELECT p, e, list(m ORDER BY place) AS v
    FROM (SELECT p, e, place, {_FLOOR.format("x")} AS m FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM near{r}) GROUP BY p, e, place)
    GROUP BY p, e
),
book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean.v, book.v) AS v FROM book{r} AS book LEFT JOIN mean{r} AS mean USING (p, e))""")
    steps.append(f"""
final AS MATERIALIZED (
    SELECT i, p, arg_min(e, (d, e)) AS e, min(d) AS d
    FROM (SELECT part.i, part.p, book.e, {_SQUARED.format("part.v", "book.v")} AS d FROM part JOIN book{rounds} AS book ON book.p = part.p)
    GROUP BY i, p
),
coded AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM final GROUP BY i)""")
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (i)
"""


def centroids_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Every round assigns each vector to the nearest centroid and moves the centroids."""
    nearest = "FROM (SELECT kept.i, kept.vec_id, kept.v, c.c, " + _SQUARED.format("kept.v", "c.v") + " AS d FROM kept, centre{r} AS c) GROUP BY i, vec_id, v"
    steps = [
        _KEPT.format(scale=1024, length=f"len(embedding) = {dim}"),
        f"""
centre0 AS MATERIALIZED (
    SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM kept) WHERE c < {k}
)""",
    ]
    for r in range(rounds):
        steps.append(f"""
near{r} AS MATERIALIZED (SELECT i, v, arg_min(c, (d, c)) AS c {nearest.format(r=r)}),
mean{r} AS MATERIALIZED (
    SELECT c, list(m ORDER BY place) AS v
    FROM (SELECT c, place, {_FLOOR.format("x")} AS m FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM near{r}) GROUP BY c, place)
    GROUP BY c
),
centre{r + 1} AS MATERIALIZED (SELECT c, coalesce(mean.v, centre.v) AS v FROM centre{r} AS centre LEFT JOIN mean{r} AS mean USING (c))""")
    return "WITH" + ",".join(steps) + f""",
final AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, CAST(min(d) AS BIGINT) AS distance {nearest.format(r=rounds)})
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(centre.v, ',')) AS centroid_sha256
FROM final JOIN centre{rounds} AS centre USING (c)
"""


ORACLE_SQL = {
    "op11_codes": codes_sql(),
    "op13_centroids": centroids_sql(),
    "op5_substrings": r"""
WITH listed AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents
), word AS (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM listed
), win AS (
    SELECT doc_id, i, md5(string_agg(w, ' ') OVER part) AS h, count(*) OVER part AS n
    FROM word
    WINDOW part AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), again AS (
    SELECT h FROM win WHERE n = 35 GROUP BY h HAVING count(*) > 1
), starts AS (
    SELECT doc_id, i FROM win WHERE n = 35 AND h IN (SELECT h FROM again)
), marked AS (
    SELECT word.doc_id, word.i, word.w,
           count(starts.i) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone
    FROM word LEFT JOIN starts ON starts.doc_id = word.doc_id AND starts.i = word.i
), kept AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
           coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS text
    FROM marked GROUP BY doc_id
)
SELECT listed.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM listed LEFT JOIN kept USING (doc_id)
""",
}
