"""SQL for the queries that the checking engine's SQL can express."""

from __future__ import annotations

#: The digests and sizes of all conversations; 20 is the length of the four control strings.
_CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, len(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<_\1', 'g'), '\[(/?INST\])', '[_\1', 'g'))
        + len(role) + 20 AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

#: Every pair of one label by brute force; components by walking the links.
_EMBEDDINGS = """
WITH RECURSIVE good AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), walk AS (
    SELECT vec_id AS start, vec_id AS reached FROM embeddings
    UNION SELECT w.start, l.b FROM walk w JOIN links l ON w.reached = l.a
), parts AS (SELECT start, min(reached) AS component_id FROM walk GROUP BY start),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN parts ON start = vec_id LEFT JOIN counts ON a = vec_id
"""

_SQUARED = "CAST(list_inner_product({0}, {0}) - 2 * list_inner_product({0}, {1}) + list_inner_product({1}, {1}) AS BIGINT)"
_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _clusters(k: int = 40, rounds: int = 5) -> str:
    """Every vector against every centroid, round by round."""
    steps = [
        f"""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE len(embedding) = 64 AND {_USABLE}
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY sha256('2:' || vec_id), v LIMIT {k}
)"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
    SELECT r, vec_id, v, best.c AS c, best.d AS d
    FROM (SELECT r, any_value(vec_id) AS vec_id, any_value(k.v) AS v, min(struct_pack(d := {_SQUARED.format("k.v", "c.v")}, c := c)) AS best
          FROM kept k CROSS JOIN c{n} c GROUP BY r)
), c{n + 1} AS MATERIALIZED (
    SELECT c, list(floor(total / n) ORDER BY i) AS v
    FROM (SELECT c, i, sum(v[i]) AS total, count(*) AS n FROM a{n}, range(1, 65) AS places(i) GROUP BY c, i) GROUP BY c
    UNION ALL SELECT c, v FROM c{n} WHERE c NOT IN (SELECT c FROM a{n})
)""")
    return f"""WITH {", ".join(steps)}, named AS (
    SELECT c, sha256(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM c{rounds}
)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN named USING (c)"""


def _codes(entries: int = 256, rounds: int = 4) -> str:
    """Every part against every entry of its codebook, round by round."""
    steps = [
        f"""kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
        list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v, len(embedding) // 4 AS w
    FROM embeddings WHERE {_USABLE}
), parts AS MATERIALIZED (
    SELECT r, p, v[p * w + 1 : p * w + w] AS v FROM kept, range(4) AS parts(p)
), b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM parts WHERE r <= {entries})"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
    SELECT r, p, v, best.e AS e, best.d AS d
    FROM (SELECT r, p, any_value(x.v) AS v, min(struct_pack(d := {_SQUARED.format("x.v", "b.v")}, e := e)) AS best
          FROM parts x JOIN b{n} b USING (p) GROUP BY r, p)
), b{n + 1} AS MATERIALIZED (
    SELECT p, e, list(floor(total / n) ORDER BY i) AS v
    FROM (SELECT p, e, i, sum(v[i]) AS total, count(*) AS n FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM a{n}) GROUP BY p, e, i) GROUP BY p, e
    UNION ALL SELECT p, e, v FROM b{n} WHERE (p, e) NOT IN (SELECT (p, e) FROM a{n})
)""")
    return f"""WITH {", ".join(steps)}, books AS (
    SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256
    FROM b{rounds}
), coded AS (
    SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r) CROSS JOIN books"""


SQL: dict[str, str] = {"op9_chat": _CHAT, "op10_embeddings": _EMBEDDINGS, "op11_centroids": _clusters(), "op13_vector_codes": _codes()}
