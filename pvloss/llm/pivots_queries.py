"""op13: links among all embeddings."""

from . import pivots
from .common import table


def op13_pivot_index(spark, sf_dir):
    return pivots.linked(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# No index here: the cosine of every pair, and labels that spread over the links until they settle.
ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER () AS k FROM embeddings
), f AS (
  SELECT k, len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0 AS ok,
         list_transform(coalesce(v, []), lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0 ELSE x END) AS v FROM e
), l AS (
  SELECT a.k AS a, b.k AS b FROM f a JOIN f b ON a.ok AND b.ok AND a.k <> b.k AND CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.95 END
), r AS (
  SELECT k AS a, k AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT r.a AS k, min(e.vec_id) AS component_id FROM r JOIN e ON e.k = r.b GROUP BY r.a
), d AS (
  SELECT a AS k, count(*) AS n FROM l GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, coalesce(e.vec_id = c.component_id, FALSE) AS kept
FROM e JOIN c ON c.k = e.k LEFT JOIN d ON d.k = e.k
"""
