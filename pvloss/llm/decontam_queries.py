"""op1: passages of the benchmark in all documents."""

from . import decontam
from .common import table


def op1_decontaminate(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# No seeds here: every pair of equal tokens, every diagonal, every window.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dt AS (SELECT doc_id, len(w) AS nd, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM d),
bt AS (SELECT item_id, len(w) AS ni, least(16, len(w)) AS win,
              CASE WHEN len(w) >= 16 THEN 13 WHEN len(w) >= 13 THEN len(w) - 2 ELSE len(w) END AS need,
              unnest(w) AS t, generate_subscripts(w, 1) - 1 AS q FROM b),
g AS (SELECT doc_id, item_id, p - q AS diag, any_value(nd) AS nd, any_value(ni) AS ni, any_value(win) AS win, any_value(need) AS need, list(p) AS ps
      FROM dt JOIN bt USING (t) GROUP BY ALL HAVING count(*) >= any_value(need)),
s AS (SELECT *, unnest(range(greatest(0, diag), least(nd, ni + diag) - win + 1)) AS start FROM g),
m AS (SELECT doc_id, item_id, win, need, start, len(list_filter(ps, lambda x: x >= start AND x < start + win)) AS matched FROM s)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(min(start) AS BIGINT) AS first_token, CAST(max(start + win) AS BIGINT) AS end_token
FROM m WHERE matched >= need GROUP BY doc_id, item_id
"""
