"""Queries of the general data operators: p6 (hierarchies) and p7 (orphan references)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import hierarchy as h
from strataline.operators import orphans as o
from strataline.session import table


def p6_found(spark, d):
    return h.non_roots(table(spark, d, "symbols"))


def p6_paths(spark, d):
    """Path, depth and root of every symbol that reaches a root."""
    return h.hierarchy(table(spark, d, "symbols"), with_path=True).where(F.col("depth") >= 0)


def p6_descendants(spark, d):
    """Number of descendants of each node and the distance of the furthest."""
    paths = h.hierarchy(table(spark, d, "symbols"), with_path=True)
    return h.descendants(paths).groupBy("ancestor").agg(F.count(F.lit(1)).alias("descendants"), F.max("distance").alias("height"))


def p7_found(spark, d):
    return o.missing_ends(table(spark, d, "edges"), table(spark, d, "symbols")).select("edge_id", "missing_end")


def p7_report(spark, d):
    return o.missing_ends_by_month(table(spark, d, "edges"), table(spark, d, "symbols"), table(spark, d, "files"))


def _misplaced(match):
    return lambda spark, d: o.misplaced(table(spark, d, "edges"), table(spark, d, "symbols"), match)


def p7_states(spark, d):
    """References that name nothing, and those whose symbol arrived later, per end and month."""
    return o.reference_states(table(spark, d, "edges"), table(spark, d, "symbols"), table(spark, d, "files"))


QUERIES = {f.__name__: f for f in (p7_states, p6_found, p6_paths, p6_descendants, p7_found, p7_report)}
QUERIES |= {f"p7_composite_{m}": _misplaced(m) for m in o.MATCH}

_TREE = """
WITH RECURSIVE node AS (
  SELECT s.stable_id AS id, min(p.stable_id) AS parent
  FROM symbols s LEFT JOIN (SELECT DISTINCT stable_id FROM symbols) p ON p.stable_id = s.parent_id
  GROUP BY s.stable_id
), tree(id, root_id, depth, path) AS (
  SELECT id, id, 0, id FROM node WHERE parent IS NULL
  UNION ALL
  SELECT n.id, t.root_id, t.depth + 1, t.path || '/' || n.id FROM tree t JOIN node n ON n.parent = t.id
)
"""

_ENDS = """
WITH ids AS (SELECT DISTINCT stable_id FROM symbols),
ends AS (
  SELECT id AS edge_id, 'source' AS missing_end, source_id AS ref, file_id FROM edges
  UNION ALL
  SELECT id, 'target', target_id, file_id FROM edges
), missing AS (
  SELECT * FROM ends WHERE ref IS NOT NULL AND ref <> '' AND NOT EXISTS (SELECT 1 FROM ids WHERE ids.stable_id = ends.ref)
)
"""

_REFS = """
WITH refs AS (SELECT id AS edge_id, file_id, nullif(source_id, '') AS source_id FROM edges),
marked AS (SELECT *, CASE WHEN file_id IS NULL THEN '-' ELSE 'x' END || CASE WHEN source_id IS NULL THEN '-' ELSE 'x' END AS nulls,
  EXISTS (SELECT 1 FROM symbols s WHERE s.file_id = refs.file_id AND s.stable_id = refs.source_id) AS both_found,
  EXISTS (SELECT 1 FROM symbols s WHERE s.file_id = refs.file_id) AS file_found, EXISTS (SELECT 1 FROM symbols s WHERE s.stable_id = refs.source_id) AS source_found FROM refs)
SELECT edge_id, nulls FROM marked WHERE (nulls = 'xx' AND NOT both_found)"""

ORACLE = {
    "p7_composite_simple": _REFS,
    "p7_composite_partial": _REFS + " OR (nulls = 'x-' AND NOT file_found) OR (nulls = '-x' AND NOT source_found)",
    "p7_composite_full": _REFS + " OR nulls IN ('x-', '-x')",
    "p7_states": """
    WITH ends AS (SELECT 'source' AS missing_end, source_id AS ref, file_id FROM edges UNION ALL SELECT 'target', target_id, file_id FROM edges),
    w AS (SELECT id, max(indexed_at) AS at FROM files GROUP BY 1),
    k AS (SELECT s.stable_id, min(w.at) AS at FROM symbols s LEFT JOIN w ON w.id = s.file_id GROUP BY 1)
    SELECT missing_end, strftime(make_timestamp(w.at * 1000), '%Y-%m') AS month, CASE WHEN k.stable_id IS NULL THEN 'missing' ELSE 'later' END AS state, count(*) AS ends
    FROM ends LEFT JOIN w ON w.id = ends.file_id LEFT JOIN k ON k.stable_id = ends.ref
    WHERE ref IS NOT NULL AND ref <> '' AND (k.stable_id IS NULL OR k.at > w.at) GROUP BY 1, 2, 3""",
    "p6_found": _TREE.replace("tree(id, root_id", "loose(id) AS (SELECT id FROM node), tree(id, root_id", 1)
    + """, rest AS (SELECT n.* FROM node n WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.id = n.id)),
    walk(id, up) AS (SELECT id, parent FROM rest UNION SELECT w.id, r.parent FROM walk w JOIN rest r ON r.id = w.up),
    ring AS (SELECT id FROM walk WHERE id = up)
    SELECT id AS stable_id, root_id, depth FROM tree WHERE depth > 0
    UNION ALL
    SELECT w.id, min(w.up), -1 FROM walk w JOIN ring ON ring.id = w.up GROUP BY w.id""",
    "p6_paths": _TREE + "SELECT id, root_id, depth, path FROM tree",
    "p6_descendants": _TREE
    + """SELECT a AS ancestor, count(*) AS descendants, max(distance) AS height FROM (
      SELECT unnest(string_split(path, '/')) AS a, depth - (unnest(range(depth + 1))) AS distance FROM tree WHERE depth > 0
    ) WHERE distance > 0 GROUP BY a""",
    "p7_found": _ENDS + "SELECT edge_id, missing_end FROM missing",
    "p7_report": _ENDS
    + """SELECT m.missing_end, strftime(make_timestamp(f.indexed_at * 1000), '%Y-%m') AS month, count(*) AS orphans
    FROM missing m LEFT JOIN (SELECT id, max(indexed_at) AS indexed_at FROM files GROUP BY id) f ON f.id = m.file_id
    GROUP BY 1, 2""",
}
