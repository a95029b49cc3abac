"""File graph, communities, channels and federation."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline import schemas as S
from strataline.functions import text as fx
from strataline.operators import graph
from strataline.operators import relational as R
from strataline.plans import git, starts
from strataline.tables import Tables, with_views


def file_graph(t: Tables, with_co_change: bool = False, include_tests: bool = False) -> DataFrame:
    """(a, b, weight): undirected file pairs by cross-file edges (field access aside), a < b.

    With co-change, half the number of common commits is added to a pair's weight.
    """
    x = t.linked.where((F.col("kind") != "field_access") & (F.col("source_file_id") != F.col("target_file_id")))
    if not include_tests:
        x = x.where(~F.col("source_test") & ~F.col("target_test"))
    a, b = F.least("source_file_id", "target_file_id"), F.greatest("source_file_id", "target_file_id")
    w = x.groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    if with_co_change:
        ids = t.files.select(F.col("id"), "path")
        co = git.co_change(t, include_tests=include_tests)
        co = co.join(ids.select(F.col("id").alias("x"), F.col("path").alias("file_a")), "file_a").join(ids.select(F.col("id").alias("y"), F.col("path").alias("file_b")), "file_b")
        w = w.unionByName(co.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("count") * 0.5).alias("weight"))).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    return w


def communities(t: Tables) -> DataFrame:
    """(id, label): communities of the file graph, computed once per state of the tables."""
    return t._view("communities", ("edges", "symbols", "files"), lambda: graph.communities(file_graph(t)))


def subsystems(t: Tables) -> DataFrame:
    """(file_id, label): communities of two files and more of the file graph."""
    lab = communities(t)
    big = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2).select("label")
    return lab.join(big, "label", "left_semi").select(F.col("id").alias("file_id"), "label")


def subsystem_summary(t: Tables) -> DataFrame:
    """Members, conductance, common directory and best-known exported symbols of each community."""
    lab = subsystems(t).withColumnRenamed("file_id", "id")
    cond = graph.conductance(file_graph(t), lab)
    paths = lab.join(t.files.select("id", "path"), "id")
    parts = F.split("path", "/")
    lo, hi = F.split(F.min("path"), "/"), F.split(F.max("path"), "/")
    # the common prefix of a set of paths is that of its least and its greatest
    common = paths.groupBy("label").agg(lo.alias("lo"), hi.alias("hi"))
    same = F.transform(F.sequence(F.lit(0), F.least(F.size("lo"), F.size("hi")) - 1), lambda i: F.col("lo")[i] == F.col("hi")[i])
    n = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))
    name = common.select("label", F.array_join(F.slice("lo", 1, F.least(n, F.size("lo") - 1).cast("int")), "/").alias("directory"))
    indeg = t.edges.where(F.col("kind") != "contains").groupBy(F.col("target_id").alias("stable_id")).agg(F.count(F.lit(1)).alias("n"))
    sym = t.symbols.where("is_exported").select("stable_id", "name", F.col("file_id").alias("id")).join(indeg, "stable_id").join(lab, "id")
    top = R.top_within(sym, ["label"], [F.desc("n"), "name", "stable_id"], 3).groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "name"))), lambda x: x["name"]), ",").alias("top"))
    return cond.join(name, "label").join(top, "label", "left").select("label", "members", "conductance", "directory", "top")


def stored_subsystems(t: Tables) -> DataFrame:
    """Files, symbols and languages of the subsystems named in the files table."""
    n = t.symbols.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("s"))
    return t.files.where(F.col("subsystem_id").isNotNull()).join(n, "id", "left").groupBy("subsystem_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("s", F.lit(0))).alias("symbols"), F.count_distinct("language").alias("languages")
    )


def cross_subsystem(t: Tables) -> DataFrame:
    """Imports between different subsystems: count and distinct importing files per pair."""
    f = t.files.where(F.col("subsystem_id").isNotNull()).select("id", "subsystem_id")
    a, b = f.select(F.col("id").alias("source_file_id"), F.col("subsystem_id").alias("from_id")), f.select(F.col("id").alias("target_file_id"), F.col("subsystem_id").alias("to_id"))
    x = t.imports.join(a, "source_file_id").join(b, "target_file_id").where(F.col("from_id") != F.col("to_id"))
    return x.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("imports"), F.count_distinct("source_file_id").alias("files"))


def stored_conductance(t: Tables) -> DataFrame:
    """Conductance of the stored subsystems in the file graph."""
    lab = t.files.where(F.col("subsystem_id").isNotNull()).select("id", F.col("subsystem_id").alias("label"))
    return graph.conductance(file_graph(t), lab)


def topology_hash(t: Tables) -> DataFrame:
    """(pairs, hash) of the file graph: equal graphs have equal hashes. Summed, so no row order matters.

    The sum of the pairs' 48-bit hashes is exact and then taken modulo 2**64 as a signed long: up to 2**63 - 1
    (every graph of up to 32,768 pairs) it is the plain sum, beyond it wraps, where the SQL fails by its cast to BIGINT.
    """
    g = file_graph(t).withColumn("h", F.conv(F.substring(F.sha2(F.concat_ws(":", "a", "b", F.col("weight").cast("long")), 256), 1, 12), 16, 10).cast("long"))
    word = F.lit(Decimal(2**64))
    low = F.sum(F.col("h").cast("decimal(20,0)")) % word
    return g.agg(F.count(F.lit(1)).alias("pairs"), low.alias("low")).select("pairs", F.when(F.col("low") < Decimal(2**63), F.col("low")).otherwise(F.col("low") - word).cast("long").alias("hash"))


def modules(t: Tables) -> DataFrame:
    """Files by module directory: the longest known directory of each path (projects and their main parts)."""
    dirs = t.files.select(F.substring_index("path", "/", 1).alias("dir")).unionByName(t.files.where(F.size(F.split("path", "/")) > 3).select(F.substring_index("path", "/", 2).alias("dir"))).distinct()
    m = R.longest_prefix(t.files.select("path", "size_bytes"), "path", dirs.withColumn("module", F.col("dir")), "dir", "module")
    return m.groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


# ------------------------------------------------------------------ channels


def channel_hits(t: Tables, pattern: str = r"\"([a-z]+:[a-z]+)\"") -> DataFrame:
    """(value, symbol_stable_id, file_id, line): matches in source lines, credited to the smallest enclosing symbol.

    Files of tests are left out; a symbol, value and line count once.
    """
    docs = t.raw("documents").where((F.col("doc_kind") == "source_file") & F.col("file_id").isNotNull())
    ok = t.files.where(~F.col("is_test")).select(F.col("id").alias("file_id"))
    lines = docs.join(ok, "file_id", "left_semi").select("file_id", F.posexplode(F.split("text", "\n")).alias("at", "source"))
    hits = lines.where(F.col("source").rlike(pattern)).select("file_id", (F.col("at") + 1).alias("line"), F.explode(F.regexp_extract_all("source", F.lit(pattern), F.lit(1))).alias("value")).distinct()
    spans = t.symbols.select("file_id", "stable_id", "line_start", "line_end")
    return R.smallest_enclosing(hits, spans, "file_id", "line", "line_start", "line_end", "stable_id", ["file_id", "line", "value"]).withColumnRenamed("stable_id", "symbol_stable_id")


def channels(t: Tables) -> DataFrame:
    """Values that at least two symbols share, with the number of symbols and of hits."""
    return channel_hits(t).groupBy("value").agg(F.count_distinct("symbol_stable_id").alias("symbols"), F.count(F.lit(1)).alias("hits")).where(F.col("symbols") >= 2)


def listed_channels(hits: DataFrame, kind: str | None = None) -> DataFrame:
    """(kind, value, symbols, hits) of linked facts (kind, value, symbol_stable_id): values that two symbols and more share."""
    x = hits if kind is None else hits.where(F.col("kind") == kind)
    return x.groupBy("kind", "value").agg(F.count_distinct("symbol_stable_id").alias("symbols"), F.count(F.lit(1)).alias("hits")).where(F.col("symbols") >= 2)


def show_channel(hits: DataFrame, t: Tables, kind: str, value: str) -> DataFrame:
    """(stable_id, name, path, line, detail): every place of one channel, by path and line."""
    x = hits.where((F.col("kind") == kind) & (F.col("value") == value)).select(F.col("symbol_stable_id").alias("stable_id"), "line", F.get_json_object("metadata", "$.detail").alias("detail"))
    return x.join(t.placed.select("stable_id", "name", "path"), "stable_id").select("stable_id", "name", "path", "line", "detail").orderBy("path", "line")


def endpoint_links(endpoints: DataFrame, same_method: bool = True) -> DataFrame:
    """Client and server endpoints on one route. ``same_method``: known methods must be equal (links within a
    repository); without it methods and path parameters as in links between projects: only slashes and case."""
    route = fx.route(F.col("path_pattern")) if same_method else fx.plain_route(F.col("path_pattern"))
    x = endpoints.withColumn("route", route)
    c = x.where(F.col("role") == "client").select("route", F.col("symbol_stable_id").alias("client_id"), F.col("http_method").alias("cm"))
    s = x.where(F.col("role") == "server").select("route", F.col("symbol_stable_id").alias("server_id"), F.col("http_method").alias("sm"))
    j = c.join(s, "route")
    if same_method:
        j = j.where(F.col("cm").isNull() | F.col("sm").isNull() | (F.upper("cm") == F.upper("sm")))
    return j.select("route", "client_id", "server_id").distinct()


# ------------------------------------------------------------------ federation


def project_symbols(t: Tables) -> DataFrame:
    """Exported symbols outside tests with their project, for links between projects."""
    return t.placed.where(F.col("is_exported") & ~F.col("is_test") & F.col("kind").isin("function", "class", "interface", "type", "enum", "method", "variable")).select(
        F.substring_index("path", "/", 1).alias("project"), "stable_id", "name", "kind"
    )


def name_links(t: Tables) -> DataFrame:
    """Names of one kind that several projects export: a linear fact table, one row per name and project.

    Pairs of projects are joined on demand from it (``project_links``); symbols of one name
    are never paired among each other.
    """
    per = project_symbols(t).groupBy("name", "kind", "project").agg(F.min("stable_id").alias("stable_id"), F.count(F.lit(1)).alias("symbols"))
    several = per.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2).select("name", "kind")
    return per.join(several, ["name", "kind"], "left_semi")


def project_links(t: Tables) -> DataFrame:
    """(source_project, target_project, shared): names two projects both export. Projects are few by nature."""
    x = name_links(t).select("name", "kind", "project")
    a, b = x.withColumnRenamed("project", "source_project"), x.withColumnRenamed("project", "target_project")
    return a.join(b, ["name", "kind"]).where(F.col("source_project") < F.col("target_project")).groupBy("source_project", "target_project").agg(F.count(F.lit(1)).alias("shared"))


def linked_projects(t: Tables, start: str) -> DataFrame:
    """Projects connected with ``start`` over shared names, with the number of hops."""
    p = project_links(t)
    both = p.select(F.col("source_project").alias("src"), F.col("target_project").alias("dst")).unionByName(p.select(F.col("target_project").alias("src"), F.col("source_project").alias("dst")))
    r = graph.reach(t.spark.createDataFrame([("q", start)], "key string, id string"), both)
    return r.select(F.col("id").alias("project"), F.col("depth").alias("hops"))


def boundaries(xedges: DataFrame, source_project: str, source_id: str, target_project: str, max_hops: int = 5) -> DataFrame:
    """Ways across project edges from a symbol into a project: (stable_id, hops), each landing once at its least hops."""
    e = xedges.select(
        F.concat_ws("\x1f", "source_project", "source_stable_id").alias("src"), F.concat_ws("\x1f", "target_project", "target_stable_id").alias("dst")
    )
    seeds = xedges.sparkSession.createDataFrame([("q", f"{source_project}\x1f{source_id}")], "key string, id string")
    r = graph.reach(seeds, e, max_hops).where(F.col("depth") > 0)
    at = F.split("id", "\x1f")
    return r.select(at[0].alias("project"), at[1].alias("stable_id"), F.col("depth").alias("hops")).where(F.col("project") == target_project).drop("project")


def federated_dead(dead: DataFrame, xedges: DataFrame) -> DataFrame:
    """Locally dead symbols without an inbound edge from another project; heuristic edges do not count."""
    used = xedges.where(F.col("confidence") != "heuristic").select(F.col("target_stable_id").alias("stable_id"))
    return dead.join(used, "stable_id", "left_anti")


def cross_project_fanout(t: Tables) -> DataFrame:
    """Edges between symbols of different projects, per pair and kind."""
    x = t.linked.where(F.col("source_project") != F.col("target_project"))
    return x.groupBy("source_project", "target_project", "kind").agg(F.count(F.lit(1)).alias("edges"))


def _q(f, **kw):
    return lambda spark, d: f(Tables(spark, d), **kw)


QUERIES = {
    "graph_files": _q(file_graph),
    "graph_files_co_change": _q(file_graph, with_co_change=True),
    "structure_subsystems": _q(subsystems),
    "structure_subsystem_summary": _q(subsystem_summary),
    "structure_modularity": lambda s, d: graph.modularity(file_graph(t := Tables(s, d)), communities(t)),
    "structure_stored_subsystems": _q(stored_subsystems),
    "structure_cross_subsystem": _q(cross_subsystem),
    "structure_conductance": _q(stored_conductance),
    "structure_topology_hash": _q(topology_hash),
    "structure_modules": _q(modules),
    "channels_hits": _q(channel_hits),
    "channels_list": _q(channels),
    "federation_name_links": _q(name_links),
    "federation_project_links": _q(project_links),
    "federation_linked_projects": lambda s, d: linked_projects(t := Tables(s, d), starts.largest_project(t)),
    "federation_edges": _q(cross_project_fanout),
}

_GRAPH = """WITH g AS (SELECT least(a.file_id, b.file_id) AS a, greatest(a.file_id, b.file_id) AS b, count(*)::DOUBLE AS weight FROM ec e
  JOIN sf a ON a.stable_id = e.source_id JOIN sf b ON b.stable_id = e.target_id WHERE e.kind <> 'field_access' AND a.file_id <> b.file_id AND NOT a.is_test AND NOT b.is_test GROUP BY 1, 2),
cf AS (SELECT DISTINCT commit_hash, file_path FROM ch),
co AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, 0.5 * n AS weight FROM (
    SELECT a.file_path AS p, b.file_path AS q, count(*) AS n FROM cf a JOIN cf b ON a.commit_hash = b.commit_hash AND a.file_path < b.file_path GROUP BY 1, 2 HAVING count(*) >= 2)
  JOIN fc x ON x.path = p JOIN fc y ON y.path = q WHERE NOT x.is_test AND NOT y.is_test),
hits AS (SELECT DISTINCT file_id, line, value FROM (SELECT d.file_id, d.line, unnest(regexp_extract_all(d.source, '"([a-z]+:[a-z]+)"', 1)) AS value FROM (
    SELECT file_id, unnest(string_split(text, chr(10))) AS source, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE doc_kind = 'source_file' AND file_id IS NOT NULL) d
    JOIN fc f ON f.id = d.file_id WHERE NOT f.is_test)),
credited AS (SELECT * EXCLUDE (r) FROM (SELECT h.file_id, h.line, h.value, s.stable_id AS symbol_stable_id, row_number() OVER (PARTITION BY h.file_id, h.line, h.value ORDER BY s.line_end - s.line_start, s.stable_id) AS r
  FROM hits h JOIN sc s ON s.file_id = h.file_id AND h.line BETWEEN s.line_start AND s.line_end) WHERE r = 1),
ps AS (SELECT split_part(path, '/', 1) AS project, stable_id, name, kind FROM sf WHERE is_exported AND NOT is_test AND kind IN ('function', 'class', 'interface', 'type', 'enum', 'method', 'variable')),
nl AS (SELECT name, kind, project, min(stable_id) AS stable_id, count(*) AS symbols FROM ps GROUP BY 1, 2, 3),
shared AS (SELECT * FROM nl WHERE (name, kind) IN (SELECT (name, kind) FROM nl GROUP BY name, kind HAVING count(*) >= 2)),
pl AS (SELECT a.project AS source_project, b.project AS target_project, count(*) AS shared FROM shared a JOIN shared b ON a.name = b.name AND a.kind = b.kind AND a.project < b.project GROUP BY 1, 2)
"""
_s = lambda tail, rec=False: with_views(_GRAPH + tail, rec)

ORACLE = {
    "graph_files": _s("SELECT * FROM g"),
    "graph_files_co_change": _s("SELECT a, b, sum(weight)::DOUBLE AS weight FROM (SELECT * FROM g UNION ALL SELECT * FROM co) GROUP BY 1, 2"),
    "structure_stored_subsystems": _s(
        """SELECT subsystem_id, count(*) AS files, sum(coalesce(s, 0))::BIGINT AS symbols, count(DISTINCT language) AS languages FROM fc
        LEFT JOIN (SELECT file_id, count(*) AS s FROM sc GROUP BY 1) x ON x.file_id = fc.id WHERE subsystem_id IS NOT NULL GROUP BY 1"""
    ),
    "structure_cross_subsystem": _s(
        """SELECT a.subsystem_id AS from_id, b.subsystem_id AS to_id, count(*) AS imports, count(DISTINCT source_file_id) AS files FROM im JOIN fc a ON a.id = source_file_id JOIN fc b ON b.id = target_file_id
        WHERE a.subsystem_id <> b.subsystem_id GROUP BY 1, 2"""
    ),
    "structure_conductance": _s(
        """, x AS (SELECT weight, p.subsystem_id AS la, q.subsystem_id AS lb FROM g JOIN fc p ON p.id = a JOIN fc q ON q.id = b WHERE p.subsystem_id IS NOT NULL AND q.subsystem_id IS NOT NULL),
        y AS (SELECT l AS label, sum(o) AS o, sum(i) AS i FROM (SELECT la AS l, CASE WHEN la <> lb THEN weight ELSE 0 END AS o, CASE WHEN la = lb THEN weight ELSE 0 END AS i FROM x
          UNION ALL SELECT lb, weight, 0 FROM x WHERE la <> lb) GROUP BY 1)
        SELECT n.label, members, round(coalesce(CASE WHEN 2 * i + o > 0 THEN o / (2 * i + o) END, 0.0), 6) AS conductance
        FROM (SELECT subsystem_id AS label, count(*) AS members FROM fc WHERE subsystem_id IS NOT NULL GROUP BY 1) n LEFT JOIN y ON y.label = n.label"""
    ),
    "structure_topology_hash": _s("SELECT count(*) AS pairs, sum(('0x' || substr(sha256(a || ':' || b || ':' || weight::BIGINT), 1, 12))::BIGINT)::BIGINT AS hash FROM g"),
    "structure_modules": _s(
        """, dirs AS (SELECT DISTINCT split_part(path, '/', 1) AS dir FROM fc UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM fc WHERE len(string_split(path, '/')) > 3),
        m AS (SELECT path, size_bytes, (SELECT max_by(dir, length(dir)) FROM dirs WHERE starts_with(fc.path, dir || '/')) AS module FROM fc)
        SELECT module, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM m GROUP BY 1"""
    ),
    "channels_hits": _s("SELECT * FROM credited"),
    "channels_list": _s("SELECT value, count(DISTINCT symbol_stable_id) AS symbols, count(*) AS hits FROM credited GROUP BY 1 HAVING count(DISTINCT symbol_stable_id) >= 2"),
    "federation_name_links": _s("SELECT * FROM shared"),
    "federation_project_links": _s("SELECT * FROM pl"),
    "federation_linked_projects": _s(
        """, l AS (SELECT source_project AS a, target_project AS b FROM pl UNION SELECT target_project, source_project FROM pl),
        w(project, hops) AS (SELECT project, 0 FROM bp UNION SELECT l.b, w.hops + 1 FROM w JOIN l ON l.a = w.project WHERE w.hops < 20)
        SELECT project, min(hops) AS hops FROM w GROUP BY 1""", True
    ),
    "federation_edges": _s(
        """SELECT split_part(a.path, '/', 1) AS source_project, split_part(b.path, '/', 1) AS target_project, e.kind, count(*) AS edges FROM ec e JOIN sf a ON a.stable_id = e.source_id JOIN sf b ON b.stable_id = e.target_id
        WHERE split_part(a.path, '/', 1) <> split_part(b.path, '/', 1) GROUP BY 1, 2, 3"""
    ),
}
