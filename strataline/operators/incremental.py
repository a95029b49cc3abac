"""Incremental index maintenance as steps from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delete_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Tables without the files of ``paths`` (path) and what hangs on them: symbols, edges with their file, hits, links."""
    files = tables["files"]
    gone = files.join(paths.select("path"), "path", "left_semi").select(F.col("id").alias("file_id"))
    out = dict(tables)
    out["files"] = files.join(paths.select("path"), "path", "left_anti")
    for name, col in (("symbols", "file_id"), ("edges", "file_id"), ("channel_hits", "file_id"), ("imports", "source_file_id"), ("test_links", "test_file_id")):
        if name in out:
            out[name] = out[name].join(gone.withColumnRenamed("file_id", col), col, "left_anti").select(*out[name].columns)
    if "imports" in out:
        lost = gone.select(F.col("file_id").alias("target_file_id"), F.lit(True).alias("__gone"))
        x = out["imports"].join(lost, "target_file_id", "left")
        out["imports"] = x.withColumn("target_file_id", F.when(F.col("__gone").isNull(), F.col("target_file_id"))).select(*tables["imports"].columns)
    return out


def drop_cross_file_edges(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges without those across files (no file_id) whose source is in ``sources`` (stable_id)."""
    s = sources.select(F.col("stable_id").alias("source_id")).distinct()
    within = edges.where(F.col("file_id").isNotNull())
    return within.unionByName(edges.where(F.col("file_id").isNull()).join(s, "source_id", "left_anti").select(*edges.columns))


def drop_heuristic_calls(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Edges without heuristic calls at the (file_id, line, col) of ``positions``."""
    here = (F.col("kind") == "calls") & (F.col("confidence") == "heuristic")
    keys = ["file_id", "line", "col"]
    kept = edges.where(here).join(positions.select(*keys).distinct(), keys, "left_anti").select(*edges.columns)
    return edges.where(~F.coalesce(here, F.lit(False))).unionByName(kept)


#: Columns that hold stable ids, by table.
ID_COLUMNS = {
    "symbols": ("stable_id", "parent_id"), "edges": ("source_id", "target_id"), "test_links": ("source_symbol_stable_id",), "api_endpoints": ("symbol_stable_id",),
    "embedding_meta": ("symbol_stable_id",), "symbol_summaries": ("symbol_stable_id",), "cross_project_edges": ("source_stable_id", "target_stable_id"), "flows": ("root_stable_id",),
}


def rename_symbols(tables: dict[str, DataFrame], renames: DataFrame) -> dict[str, DataFrame]:
    """Tables with stable ids rewritten after files moved: ``renames`` has (old_path, new_path).

    A symbol's id is made of its path, kind and qualified name, so the new ids follow from
    the new path; a qualified name that starts with the old path moves along. Rows that
    already stood at the destination give way. Ids in the member lists of flows are rewritten.
    """
    files, symbols = tables["files"], tables["symbols"]
    f = files.join(renames.withColumnRenamed("old_path", "path"), "path").select(F.col("id").alias("file_id"), "path", "new_path")
    s = symbols.join(f, "file_id")
    q = F.when(F.col("qualified_name").startswith(F.col("path")), F.concat("new_path", F.expr("substring(qualified_name, length(path) + 1)"))).otherwise(F.col("qualified_name"))
    moved = s.select(F.col("stable_id").alias("old_id"), q.alias("new_name"), F.substring(F.sha2(F.concat_ws(":", "new_path", "kind", q), 256), 1, 32).alias("new_id"))
    out = dict(tables)
    taken = renames.select(F.col("new_path").alias("path")).distinct()
    stay = files.join(taken, "path", "left_anti")
    there = files.join(taken, "path", "left_semi").select(F.col("id").alias("file_id"))
    out["files"] = stay.join(renames.withColumnRenamed("old_path", "path"), "path", "left").withColumn("path", F.coalesce("new_path", "path")).select(*files.columns)
    out["symbols"] = symbols.join(there, "file_id", "left_anti").select(*symbols.columns)
    names = moved.select(F.col("old_id").alias("stable_id"), "new_name")
    out["symbols"] = out["symbols"].join(names, "stable_id", "left").withColumn("qualified_name", F.coalesce("new_name", "qualified_name")).select(*symbols.columns)
    ids = moved.select("old_id", "new_id")
    for name, cols in ID_COLUMNS.items():
        if name not in out:
            continue
        df = out[name]
        for c in cols:
            m = ids.select(F.col("old_id").alias(c), F.col("new_id").alias("__new"))
            df = df.join(m, c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
        out[name] = df.select(*tables[name].columns)
    if "flows" in out:
        e = out["flows"].select("id", F.posexplode_outer("symbol_ids").alias("at", "old_id")).join(ids, "old_id", "left")
        lists = e.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("new_id", "old_id").alias("x")))), lambda x: x["x"]).alias("symbol_ids"))
        out["flows"] = out["flows"].drop("symbol_ids").join(lists, "id").select(*tables["flows"].columns)
    return out


def sync_is_test(files: DataFrame, pattern: str) -> DataFrame:
    """Files with their test flag set by a path pattern."""
    return files.withColumn("is_test", F.col("path").rlike(pattern))
