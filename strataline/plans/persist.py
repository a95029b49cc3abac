"""Derived tables to store beside an index: flows, subsystems, and files that name theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators import graph
from strataline.plans import risk, structure
from strataline.tables import Tables


def flows_table(t: Tables, now_ms: int, depth: int = 5) -> DataFrame:
    """Rows of the flows table: one chain for each root, named by the root, its symbols by step and id."""
    f = risk.flows(t, depth).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("step", "stable_id"))).alias("x"))
    names = t.symbols.select(F.col("stable_id").alias("root"), "name")
    return f.join(names, "root").select(
        F.xxhash64("root").bitwiseAND(F.lit((1 << 62) - 1)).alias("id"), "name", F.lit(None).cast("string").alias("description"), F.col("root").alias("root_stable_id"),
        F.transform("x", lambda s: s["stable_id"]).alias("symbol_ids"), F.lit(None).cast("string").alias("model"), F.lit(now_ms).cast("long").alias("generated_at"),
    )


def flow_listing(flows: DataFrame, t: Tables) -> DataFrame:
    """(id, name, position, stable_id, symbol, path): stored flows with the symbols that still exist."""
    steps = flows.select("id", "name", F.posexplode("symbol_ids").alias("position", "stable_id"))
    return steps.join(t.placed.select("stable_id", F.col("name").alias("symbol"), "path"), "stable_id").select("id", "name", "position", "stable_id", "symbol", "path")


def subsystems_table(t: Tables, now_ms: int, commit: str | None = None) -> DataFrame:
    """Rows of the subsystems table: communities of two files and more with their members and conductance."""
    lab = structure.subsystems(t).withColumnRenamed("file_id", "id")
    members = lab.groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("member_file_ids"))
    about = structure.subsystem_summary(t).select("label", "directory", "conductance", "top")
    return members.join(about, "label").select(
        F.format_string("s%d", "label").alias("id"), F.col("directory").alias("name"), F.col("top").alias("description"), "member_file_ids", "conductance",
        F.lit(now_ms).cast("long").alias("generated_at"), F.lit(commit).cast("string").alias("generated_for_commit"),
    )


def files_with_subsystem(t: Tables, subsystems: DataFrame) -> DataFrame:
    """The files table, each row naming the subsystem that lists it, or none."""
    of = subsystems.select(F.col("id").alias("of"), F.explode("member_file_ids").alias("id"))
    return t.files.drop("subsystem_id").join(of, "id", "left").withColumnRenamed("of", "subsystem_id").select(*t.files.columns)


def same_topology(t: Tables, stored_hash: int | None) -> bool:
    """Whether the file graph is still the one that a stored hash was taken of: then subsystems need not be detected again."""
    return structure.topology_hash(t).first()["hash"] == stored_hash


def modularity_of(t: Tables, subsystems: DataFrame) -> DataFrame:
    """(modularity) of stored subsystems in the present file graph."""
    lab = subsystems.select(F.col("id").alias("label"), F.explode("member_file_ids").alias("id"))
    return graph.modularity(structure.file_graph(t), lab)
