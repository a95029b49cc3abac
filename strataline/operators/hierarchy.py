"""Parent-child rows to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators.skew import HOT_ROWS, hot_keys, lookup
from strataline.session import Stored, free_shuffles

SEP = "/"


def parents(rows: DataFrame, node: str = "stable_id", parent: str = "parent_id") -> DataFrame:
    """One row per node: (id, parent), the parent null where it names no node.

    Rows with a null node are no nodes. Repeated rows count once; if they disagree, the
    smallest parent that names a node wins. An empty string is a node like any other.
    Other columns of ``rows`` are not read, so their names may clash with anything.
    """
    pairs = rows.select(F.col(f"`{node}`").alias("id"), F.col(f"`{parent}`").alias("parent")).where(F.col("id").isNotNull())
    ids = pairs.select(F.col("id").alias("parent")).distinct()
    known = pairs.where(F.col("parent").isNotNull()).distinct()
    known = lookup(known, ids, "parent", "left_semi", hot_keys(known, "parent"))
    return (
        pairs.select("id", F.lit(None).cast("string").alias("parent"))
        .unionByName(known)
        .groupBy("id")
        .agg(F.min("parent").alias("parent"))
    )


def hierarchy(rows: DataFrame, node: str = "stable_id", parent: str = "parent_id", with_path: bool = False) -> DataFrame:
    """Root and depth of every node: (id, root_id, depth[, path]).

    A node whose parent is null or names no node is a root: itself at depth 0. A node on a
    cycle or below one gets the smallest id on that cycle and depth -1 (path null).
    ``with_path`` adds the ids from the root down to the node, joined by "/": its size is
    the sum of all depths, which the result itself requires.

    Pointer doubling: every unresolved node holds the ancestor ``2^k`` levels up; a round
    joins these pointers with the table of nodes, which either resolves the node or doubles
    the jump. Depths of a tree have no gaps, so a round that resolves nothing proves that
    all remaining nodes reach no root. They are doubled on, carrying the smallest id of the
    nodes jumped over, until a jump is longer than any cycle can be. A table of trees of
    depth d takes log2(d) + 2 rounds. Each round is a table in the shared folder; the
    node side of each join has unique keys and hot pointers are looked up by broadcast,
    so a node with most rows as children is no hot spot.
    """
    spark = rows.sparkSession
    nil = F.lit(None).cast("string")
    own = F.col("id") if with_path else nil
    # One table per round with both the nodes it resolved (root_id set) and the rest: ptr is the
    # ancestor `jump` levels up, low the least id from the node to below ptr, path the ids from there.
    root = F.col("parent").isNull()
    last = Stored(
        parents(rows, node, parent).select(
            "id",
            F.col("parent").alias("ptr"),
            F.when(root, 0).otherwise(1).alias("jump"),
            F.col("id").alias("low"),
            own.alias("path"),
            F.when(root, F.col("id")).alias("root_id"),
        ),
        "tree",
    )
    done = [last]
    unresolved = lambda s: s.read().where(F.col("root_id").isNull())
    resolved = lambda s: s.read().where(F.col("root_id").isNotNull())
    theirs = [F.col("id").alias("ptr")] + [F.col(c).alias(f"{c}_") for c in ("ptr", "jump", "low", "path", "root_id")]

    left, rounds = unresolved(last).count(), 0
    while left:
        a = unresolved(last)
        there = a.select(*theirs)
        for s in done:
            there = there.unionByName(resolved(s).select(*theirs))
        joined = lookup(a, there, "ptr", "inner", hot_keys(a, "ptr") if left >= HOT_ROWS else None)
        last = Stored(
            joined.select(
                "id",
                F.col("ptr_").alias("ptr"),
                (F.col("jump") + F.col("jump_")).alias("jump"),
                F.least("low", "low_").alias("low"),
                (F.concat_ws(SEP, "path_", "path") if with_path else nil).alias("path"),
                F.col("root_id_").alias("root_id"),
            ),
            "tree",
        )
        done.append(last)
        rounds += 1
        now = unresolved(last).count()
        stuck, left = now == left, now
        if stuck:
            break
        if rounds % 4 == 0:
            free_shuffles(spark)

    out = resolved(done[0])
    for s in done[1:]:
        out = out.unionByName(resolved(s))
    out = out.select("id", "root_id", F.col("jump").alias("depth"), "path")
    if left:
        ring, spent = last, None
        while (1 << rounds) < left:  # until a jump is longer than any cycle of the remaining nodes
            a = unresolved(ring).select("id", "ptr", "low")
            there = a.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr_"), F.col("low").alias("low_"))
            joined = lookup(a, there, "ptr", "inner", hot_keys(a, "ptr") if left >= HOT_ROWS else None)
            ring = Stored(joined.select("id", F.col("ptr_").alias("ptr"), F.least("low", "low_").alias("low"), nil.alias("root_id")), "tree-ring")
            if spent:
                spent.drop()
            spent, rounds = ring, rounds + 1
        a = unresolved(ring)
        lows = a.select(F.col("id").alias("ptr"), F.col("low").alias("least"))
        joined = lookup(a.select("id", "ptr"), lows, "ptr", "inner", hot_keys(a, "ptr") if left >= HOT_ROWS else None)
        out = out.unionByName(joined.select("id", F.col("least").alias("root_id"), F.lit(-1).alias("depth"), nil.alias("path")))
    return out if with_path else out.drop("path")


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor, id, distance) for every node and each of its proper ancestors.

    Takes ``hierarchy(..., with_path=True)``; nodes on or below a cycle have no ancestors
    here. One row per pair is the result's own size; nothing is joined.
    """
    split = F.split(F.col("path"), SEP)
    return (
        paths.where(F.col("depth") > 0)
        .select("id", "depth", F.posexplode(split).alias("at", "ancestor"))
        .where(F.col("at") < F.col("depth"))
        .select("ancestor", "id", (F.col("depth") - F.col("at")).alias("distance"))
    )


def non_roots(rows: DataFrame) -> DataFrame:
    """(stable_id, root_id, depth) of the symbols that are not roots."""
    h = hierarchy(rows)
    return h.where(F.col("depth") != 0).select(F.col("id").alias("stable_id"), "root_id", "depth")
