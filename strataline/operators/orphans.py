"""References to records that do not exist, with composite keys and partial nulls."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators.skew import hot_keys, lookup

MATCH = ("simple", "partial", "full")


def orphans(
    refs: DataFrame,
    parents: DataFrame,
    keys: list[tuple[str, str]],
    match: str = "simple",
    salt_hot: bool = True,
) -> DataFrame:
    """Rows of ``refs`` whose reference names no row of ``parents``; all columns kept.

    ``keys`` pairs each referring column with the column it refers to. References are
    grouped by their null mask (which key columns are null); each mask is anti-joined on
    its non-null columns only. The masks decide by the declared SQL match semantics:

    * ``simple``: any null in the key means the row refers to nothing and is no orphan.
    * ``partial``: the non-null columns must occur together in some parent row.
    * ``full``: all null refers to nothing; some but not all null is always an orphan.

    A reference with all columns null is never an orphan. Empty strings are values; filter
    them before the call where they mean "nothing". Repeated rows of ``refs`` stay repeated,
    repeated parents count once, parent rows with a null in a compared column match nothing.
    With no parents every (non-null) reference is an orphan; with no refs the result is
    empty. ``parents`` may have columns named like those of ``refs``: only the key
    columns are read. With ``salt_hot``, keys (of one column or several) that hold a large
    share of the references are looked up by broadcast of their (bounded number of) parent
    rows, so no task gets all rows of a hot key.
    """
    if match not in MATCH:
        raise ValueError(f"match must be one of {MATCH}")
    if not keys:
        raise ValueError("keys is empty")
    ref_cols = [r for r, _ in keys]
    clean = parents.select(*[F.col(f"`{p}`").alias(f"__k{i}") for i, (_, p) in enumerate(keys)])
    tagged = refs.withColumns({f"__k{i}": F.col(f"`{r}`") for i, r in enumerate(ref_cols)})
    nullable = [refs.schema[r].nullable for r in ref_cols]

    parts = []
    for mask in product((False, True), repeat=len(keys)):  # True: the column is null
        if all(mask) or any(m and not n for m, n in zip(mask, nullable)):
            continue
        here = tagged
        for i, m in enumerate(mask):
            c = F.col(f"__k{i}")
            here = here.where(c.isNull() if m else c.isNotNull())
        if any(mask) and match == "simple":
            continue
        if any(mask) and match == "full":
            parts.append(here)
            continue
        on = [f"__k{i}" for i, m in enumerate(mask) if not m]
        there = clean.select(*on).dropna(how="any").distinct()
        if len(on) > 1:  # all compared columns as one key
            whole = F.struct(*on).alias("__key")
            here, there, on = here.select("*", whole), there.select(whole), ["__key"]
        parts.append(lookup(here, there, on[0], "left_anti", hot_keys(here, on[0]) if salt_hot else None).select(*tagged.columns))
    out = reduce(DataFrame.unionByName, parts) if parts else tagged.limit(0)
    return out.select(*refs.columns)


def ends(edges: DataFrame) -> DataFrame:
    """Both ends of each edge as references: (edge_id, missing_end, ref, file_id).

    Null and empty ends refer to nothing and are left out.
    """
    pair = F.array(
        F.struct(F.lit("source").alias("missing_end"), F.col("source_id").alias("ref")),
        F.struct(F.lit("target").alias("missing_end"), F.col("target_id").alias("ref")),
    )
    return (
        edges.select(F.col("id").alias("edge_id"), "file_id", F.explode(pair).alias("e"))
        .select("edge_id", "file_id", "e.missing_end", "e.ref")
        .where(F.col("ref").isNotNull() & (F.col("ref") != ""))
    )


def missing_ends(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Ends of ``edges`` that name no ``stable_id`` of ``symbols``: (edge_id, missing_end, file_id).

    Compared as stored; a symbol counts wherever and however often its row stands.
    """
    return orphans(ends(edges), symbols, [("ref", "stable_id")]).drop("ref")


def misplaced(edges: DataFrame, symbols: DataFrame, match: str = "simple") -> DataFrame:
    """(edge_id, nulls): edges whose file holds no symbol with the id of their source.

    The composite reference (file_id, source_id) of an edge names (file_id, stable_id) of a
    symbol; an edge across files has a null file_id, and an empty source refers to nothing
    and counts as null. ``nulls`` is the null mask of the reference, by column.
    """
    refs = edges.select(F.col("id").alias("edge_id"), "file_id", F.nullif("source_id", F.lit("")).alias("source_id"))
    found = orphans(refs, symbols, [("file_id", "file_id"), ("source_id", "stable_id")], match)
    mark = lambda c: F.when(F.col(c).isNull(), "-").otherwise("x")
    return found.select("edge_id", F.concat(mark("file_id"), mark("source_id")).alias("nulls"))


def reference_states(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(missing_end, month, state, ends): ends of edges that had no symbol when their edge was indexed.

    ``missing``: no symbol has the id; ``later``: the first file with such a symbol was
    indexed after the edge's file, so the reference was an orphan until then. Ends of edges
    without a known file are compared with no time and can only be missing. Counted per
    month of ``indexed_at`` of the edge's file.
    """
    when = files.groupBy(F.col("id").alias("file_id")).agg(F.max("indexed_at").alias("indexed_at"))
    first = symbols.select(F.col("stable_id").alias("ref"), "file_id").where(F.col("ref").isNotNull()).join(when, "file_id", "left")
    first = first.groupBy("ref").agg(F.min("indexed_at").alias("first"))
    e = ends(edges)
    known = lookup(e, first.withColumn("known", F.lit(True)), "ref", "left", hot_keys(e, "ref"))
    timed = lookup(known, when, "file_id", "left", None)
    state = F.when(F.col("known").isNull(), "missing").when(F.col("first") > F.col("indexed_at"), "later")
    month = F.date_format(F.timestamp_millis("indexed_at"), "yyyy-MM")
    return timed.withColumn("state", state).where(F.col("state").isNotNull()).groupBy("missing_end", month.alias("month"), "state").agg(F.count(F.lit(1)).alias("ends"))


def missing_ends_by_month(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Orphan ends counted per end and per month of ``indexed_at`` of the edge's file.

    An edge without a file, or whose file is not in ``files``, counts under month null.
    """
    month = F.date_format(F.timestamp_millis("indexed_at"), "yyyy-MM")
    when = files.groupBy(F.col("id").alias("file_id")).agg(F.max("indexed_at").alias("indexed_at"))
    per_file = missing_ends(edges, symbols).groupBy("missing_end", "file_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_file.join(when.select("file_id", month.alias("month")), "file_id", "left")
        .groupBy("missing_end", "month")
        .agg(F.sum("n").alias("orphans"))
    )
