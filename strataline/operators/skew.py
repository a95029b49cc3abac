"""Equi-joins against a table with unique keys, safe for hot keys on the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.session import partitions

#: A key is hot when it holds more than 1/(HOT_PARTS x shuffle partitions) of the rows,
#: so there are at most HOT_PARTS x shuffle partitions hot keys: a proven bound.
HOT_PARTS = 4
#: ... and at least this many rows: tables with fewer rows have no hot key.
HOT_ROWS = 10_000


def hot_keys(left: DataFrame, key: str, least: int = HOT_ROWS) -> DataFrame:
    """Keys of ``left`` that hold more than their share of the rows (column ``key``).

    Counts are combined map-side, so the shuffle moves distinct keys, not rows.
    ``least`` keeps keys of small tables from counting as hot. The result has at most
    HOT_PARTS x shuffle partitions rows whatever the size of ``left``.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    most = HOT_PARTS * partitions(left.sparkSession)
    # orderBy+limit runs as a top-k per task; the k largest counts contain every hot key
    return counts.where(F.col("__n") >= least).orderBy(F.desc("__n"), key).limit(most).select(key)


def lookup(left: DataFrame, right: DataFrame, key: str, how: str, hot: DataFrame | None, once: bool = False) -> DataFrame:
    """``left`` join ``right`` on ``key`` where ``right`` has each key at most once.

    ``how`` is inner, left, left_semi or left_anti. With ``hot`` (from ``hot_keys``) the
    hot keys' rows are joined by broadcasting their at most |hot| rows of ``right``, and
    stay where they are; only the rest is shuffled. Null keys match nothing and are kept
    by left and left_anti. ``left`` is evaluated twice, which suits a stored table; with
    ``once`` it is evaluated once: the hot rows are shuffled too, but spread over all tasks,
    and each task gets the hot keys' rows of ``right``.
    """
    if hot is None:
        return left.join(right, key, how)
    if once:
        most = partitions(left.sparkSession)
        mark = F.broadcast(hot.withColumn("__hot", F.lit(True)))
        is_hot = F.col("__hot").isNotNull()
        spread = left.join(mark, key, "left").withColumn("__at", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(most)).cast("int")).otherwise(0)).drop("__hot")
        many = F.when(is_hot, F.sequence(F.lit(0), F.lit(most - 1))).otherwise(F.array(F.lit(0)))
        there = right.join(mark, key, "left").withColumn("__at", F.explode(many)).drop("__hot")
        return spread.join(there, [key, "__at"], how).drop("__at")
    small = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    tagged = left.join(small, key, "left")
    cold = tagged.where(F.col("__hot").isNull()).drop("__hot").join(right, key, how)
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    warm = tagged.where(F.col("__hot")).drop("__hot").join(few, key, how)
    return cold.unionByName(warm)


def pairs_within(rows: DataFrame, key: str) -> DataFrame:
    """All ordered pairs of rows with one ``key``: (key, every other column as c_a and as c_b).

    A row is paired with itself too. Of a hot key one side is spread over all tasks by its
    hash and the other side is sent to each, so no task makes all pairs of the key. Null
    keys have no pairs.
    """
    most = partitions(rows.sparkSession)
    others = [c for c in rows.columns if c != key]
    hot = F.broadcast(hot_keys(rows, key).withColumn("__hot", F.lit(True)))
    tagged = rows.join(hot, key, "left")
    is_hot = F.col("__hot").isNotNull()
    a = tagged.withColumn("__at", F.when(is_hot, F.pmod(F.xxhash64(*others), F.lit(most)).cast("int")).otherwise(0)).drop("__hot")
    spread = F.when(is_hot, F.sequence(F.lit(0), F.lit(most - 1))).otherwise(F.array(F.lit(0)))
    b = tagged.withColumn("__at", F.explode(spread)).drop("__hot")
    return a.withColumnsRenamed({c: f"{c}_a" for c in others}).join(b.withColumnsRenamed({c: f"{c}_b" for c in others}), [key, "__at"]).drop("__at")
