"""Graph traversal over DataFrames: reachability, paths, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.skew import hot_keys, lookup
from strataline.session import Stored, free_shuffles


#: Ways to one node on one level that are followed, for each path asked for.
WAYS = 4


def reach(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None, ready: bool = False) -> DataFrame:
    """(key, id, depth): nodes reachable from the seeds, with their least distance.

    ``seeds`` has (key, id) and optionally depth (default 0): each key is a traversal of its
    own. ``edges`` has (src, dst). Semi-naive: a round joins only the nodes found last,
    drops what its key has visited, and is stored, which cuts lineage and survives lost
    executors; the loop ends when nothing is new, so cycles end. Edges are made distinct and
    written once, whatever the number of rounds, unless they are ``ready``: a scan of a
    stored table.
    """
    spark = edges.sparkSession
    e = edges.select("src", "dst") if ready else Stored(edges.select("src", "dst").dropna(how="any").where(F.col("src") != F.col("dst")).distinct(), "edges").read()
    if "depth" not in seeds.columns:
        seeds = seeds.withColumn("depth", F.lit(0))
    start = seeds.groupBy("key", "id").agg(F.min("depth").cast("int").alias("depth"))
    first = Stored(start, "reach")
    span = first.read().agg(F.min("depth").alias("lo"), F.max("depth").alias("hi")).first()
    if span["lo"] is None:
        return first.read()
    level, late = span["lo"], span["hi"]
    found: list[Stored] = []
    while max_depth is None or level < max_depth:
        # nodes whose depth is `level`: seeds that start there, and what the last round found
        last = first.read().where(F.col("depth") == level).select("key", "id") if level <= late else None
        if found:
            new = found[-1].read().select("key", "id")
            last = new if last is None else last.unionByName(new).distinct()
        seen = first.read().where(F.col("depth") <= level + 1).select("key", "id") if level < late else first.read().select("key", "id")
        for s in found:
            seen = seen.unionByName(s.read().select("key", "id"))
        step = last.join(e.withColumnRenamed("src", "id"), "id").select("key", F.col("dst").alias("id")).distinct()
        new = Stored(step.join(seen, ["key", "id"], "left_anti").withColumn("depth", F.lit(level + 1).cast("int")), "reach", counted=True)
        level += 1
        if new.rows == 0 and level > late:
            new.drop()
            break
        found.append(new)
        if len(found) > 16:  # keep the plan small on long chains
            merged = found[0].read()
            for s in found[1:-1]:
                merged = merged.unionByName(s.read())
            found = [Stored(merged, "reach"), found[-1]]
            free_shuffles(spark)
    out = first.read()
    for s in found:
        out = out.unionByName(s.read())
    return out.groupBy("key", "id").agg(F.min("depth").alias("depth"))


def simple_paths(edges: DataFrame, source: str, target: str, max_paths: int = 5, max_depth: int = 10) -> DataFrame:
    """(path, length): shortest simple paths from ``source`` to ``target``.

    Paths grow level by level until at least ``max_paths`` are complete or ``max_depth``
    edges are reached; of the longest level the smallest paths by node ids are kept. Only
    nodes on some way to the target within the depth left are entered: the distances to the
    target are found first, so dead branches never grow. Of the ways to one node on one
    level the WAYS x ``max_paths`` smallest are kept, so a level has at most that many rows
    for each node. This is exact for the shortest paths, as a smaller way to a node makes a
    smaller path; where there are fewer of them than asked for, a longer path may be missed
    if all kept ways to one of its nodes cross the rest of it.
    """
    spark = edges.sparkSession
    e = Stored(edges.select("src", "dst").dropna(how="any").where(F.col("src") != F.col("dst")).distinct(), "edges")
    back = e.read().select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    goal = spark.createDataFrame([("t", target)], "key string, id string")
    dist = Stored(reach(goal, back, max_depth).select(F.col("id").alias("dst"), F.col("depth").alias("left")), "distance")
    paths = spark.createDataFrame([([source],)], "path array<string>")
    done: DataFrame | None = None
    have = 0
    for depth in range(1, max_depth + 1):
        tip = F.element_at("path", -1)
        step = (
            paths.withColumn("src", tip).join(e.read(), "src").where(~F.array_contains("path", F.col("dst")))
            .join(dist.read().where(F.col("left") <= max_depth - depth), "dst")
            .select(F.concat("path", F.array("dst")).alias("path"))
        )
        place = Window.partitionBy(F.element_at("path", -1)).orderBy("path")
        level = Stored(step.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= WAYS * max_paths).drop("nth"), "paths")
        hit = level.read().where(F.element_at("path", -1) == target)
        n = hit.count()
        if n:
            part = hit.orderBy("path").limit(max_paths - have).withColumn("length", F.lit(depth))
            done = part if done is None else done.unionByName(part)
            have += n
        paths = level.read().where(F.element_at("path", -1) != target)
        if have >= max_paths or level.count() == n:
            break
    return done if done is not None else spark.createDataFrame([], "path array<string>, length int")


def communities(weighted: DataFrame) -> DataFrame:
    """(id, label): communities of a weighted undirected graph (a, b, weight), by the Louvain method.

    Local moving until modularity no longer grows, then every community becomes one node,
    and again, until a level gains nothing. Nodes move side by side: in each round half of
    them, by hash, so that neighbours do not swap places for ever; of all rounds of a level
    the one of greatest modularity holds. Ties go to the smaller label, so the result does
    not depend on how rows are stored. A round aggregates (node, label) weights map-side and
    looks labels of hubs up by broadcast; the driver holds one number per round.
    """
    sym = weighted.select("a", "b", "weight").unionByName(weighted.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    g = Stored(sym.where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.sum("weight").alias("weight")), "community-edges")
    nodes = g.read().groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("k")).withColumn("inner", F.lit(0.0))
    nodes = Stored(nodes, "community-nodes")
    m2 = nodes.read().agg(F.sum("k")).first()[0]
    found = Stored(nodes.read().select("id", F.col("id").alias("label")), "communities")
    if not m2:
        return found.read()
    reached = -1.0
    while True:
        labels, quality = _local_moving(g.read(), nodes.read(), m2)
        if quality <= reached + 1e-7:
            return found.read()
        reached = quality
        at = labels.read()
        step = Stored(found.read().join(at.select(F.col("id").alias("label"), F.col("label").alias("next")), "label").select("id", F.col("next").alias("label")), "communities")
        found.drop()
        found = step
        ends = g.read().join(at.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(at.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
        merged = Stored(ends.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("weight").alias("weight")), "community-edges")
        own = nodes.read().join(at, "id").groupBy(F.col("label").alias("id")).agg(F.sum("k").alias("k"), F.sum("inner").alias("inner"))
        loops = merged.read().where(F.col("a") == F.col("b")).select(F.col("a").alias("id"), "weight")
        smaller = Stored(own.join(loops, "id", "left").select("id", "k", (F.col("inner") + F.coalesce("weight", F.lit(0.0))).alias("inner")), "community-nodes")
        between = Stored(merged.read().where(F.col("a") != F.col("b")), "community-edges")
        for t in (g, nodes, merged, labels):
            t.drop()
        g, nodes = between, smaller


def _local_moving(g: DataFrame, nodes: DataFrame, m2: float) -> tuple[Stored, float]:
    """Labels (id, label) of the nodes (id, k, inner) of a graph (a, b, weight, both ways), and their modularity."""
    hot = Stored(hot_keys(g, "b"), "hubs")

    def quality(lab: DataFrame) -> float:
        inside = lookup(g, lab.select(F.col("id").alias("b"), F.col("label").alias("y")), "b", "inner", hot.read()).join(lab.select(F.col("id").alias("a"), F.col("label").alias("x")), "a")
        w = inside.where(F.col("x") == F.col("y")).agg(F.sum("weight")).first()[0] or 0.0
        per = nodes.join(lab, "id").groupBy("label").agg(F.sum("k").alias("k"), F.sum("inner").alias("inner"))
        row = per.agg(F.sum("inner").alias("inner"), F.sum(F.pow(F.col("k") / m2, 2)).alias("square")).first()
        return round((w + row["inner"]) / m2 - row["square"], 9)

    now = Stored(nodes.select("id", F.col("id").alias("label")), "labels")
    best, top = now, quality(now.read())
    idle = r = 0
    while idle < 2:
        lab = now.read()
        total = nodes.join(lab, "id").groupBy("label").agg(F.sum("k").alias("total"))
        votes = lookup(g, lab.select(F.col("id").alias("b"), "label"), "b", "inner", hot.read()).select(F.col("a").alias("id"), "label", "weight")
        weights = votes.unionByName(lab.select("id", "label", F.lit(0.0).alias("weight"))).groupBy("id", "label").agg(F.sum("weight").alias("w"))
        own = nodes.select("id", "k").join(lab.withColumnRenamed("label", "mine"), "id")
        x = weights.join(total, "label").join(own, "id").withColumn("stays", F.col("label") == F.col("mine"))
        gain = F.round(F.col("w") - F.col("k") * (F.col("total") - F.when(F.col("stays"), F.col("k")).otherwise(0.0)) / m2, 9)
        pick = x.withColumn("gain", gain).groupBy("id", "mine").agg(
            F.min_by("label", F.struct(-F.col("gain"), F.col("label"))).alias("next"), F.max("gain").alias("most"), F.max(F.when(F.col("stays"), F.col("gain"))).alias("stay")
        )
        moves = (F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0) & (F.col("most") > F.col("stay"))
        step = Stored(pick.select("id", F.when(moves, F.col("next")).otherwise(F.col("mine")).alias("label")), "labels")
        q = quality(step.read())
        if now is not best:
            now.drop()
        if q > top + 1e-7:
            best.drop()
            best, top, idle = step, q, 0
        else:
            idle += 1
        now = step
        r += 1
    if now is not best:
        now.drop()
    hot.drop()
    return best, top


def modularity(weighted: DataFrame, labels: DataFrame) -> DataFrame:
    """(modularity) of a partition of a weighted undirected graph (a, b, weight)."""
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    x = weighted.join(la, "a").join(lb, "b")
    inside = x.groupBy("la").agg(F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0)).alias("w_in")).withColumnRenamed("la", "label")
    ends = x.select(F.col("la").alias("label"), "weight").unionByName(x.select(F.col("lb").alias("label"), "weight")).groupBy("label").agg(F.sum("weight").alias("deg"))
    per = ends.join(inside, "label", "left").na.fill(0, ["w_in"])
    m = per.agg((F.sum("deg") / 2).alias("m"))
    return per.crossJoin(F.broadcast(m)).agg(F.round(F.sum(F.col("w_in") / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), 2)), 6).alias("modularity"))


def conductance(weighted: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, members, conductance): weight leaving / (2 x internal + leaving) of each community."""
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    x = weighted.join(la, "a").join(lb, "b")
    out = F.col("la") != F.col("lb")
    parts = x.select(F.col("la").alias("label"), F.when(out, F.col("weight")).otherwise(0).alias("o"), F.when(~out, F.col("weight")).otherwise(0).alias("i")).unionByName(
        x.where(out).select(F.col("lb").alias("label"), F.col("weight").alias("o"), F.lit(0).alias("i"))
    )
    agg = parts.groupBy("label").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    total = 2 * F.col("i") + F.col("o")
    return n.join(agg, "label", "left").select("label", "members", F.round(F.coalesce(F.when(total > 0, F.col("o") / total), F.lit(0.0)), 6).alias("conductance"))
