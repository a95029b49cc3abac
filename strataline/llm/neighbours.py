"""Most similar vectors for every vector, by NN-descent (problem 5).

The neighbour graph starts from the leaves of a forest of random hyperplane trees and is
improved by joins of neighbours of neighbours; single queries are answered by greedy search
on it. Between tasks vectors travel as 8-bit codes; final similarities are computed from the
vectors as stored, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.skew import HOT_PARTS, HOT_ROWS, hot_keys, lookup
from strataline.session import Stored, free_shuffles, partitions

#: Rows in a leaf of a tree, on average; rows of a leaf that are compared with the others at a time.
LEAF, CAP = 256, 1024
#: Rows of a leaf that one task compares; all pairs of blocks of so many rows of a larger leaf are compared.
SPAN = 16_384
#: Trees at least; more as the collection grows (one per level).
TREES = 8
#: Neighbours kept in the graph, neighbours each node brings to a join from either direction,
#: neighbours a leaf contributes to one row, and rounds at most, if close neighbours are asked for ...
CLOSE = {"keep": 48, "join": 24, "per": 24, "rounds": 12}
#: ... and if neighbours of any similarity are.
ANY = {"keep": 64, "join": 32, "per": 32, "rounds": 12}
#: Similarity from which neighbours are close.
NEAR = 0.5
#: The graph also holds neighbours that are less similar than asked for by so much.
SLACK = 0.05
#: Neighbours of a leaf that may be less similar than asked for; they only lead the way, and only
#: if the angle to them is at most twice the one asked for.
LEAD = 4
#: Further rows with one and the same vector that are kept as its nearest.
COPIES = 6
#: Rows whose mean the trees' hyperplanes pass through.
FIT_ROWS = 10_000


def valid(vectors: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """(key, v): one usable vector per key.

    Null keys, null, too short, too long and all-zero vectors and vectors with a component
    that is null or not finite are left out. Repeated rows count once; of differing vectors
    of one key the smallest holds. Only the two columns are read.
    """
    v = F.transform(F.col(f"`{vec}`"), lambda x: x.cast("float"))
    good = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), v.alias("v")).where(good).groupBy("key").agg(F.min("v").alias("v"))


def _unit(col: pa.Array, dim: int) -> np.ndarray:
    flat = col.flatten() if isinstance(col, pa.ListArray) else col.combine_chunks().flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code(x: np.ndarray) -> list[bytes]:
    """Unit vectors as 8-bit integers after a 32-bit scale."""
    scale = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    raw = np.concatenate([scale[:, None].view(np.int8).reshape(len(x), 4), q], axis=1)
    return [r.tobytes() for r in raw]


def _decode(col) -> np.ndarray:
    raw = np.frombuffer(b"".join(col), np.int8).reshape(len(col), -1)
    scale = raw[:, :4].copy().view(np.float32)
    return raw[:, 4:].astype(np.float32) * scale


def _codes(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = _code(_unit(b.column(1), dim)) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code, pa.binary())], names=["id", "code"])

    return run


def _leaves(mean: np.ndarray, trees: int, depth: int, seed: int):
    """(leaf, id, code) of each row in every tree: the leaf is the signs of its projections."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((trees * depth, len(mean))).astype(np.float32)
    weights = (1 << np.arange(depth, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = _decode(b.column(1).to_pylist()) - mean
            bits = ((x @ planes.T) > 0).reshape(n, trees, depth)
            leaf = (bits * weights).sum(axis=2) + (np.arange(trees, dtype=np.int64) << depth)
            who = np.tile(np.arange(n), trees)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.T.ravel()), b.column(0).take(pa.array(who)), b.column(1).take(pa.array(who))], names=["leaf", "id", "code"])

    return run


def _sizes(leaves):
    """(leaf, n): how many rows of a batch are in each leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in leaves(batches):
            leaf, n = np.unique(b.column(0).to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n)], names=["leaf", "n"])

    return run


def _cells(codes: DataFrame, leaves, span: int) -> tuple[DataFrame, Stored]:
    """(leaf, id, code, far) of each row in every tree, and the leaves of more than ``span`` rows.

    Such a leaf is cut into blocks; every pair of blocks and every block is a leaf of its own
    (a cell), where ``far`` is 1 for the second block of a pair. Rows of the largest leaves meet
    the size of their leaf by broadcast, so a leaf that holds most rows is not gathered.
    """
    rows = codes.mapInArrow(leaves, "leaf long, id long, code binary")
    sizes = codes.mapInArrow(_sizes(leaves), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    large = Stored(sizes.where(F.col("n") > span), "large-leaves")
    if not large.count():
        return rows.withColumn("far", F.lit(0)), large
    n = large.read()
    hot = n.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "leaf").limit(HOT_PARTS * partitions(codes.sparkSession)).select("leaf")
    small = lookup(rows, n.select("leaf"), "leaf", "left_anti", hot).withColumn("far", F.lit(0))
    blocks = F.ceil(F.col("n") / span)
    cut = lookup(rows, n, "leaf", "inner", hot).withColumn("own", F.pmod(F.xxhash64("id"), blocks))
    cells = cut.withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select(
        F.xxhash64("leaf", F.least("own", "met"), F.greatest("own", "met")).alias("leaf"), "id", "code", (F.col("own") > F.col("met")).cast("int").alias("far")
    )
    return small.unionByName(cells), large


def _blocks(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[tuple[np.ndarray, list, list]]:
    """Runs of rows with one first column, in blocks of at most ``cap`` rows."""
    held: list[list] = [[], []]
    now = None
    for b in batches:
        key = b.column(0).to_numpy(zero_copy_only=False)
        cols = [b.column(i).to_pylist() for i in range(1, b.num_columns)]
        if len(held) != len(cols):
            held = [[] for _ in cols]
        cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)] if len(key) else [0]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if now is not None and key[s] != now and held[0]:
                yield now, *held
                held = [[] for _ in cols]
            now = key[s]
            while s < e:
                take = min(e, s + cap - len(held[0]))
                for h, c in zip(held, cols):
                    h += c[s:take]
                s = take
                if len(held[0]) >= cap:
                    yield now, *held
                    held = [[] for _ in cols]
    if held[0]:
        yield now, *held


_LIST = pa.list_(pa.struct([("s", pa.float32()), ("n", pa.int64())]))
_LIST_SQL = "array<struct<s:float,n:long>>"


def _lists(sim: np.ndarray, idx: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> pa.Array:
    """Arrow lists of (similarity, neighbour) from a matrix of picks."""
    lens = ok.sum(axis=1)
    offs = np.r_[0, np.cumsum(lens)].astype(np.int32)
    flat = pa.StructArray.from_arrays([pa.array(sim[ok].astype(np.float32)), pa.array(ids[idx[ok]])], names=["s", "n"])
    return pa.ListArray.from_arrays(pa.array(offs), flat)


def _within(per: int, least: float):
    """(id, near): the most similar rows of the same leaf, LEAD of them even if below ``least``."""
    asked = min(1.0, least + SLACK)
    lead = 2 * asked * asked - 1 if asked > 0 else -1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, codes, far in _blocks(batches, 1 << 62):
            if len(ids) < 2:
                continue
            ids, far = np.asarray(ids, np.int64), np.asarray(far, bool)
            x = _decode(codes)
            sides = [(~far, far), (far, ~far)] if far.any() and not far.all() else [(np.ones(len(ids), bool),) * 2]
            for mine, theirs in sides:
                rows, others = np.flatnonzero(mine), np.flatnonzero(theirs)
                k = min(per, len(others) - (len(sides) == 1))
                for at in range(0, len(rows), CAP):
                    who = rows[at : at + CAP]
                    s = x[who] @ x[others].T
                    if len(sides) == 1:
                        s[np.arange(len(who)), who] = -9
                    idx = np.argpartition(s, -k, axis=1)[:, -k:]
                    top = np.take_along_axis(s, idx, axis=1)
                    order = np.argsort(-top, axis=1, kind="stable")
                    idx, top = np.take_along_axis(idx, order, 1), np.take_along_axis(top, order, 1)
                    ok = (top >= least) | ((np.arange(k) < LEAD) & (top >= lead))
                    some = ok.any(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who[some]]), _lists(top[some], others[idx[some]], ids, ok[some])], names=["id", "near"])

    return run


def _join_kernel(least: float):
    """Neighbours of a node compared among themselves: better neighbours for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_out, sims_out, n_out, size = [], [], [], 0
        names = ["id", "n", "s"]

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids_out)), pa.array(np.concatenate(n_out)), pa.array(np.concatenate(sims_out))], names=names)

        for _, nodes, floors, codes in _blocks(batches, 1 << 16):
            if len(nodes) < 2:
                continue
            nodes = np.asarray(nodes, np.int64)
            x = _decode(codes)
            s = x @ x.T
            floor = np.maximum(np.asarray(floors, np.float32), least)
            r, c = np.nonzero((s > floor[:, None]) & (nodes[:, None] != nodes[None, :]))
            if len(r):
                ids_out.append(nodes[r])
                n_out.append(nodes[c])
                sims_out.append(s[r, c].astype(np.float32))
                size += len(r)
                if size > 200_000:
                    yield flush()
                    ids_out, sims_out, n_out, size = [], [], [], 0
        if size:
            yield flush()

    return run


def _best(lists, keep: int):
    """The ``keep`` most similar distinct neighbours of a list of (s, n)."""
    return F.slice(F.sort_array(F.array_distinct(lists), asc=False), 1, keep)


def graph(codes: DataFrame, n: int, mean: np.ndarray, least: float = -1.0, keep: int = 0, seed: int = 11, exact: bool = False) -> Stored:
    """(id, near): neighbour graph of ``codes`` (id, code), near descending by similarity.

    At least ``keep`` neighbours are kept. With ``exact`` all pairs of rows are compared, in
    blocks, and nothing needs to be joined. Rows without any neighbour have no row. The sizes
    are CLOSE or ANY, by ``least``. Only neighbours with a similarity of at least ``least`` are added after the start, so a
    caller who needs close neighbours only does not pay for improving distant ones. Rounds
    end early when fewer than one in a thousand rows change.

    Trees hold n log n rows. In a round each node brings ``join`` neighbours of either
    direction together, from the second round on only if one of them is new to it. A node that is everyone's neighbour keeps its ``join`` nearest
    (Spark limits the ranks before the shuffle), and its code is looked up by broadcast.
    """
    spark = codes.sparkSession
    parts = partitions(spark)
    size = CLOSE if least >= NEAR else ANY
    keep, join, rounds, per = max(keep, size["keep"]), size["join"], size["rounds"], max(size["per"], keep if exact else 0)
    depth = 0 if exact else max(0, math.ceil(math.log2(max(1, n / LEAF))))
    t = max(TREES, depth) if depth else 1
    rounds = rounds if depth else 0
    leaves, large = _cells(codes, _leaves(mean, t, depth, seed), SPAN)
    near = leaves.repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(_within(per, least), f"id long, near {_LIST_SQL}")
    now = Stored(near.groupBy("id").agg(_best(F.flatten(F.collect_list("near")), keep).alias("near")), "graph")
    large.drop()
    for r in range(rounds):
        free_shuffles(spark)
        g = now.read()
        new = F.lit(True) if r == 0 else F.array_contains("fresh", F.col("e.n"))
        fwd = g.select("*", F.explode(F.slice("near", 1, join)).alias("e")).select("id", F.col("e.n").alias("n"), F.col("e.s").alias("s"), new.alias("new"))
        w = Window.partitionBy("n").orderBy(F.desc("s"), "id")
        back = fwd.withColumn("r", F.row_number().over(w)).where(F.col("r") <= join).select(F.col("n").alias("id"), F.col("id").alias("n"), "new")
        both = fwd.select("id", "n", "new").unionByName(back)
        pairs = both.select("id", "n").unionByName(g.select("id", F.col("id").alias("n"))).distinct()
        if r:  # neighbours that have met before need not meet again
            pairs = pairs.join(both.where("new").select("id").distinct(), "id", "left_semi")
        floor = F.when(F.size("near") >= keep, F.col("near")[keep - 1]["s"]).otherwise(F.lit(-2.0).cast("float"))
        known = g.select(F.col("id").alias("n"), floor.alias("floor")).join(codes.withColumnRenamed("id", "n"), "n")
        met = lookup(pairs, known, "n", "inner", hot_keys(pairs, "n")).select("id", "n", "floor", "code")
        found = met.repartition(parts, "id").sortWithinPartitions("id").mapInArrow(_join_kernel(least), "id long, n long, s float")
        more = found.groupBy("id", "n").agg(F.max("s").alias("s")).groupBy("id").agg(F.collect_list(F.struct("s", "n")).alias("more"))
        merged = g.join(more, "id", "left").select(
            "id", F.when(F.col("more").isNull(), F.col("near")).otherwise(_by_node(F.concat("near", "more"), keep)).alias("near"), F.col("near").alias("was")
        )
        fresh = F.array_except(F.transform("near", lambda x: x["n"]), F.transform("was", lambda x: x["n"]))
        step = Stored(merged.select("id", "near", fresh.alias("fresh")), "graph")
        moved = step.read().where(F.size("fresh") > 0).count()
        now.drop()
        now = step
        if moved * 1000 < n:
            break
    free_shuffles(spark)
    return now


def _by_node(lists, keep: int):
    """As _best, where one neighbour may be listed with slightly different similarities."""
    rounded = F.transform(lists, lambda x: F.struct(F.round(x["s"], 5).cast("float").alias("s"), x["n"].alias("n")))
    return _best(rounded, keep)


class Collection:
    """Vectors prepared for search: distinct vectors with ids, codes, and who bears each."""

    def __init__(self, vectors: DataFrame, key: str, vec: str, dim: int):
        spark = vectors.sparkSession
        self.dim = dim
        rows = valid(vectors, key, vec, dim).withColumn("id", F.monotonically_increasing_id())
        rows = Stored(rows.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")}), "vectors")
        h = rows.read().select("key", "id", "h1", "h2")
        # exact copies of one vector are one node of the graph: the one with the smallest key
        several = h.groupBy("h1", "h2").agg(F.min(F.struct("key", "id")).alias("head"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
        several = Stored(several.select("h1", "h2", F.col("head.id").alias("head"), "copies"), "copied")
        self.vectors = rows
        if several.read().limit(1).count():
            tied = Stored(h.join(several.read(), ["h1", "h2"], "left").select("key", "id", F.coalesce("head", "id").alias("head"), F.coalesce("copies", F.lit(1)).alias("copies")), "hashed")
            self.members = tied.read().select(F.col("head").alias("id"), "key", "copies")
            self.heads = tied.read().where(F.col("id") == F.col("head")).select("id", "key", "copies")
            self.vectors = Stored(rows.read().join(self.heads.select("id"), "id", "left_semi").select("id", "v"), "nodes")
            rows.drop()
        else:
            self.members = None
            self.heads = h.select("id", "key", F.lit(1).alias("copies"))
        self.codes = Stored(self.vectors.read().select("id", "v").mapInArrow(_codes(dim), "id long, code binary"), "codes")
        self.n = self.codes.count()
        sample = self.codes.read().limit(FIT_ROWS).collect()
        self.mean = _decode([r["code"] for r in sample]).mean(axis=0) if sample else np.zeros(dim, np.float32)
        free_shuffles(spark)


def _exact(c: Collection, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with their cosine similarity from the vectors as stored."""
    v = c.vectors.read().select("id", "v")
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double")))
    one, two = v.select(F.col("id").alias("a"), F.col("v").alias("va")), v.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    with_a = lookup(pairs, one, "a", "inner", hot_keys(pairs, "a"))
    both = lookup(with_a, two, "b", "inner", hot_keys(pairs, "b"), once=True)
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return both.select("a", "b", (dot / (norm("va") * norm("vb"))).alias("sim"))


def neighbours(vectors: DataFrame, key: str, vec: str, dim: int, k: int = 5, least: float = -1.0, exact: bool = False) -> DataFrame:
    """(key, neighbour, sim): up to ``k`` most similar others of every key, at least ``least``.

    See ``valid`` for which rows take part. Similarity is the cosine, equal similarities are
    ordered by key. Keys with one and the same vector are each other's nearest (the COPIES
    smallest keys of a vector stand for all). Approximate; the README gives the recall for
    close neighbours, dense clusters and unrelated vectors. ``exact`` compares all pairs of
    rows instead, in blocks, at a cost that grows with the square of the collection.
    """
    c = Collection(vectors, key, vec, dim)
    g = graph(c.codes.read(), c.n, c.mean, least=least - SLACK, keep=2 * k, exact=exact)
    edges = g.read().select("id", F.explode("near").alias("e")).select(F.col("id").alias("a"), F.col("e.n").alias("b"), F.col("e.s").alias("s")).where(F.col("s") >= least - 0.03)
    und = Stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    sims = Stored(_exact(c, und.read()).where(F.col("sim") >= least), "sims")
    names = c.heads
    both = sims.read().unionByName(sims.read().select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    named = both.join(names.select(F.col("id").alias("b"), F.col("key").alias("nb")), "b")
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "nb")
    top = named.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("a", "b", "nb", "sim")
    if c.members is None:
        return top.join(names.select(F.col("id").alias("a"), "key"), "a").select("key", F.col("nb").alias("neighbour"), "sim")
    return _with_copies(c, top, k)


def _with_copies(c: Collection, top: DataFrame, k: int) -> DataFrame:
    """Neighbours of all keys, where some vectors are borne by several keys."""
    members = c.members
    # the smallest keys of each repeated vector, one minimum after the other: no group is gathered
    some = Stored(members.where(F.col("copies") > 1).select("id", "key"), "copies")
    rest, first = some.read(), None
    for _ in range(max(COPIES, k + 1)):
        m = Stored(rest.groupBy("id").agg(F.min("key").alias("key")), "copy")
        first = m.read() if first is None else first.unionByName(m.read())
        rest = rest.join(m.read().withColumnRenamed("key", "low"), "id").where(F.col("key") > F.col("low")).drop("low")
    single = c.heads.where(F.col("copies") == 1).select("id", "key")
    reps = Stored(first.unionByName(single).select(F.col("id").alias("b"), F.col("key").alias("nb")), "representatives")
    same = members.where(F.col("copies") > 1).select("id", "key").join(reps.read().withColumnRenamed("b", "id"), "id").where(F.col("key") != F.col("nb")).select("key", "nb", F.lit(1.0).alias("sim"))
    near = top.select("a", "b", "sim").join(reps.read(), "b").join(members.select(F.col("id").alias("a"), "key"), "a").select("key", "nb", "sim")
    w = Window.partitionBy("key").orderBy(F.desc("sim"), "nb")
    return same.unionByName(near).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("key", F.col("nb").alias("neighbour"), "sim")


def symbol_vectors(meta: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(stable_id, embedding) of the embedded symbols; several rows where embeddings repeat."""
    m = meta.select(F.col("symbol_stable_id").alias("stable_id"), "symbol_id").dropna(how="any").distinct()
    return m.join(embeddings.select("symbol_id", "embedding").where(F.col("embedding").isNotNull()), "symbol_id").select("stable_id", "embedding")


def similar_symbols(meta: DataFrame, embeddings: DataFrame, dim: int = 64, k: int = 5, least: float = 0.9) -> DataFrame:
    """(stable_id_a, stable_id_b, sim): pairs at least ``least`` similar, one in the other's top ``k``."""
    t = neighbours(symbol_vectors(meta, embeddings), "stable_id", "embedding", dim, k, least)
    return t.select(F.least("key", "neighbour").alias("stable_id_a"), F.greatest("key", "neighbour").alias("stable_id_b"), "sim").groupBy("stable_id_a", "stable_id_b").agg(F.max("sim").alias("sim"))


def _row_dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, n, s): similarity of the two codes of each row."""
    for b in batches:
        if b.num_rows:
            s = (_decode(b.column("qcode").to_pylist()) * _decode(b.column("code").to_pylist())).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("n"), pa.array(s.astype(np.float32))], names=["q", "n", "s"])


def search(c: Collection, g: Stored, queries: DataFrame, k: int = 5, beam: int = 24, rounds: int = 8, seed: int = 11) -> DataFrame:
    """(q, id, s): up to ``k`` most similar nodes of each query by greedy search on the graph.

    ``queries`` has (q, v): usable vectors with distinct ids. A query enters the graph at the
    best nodes of its leaves in the forest; each round expands the nodes of its beam that it
    has not expanded, until a round brings nothing into any beam. All queries advance
    together, one set of joins a round; a node in many beams is looked up by broadcast.
    """
    n_leaf = max(0, math.ceil(math.log2(max(1, c.n / LEAF))))
    trees = max(TREES, n_leaf) if n_leaf else 1
    q = Stored(queries.select(F.col("q").alias("id"), "v").mapInArrow(_codes(c.dim), "id long, code binary"), "queries")
    leaves = _leaves(c.mean, trees, n_leaf, seed)
    mine = q.read().mapInArrow(leaves, "leaf long, id long, code binary").select("leaf", F.col("id").alias("q"))
    theirs = c.codes.read().mapInArrow(leaves, "leaf long, id long, code binary").select("leaf", F.col("id").alias("n"))
    qcode = q.read().select(F.col("id").alias("q"), F.col("code").alias("qcode"))
    codes = c.codes.read().select(F.col("id").alias("n"), "code")
    w = Window.partitionBy("q").orderBy(F.desc("s"), "n")

    def scored(pairs: DataFrame) -> DataFrame:
        met = lookup(pairs, codes, "n", "inner", hot_keys(pairs, "n")).join(qcode, "q")
        return met.select("q", "n", "qcode", "code").mapInArrow(_row_dots, "q long, n long, s float")

    def cut(rows: DataFrame) -> DataFrame:
        return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= beam).drop("r")

    start = Stored(mine.join(theirs, "leaf").select("q", "n").distinct(), "entries")
    now = Stored(cut(scored(start.read())).withColumn("done", F.lit(False)), "beam")
    near = g.read().select(F.col("id").alias("n"), F.transform("near", lambda x: x["n"]).alias("next"))
    for _ in range(rounds):
        open_ = now.read().where(~F.col("done")).select("q", "n")
        step = lookup(open_, near, "n", "inner", hot_keys(open_, "n")).select("q", F.explode("next").alias("n")).distinct()
        new = scored(step.join(now.read().select("q", "n"), ["q", "n"], "left_anti")).withColumn("done", F.lit(False))
        held = Stored(cut(now.read().withColumn("done", F.lit(True)).unionByName(new)), "beam")
        left = held.read().where(~F.col("done")).limit(1).count()
        now.drop()
        now = held
        if not left:
            break
    return now.read().withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", F.col("n").alias("id"), "s")


def search_symbols(meta: DataFrame, embeddings: DataFrame, dim: int = 64, k: int = 5, least: float = 0.9, every: int = 100) -> DataFrame:
    """(query_id, symbol_id): the ``k`` nearest symbols, at least ``least`` similar, of every symbol whose id is
    divisible by ``every``, by greedy search on the graph of all symbols. Symbols with one and the same vector are
    each other's nearest, as in ``neighbours``."""
    known = meta.select("symbol_id").distinct()
    c = Collection(embeddings.join(known, "symbol_id", "left_semi"), "symbol_id", "embedding", dim)
    g = graph(c.codes.read(), c.n, c.mean, least=least - SLACK)
    names = c.heads.select("id", "key") if c.members is None else c.members.select("id", "key")
    asked = names.where(F.col("key") % every == 0)
    found = search(c, g, c.vectors.read().join(asked.select("id").distinct(), "id").select(F.col("id").alias("q"), "v"), k + 1)
    pairs = found.where(F.col("q") != F.col("id")).select(F.col("q").alias("a"), F.col("id").alias("b"))
    sims = _exact(c, pairs).where(F.col("sim") >= least).join(c.heads.select(F.col("id").alias("b"), F.col("key").alias("nb")), "b")
    top = sims.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "nb"))).where(F.col("r") <= k).select("a", "b", "nb", "sim")
    if c.members is None:
        return top.join(asked.withColumnRenamed("id", "a"), "a").select(F.col("key").alias("query_id"), F.col("nb").alias("symbol_id"))
    return _with_copies(c, top, k).where(F.col("key") % every == 0).select(F.col("key").alias("query_id"), F.col("neighbour").alias("symbol_id"))
