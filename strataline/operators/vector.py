"""Exact vector search of a stated query set, or of all rows, against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block of the collection, of one block of queries.
ROWS, QUERIES = 20_000, 1_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def search(queries: DataFrame, rows: DataFrame, k: int = 5, metric: str = "cosine") -> DataFrame:
    """(query_id, id, score): the ``k`` best rows of every query; the query's own id is left out.

    Both tables have (id long, v array of one length, not all zero). score is the cosine, or
    with ``metric`` l2 one minus the distance of the unit vectors. Ties go to the smaller
    id. Blocks of queries meet blocks of rows; each pair is one matrix product that gives at most
    ``k`` rows a query, so only those are shuffled.
    """
    nq, nr = max(1, -(-queries.count() // QUERIES)), max(1, -(-rows.count() // ROWS))
    q = queries.select(F.col("id").alias("qid"), "v", F.pmod(F.xxhash64("id"), F.lit(nq)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("rb"))
    r = rows.select(F.col("id").alias("rid"), F.col("v").alias("rv"), F.pmod(F.xxhash64("id"), F.lit(nr)).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))

    def unit(col: pd.Series) -> np.ndarray:
        x = np.stack([np.asarray(v, np.float64) for v in col])
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        b = b.sort_values("rid", kind="stable")
        s = unit(a["v"]) @ unit(b["rv"]).T
        if metric == "l2":
            s = 1 - np.sqrt(np.maximum(2 - 2 * s, 0))
        ids, qids = b["rid"].to_numpy(), a["qid"].to_numpy()
        s[qids[:, None] == ids[None, :]] = -np.inf
        s = np.round(s, 9)
        n = min(k, s.shape[1])
        top = np.argsort(-s, axis=1, kind="stable")[:, :n]
        out = pd.DataFrame({"query_id": np.repeat(qids, n), "id": ids[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()})
        return out[np.isfinite(out["score"])]

    cells = q.groupBy("rb", "qb").cogroup(r.groupBy("rb", "qb")).applyInPandas(cell, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return cells.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def close(rows: DataFrame, k: int = 5, least: float = 0.92, metric: str = "cosine") -> DataFrame:
    """(query_id, id, score): the ``k`` best others of every row, with a score of at least ``least``.

    As ``search`` with all rows as queries, and as exact: blocks of ROWS rows meet each other,
    products in single precision with a margin name the candidates, double precision decides.
    """
    nb = max(1, -(-rows.count() // ROWS))
    own, each = F.pmod(F.xxhash64("id"), F.lit(nb)), F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))
    q = rows.select(F.col("id").alias("qid"), "v", own.alias("qb"), each.alias("rb"))
    r = rows.select(F.col("id").alias("rid"), F.col("v").alias("rv"), own.alias("rb"), each.alias("qb"))
    bound = (1 - (1 - least) ** 2 / 2 if metric == "l2" else least) - 1e-4

    def unit(col: pd.Series) -> np.ndarray:
        x = np.stack([np.asarray(v, np.float64) for v in col])
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "id": np.empty(0, np.int64), "score": np.empty(0)})]
        if not len(a) or not len(b):
            return out[0]
        x, y, qids, ids = unit(a["v"]), unit(b["rv"]), a["qid"].to_numpy(), b["rid"].to_numpy()
        x4, y4 = x.astype(np.float32), y.astype(np.float32).T
        step = QUERIES // 4
        for at in range(0, len(x), step):
            i, j = np.nonzero(x4[at : at + step] @ y4 >= bound)
            if len(i) > 100_000:
                s = (x[at : at + step] @ y.T)[i, j]
            else:
                s = (x[at + i] * y[j]).sum(axis=1)
            s = np.round(1 - np.sqrt(np.maximum(2 - 2 * s, 0)) if metric == "l2" else s, 9)
            ok = (s >= least) & (qids[at + i] != ids[j])
            t = pd.DataFrame({"query_id": qids[at + i[ok]], "id": ids[j[ok]], "score": s[ok]})
            out.append(t.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k))
        return pd.concat(out)

    cells = q.groupBy("rb", "qb").cogroup(r.groupBy("rb", "qb")).applyInPandas(cell, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return cells.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
