"""Items that appear together more often than chance, by a blocked Gram matrix (problem 2).

The Gram matrix X'X of the binary basket-by-item matrix X is computed block by block. Items
are numbered in the order of their names within their group, so items that go together tend
to share a block; a basket is one sparse row, cut into the slices of its item blocks. Every
pair of blocks that some basket touches is a cell of the block matrix: the slices of both
blocks meet there, record block by record block, their transpose-products are summed, and
the sums of all record blocks are added up. A basket of any size is cut the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.skew import hot_keys, lookup
from strataline.session import Stored, partitions

#: Items of one block; any value gives the same result.
BLOCK = 2048
#: Entries of X in one record block of a pair of item blocks; any value gives the same result.
ENTRIES = 2_000_000
#: Cells expanded before they are summed up.
FLUSH = 4_000_000


class _Cells:
    """The transpose-product of one pair of item blocks, summed over slices."""

    def __init__(self, width: int, same: bool):
        self.width, self.same = width, same
        self.flat: list[np.ndarray] = []
        self.size = 0
        self.sums: np.ndarray | None = None

    def add(self, vi: np.ndarray, oi: np.ndarray, vj: np.ndarray, oj: np.ndarray) -> None:
        """Add the products of slices in CSR form: values and offsets of both sides."""
        ki, kj = np.diff(oi), np.diff(oj)
        code = ki.astype(np.int64) << 32 | kj
        for c in np.unique(code):
            rows = np.flatnonzero(code == c)
            a, b = int(c) >> 32, int(c) & 0xFFFFFFFF
            if not a * b:
                continue
            if a * b * 64 > self.width * self.width:  # many cells a row: the dense product multiplies less
                for at in range(0, len(rows), 1024):
                    some = rows[at : at + 1024]
                    self._dense(_gather(vi, oi, some, a), _gather(vj, oj, some, b))
                continue
            step = max(1, FLUSH // (a * b))
            for at in range(0, len(rows), step):
                x = _gather(vi, oi, rows[at : at + step], a).astype(np.int64) * self.width
                if self.same:
                    u, v = np.triu_indices(a, 1)
                    cells = x[:, u] + x[:, v] // self.width
                else:
                    cells = x[:, :, None] + _gather(vj, oj, rows[at : at + step], b)[:, None, :]
                self.flat.append(cells.ravel())
                self.size += cells.size
                if self.size >= FLUSH:
                    self._fold()

    def _dense(self, x: np.ndarray, y: np.ndarray) -> None:
        n = np.arange(len(x))[:, None]
        one, two = np.zeros((len(x), self.width), np.float32), np.zeros((len(x), self.width), np.float32)
        one[n, x] = 1
        two[n, y] = 1
        self._fold()
        if self.sums is None:
            self.sums = np.zeros(self.width * self.width, np.int64)
        self.sums += (one.T @ two).ravel().astype(np.int64)

    def _fold(self) -> None:
        if self.size:
            if self.sums is None:
                self.sums = np.zeros(self.width * self.width, np.int64)
            self.sums += np.bincount(np.concatenate(self.flat), minlength=self.width * self.width)
            self.flat, self.size = [], 0

    def done(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, n) within the blocks; i < j where both are one block."""
        if self.sums is None:
            at, n = np.unique(np.concatenate(self.flat), return_counts=True) if self.flat else (np.zeros(0, np.int64),) * 2
        else:
            self._fold()
            at = np.flatnonzero(self.sums)
            n = self.sums[at]
        i, j = at // self.width, at % self.width
        if self.same:
            up = i < j
            i, j, n = i[up], j[up], n[up]
        return i, j, n


def _gather(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The slices of ``rows``, all of ``k`` values, as a matrix."""
    return values[offsets[rows][:, None] + np.arange(k)]


def _block_product(width: int):
    """(i, j, n) of runs of slices with one pair of blocks and one record block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, None
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def close() -> None:
            nonlocal held
            i, j, n = cell.done()
            out.append((i + key[0] * width, j + key[1] * width, n))
            held += len(n)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            i, j, n = (np.concatenate(c) for c in zip(*out))
            for at in range(0, len(n), 500_000):
                part = slice(at, at + 500_000)
                yield pa.RecordBatch.from_arrays([pa.array(i[part]), pa.array(j[part]), pa.array(n[part].astype(np.int64))], names=["i", "j", "n"])
            out.clear()
            held = 0

        for b in batches:
            if not b.num_rows:
                continue
            bi, bj, r = (b.column(c).to_numpy() for c in ("bi", "bj", "r"))
            left, right = b.column("left"), b.column("right")
            (vi, oi), (vj, oj) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (left, right))
            cuts = np.r_[0, np.flatnonzero((bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1]) | (r[1:] != r[:-1])) + 1, len(bi)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                now = (int(bi[s]), int(bj[s]), int(r[s]))
                if now != key:
                    if cell is not None:
                        close()
                        if held >= 100_000:
                            yield from flush()
                    key, cell = now, _Cells(width, now[0] == now[1])
                mine = slice(s, e + 1)
                cell.add(vi, oi[mine], *((vi, oi[mine]) if cell.same else (vj, oj[mine])))
        if cell is not None:
            close()
            yield from flush()

    return run


def together(rows: DataFrame, basket: str, item: str, group: str, least: int = 4, lift: float = 4.0, block: int = BLOCK, entries: int = ENTRIES) -> DataFrame:
    """(group, item_a, item_b, n, count_a, count_b, total, lift) of items that go together.

    A pair of different items of one group comes out when it shares ``n >= least`` baskets
    and ``n * total >= lift * count_a * count_b``, where counts are distinct baskets of the
    items and total the distinct baskets of the group. item_a < item_b by code point.
    Rows with a null basket, item or group are ignored; repeated rows count once; an empty
    table gives no pairs; other columns are not read. Ties at the bounds are in.

    An item in more than total / lift or in fewer than ``least`` baskets cannot be in a
    pair (n is at most the smaller count), so it is dropped before any product; this is
    exact and removes hot items. A basket of k items in m blocks is sent as m * k entries,
    not as k * k / 2 pairs. Block pairs with many entries are split into record blocks by
    the hash of the basket, so a group or a block with a third of all rows is many tasks.
    """
    spark = rows.sparkSession
    parts = partitions(spark)
    src = rows.select(F.col(f"`{group}`").alias("g"), F.col(f"`{basket}`").alias("basket"), F.col(f"`{item}`").alias("item"))
    cells = Stored(src.dropna(how="any").distinct(), "cells")
    x = cells.read()
    key = F.concat_ws("\x1f", "g", "item")
    totals = x.select("g", "basket").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("total"))
    items = (
        x.groupBy("g", "item").agg(F.count(F.lit(1)).alias("a"))
        .where(F.col("a") >= least)
        .join(totals, "g")
        .where(F.col("a") * F.lit(float(lift)) <= F.col("total"))
    )
    # numbers ascend with the name; a block is `block` numbers of one task, so a window of it is bounded
    numbered = items.repartitionByRange(parts, "g", "item").sortWithinPartitions("g", "item").withColumn("iid", F.monotonically_increasing_id())
    numbered = numbered.withColumns({"block": F.floor(F.col("iid") / block), "off": F.pmod("iid", F.lit(block)).cast("int"), "k": key})
    held = F.sum("a").over(Window.partitionBy("block"))
    info = Stored(numbered.withColumn("splits", F.ceil(held / entries)), "items")

    left = x.withColumn("k", key).drop("item")
    kept = lookup(left, info.read().select("k", "block", "off", "splits"), "k", "inner", hot_keys(left, "k"))
    slices = kept.groupBy("g", "basket", "block").agg(F.sort_array(F.collect_list("off")).alias("offs"), F.first("splits").alias("splits"))
    slices = Stored(slices.withColumn("h", F.xxhash64("g", "basket")), "slices")
    s = slices.read()
    one = s.where(F.size("offs") > 1).select(F.col("block").alias("bi"), F.col("block").alias("bj"), F.pmod("h", "splits").alias("r"), F.col("offs").alias("left"), F.array().cast("array<int>").alias("right"))
    side = lambda n: s.select("g", "basket", F.col("block").alias(f"b{n}"), F.col("splits").alias(f"s{n}"), F.col("offs").alias(n), *(["h"] if n == "i" else []))
    two = side("i").join(side("j"), ["g", "basket"]).where(F.col("bi") < F.col("bj"))
    two = two.select("bi", "bj", F.pmod("h", F.least("si", "sj")).alias("r"), F.col("i").alias("left"), F.col("j").alias("right"))
    met = one.unionByName(two).repartition(parts, "bi", "bj", "r").sortWithinPartitions("bi", "bj", "r")
    gram = met.mapInArrow(_block_product(block), "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).where(F.col("n") >= least)

    # counts against what the marginals let expect
    known = info.read()
    one = known.select(F.col("iid").alias("i"), F.col("a").alias("a_i"), "total", "g", F.col("item").alias("x_i"))
    two = known.select(F.col("iid").alias("j"), F.col("a").alias("a_j"), F.col("item").alias("x_j"))
    enough = F.col("n") * F.col("total") >= F.lit(float(lift)) * F.col("a_i") * F.col("a_j")
    return gram.join(one, "i").join(two, "j").where(enough).select(
        F.col("g").alias("group"), F.col("x_i").alias("item_a"), F.col("x_j").alias("item_b"), "n", F.col("a_i").alias("count_a"), F.col("a_j").alias("count_b"), "total",
        (F.col("n") * F.col("total") / (F.col("a_i") * F.col("a_j"))).alias("lift"),
    )


def files_together(file_changes: DataFrame, least: int = 4, lift: float = 4.0) -> DataFrame:
    """``together`` for the paths of each project that change in the same commits.

    The project is the path's text before its first slash; paths without one are left out.
    """
    rows = file_changes.where(F.col("file_path").contains("/")).select("commit_hash", "file_path", F.substring_index("file_path", "/", 1).alias("project"))
    return together(rows, "commit_hash", "file_path", "project", least, lift)
