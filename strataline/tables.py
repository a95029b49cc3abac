"""The tables of one data directory in their current state."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators.skew import hot_keys, lookup
from strataline.session import Stored, fingerprint, table

_views: dict[tuple[str, str, str], tuple[str, Stored]] = {}


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Of the rows of each key the one last in ``order``: upsert on read, combined map-side."""
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("__k")).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


@dataclass
class Tables:
    """Current views: files by path, symbols by stable_id, edges without repeated rows.

    A view is computed once per application and state of its tables, and stored in the
    shared folder as Parquet; queries therefore read only the columns they need and push
    their filters to the scan. It is computed anew when files of its tables change.
    """

    spark: SparkSession
    dir: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def _view(self, name: str, sources: tuple[str, ...], build) -> DataFrame:
        state = fingerprint(self.spark, *[f"{self.dir}/{x}.parquet" for x in sources])
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _views or _views[key][0] != state:
            if key in _views:
                _views[key][1].drop()
            _views[key] = (state, Stored(build(), f"view-{name}", kept=True))
        return _views[key][1].read()

    @cached_property
    def files(self) -> DataFrame:
        return self._view("files", ("files",), lambda: latest(self.raw("files"), "path", "indexed_at", "id"))

    @cached_property
    def symbols(self) -> DataFrame:
        return self._view("symbols", ("symbols",), lambda: latest(self.raw("symbols"), "stable_id", "id").sortWithinPartitions("name"))

    @cached_property
    def edges(self) -> DataFrame:
        cols = ["source_id", "target_id", "kind", "file_id", "line", "col", "confidence"]
        return self._view("edges", ("edges",), lambda: self.raw("edges").groupBy(*cols).agg(F.min("id").alias("id")).sortWithinPartitions("kind", "target_id"))

    @cached_property
    def commits(self) -> DataFrame:
        return self._view("commits", ("commits",), lambda: self.raw("commits").distinct())

    @cached_property
    def changes(self) -> DataFrame:
        """Changed paths, once per commit and path."""
        return self._view("changes", ("file_changes",), lambda: self.raw("file_changes").select("commit_hash", "file_path", "status", "rename_from").distinct())

    @cached_property
    def placed(self) -> DataFrame:
        """Symbols with the path and test flag of their file."""

        def build() -> DataFrame:
            s = self.symbols
            f = self.files.select(F.col("id").alias("file_id"), "path", "is_test")
            return lookup(s, f, "file_id", "inner", hot_keys(s, "file_id")).sortWithinPartitions("name")

        return self._view("placed", ("symbols", "files"), build)

    @cached_property
    def linked(self) -> DataFrame:
        """Edges whose ends both are symbols, with file, project and test flag of each end.

        A symbol that a large share of the edges names is looked up by broadcast.
        """

        def end(e: DataFrame, side: str) -> DataFrame:
            key = f"{side}_id"
            p = self.placed.select(
                F.col("stable_id").alias(key), F.col("file_id").alias(f"{side}_file_id"), F.substring_index("path", "/", 1).alias(f"{side}_project"), F.col("is_test").alias(f"{side}_test")
            )
            return lookup(e, p, key, "inner", hot_keys(e, key))

        def build() -> DataFrame:
            half = Stored(end(self.edges, "target"), "half-linked")
            return end(half.read(), "source").sortWithinPartitions("kind")

        return self._view("linked", ("edges", "symbols", "files"), build)

    @cached_property
    def steps(self) -> DataFrame:
        """(source_id, target_id, kind): edges between different nodes, for walks; each once."""
        cols = ["source_id", "target_id", "kind"]
        build = lambda: self.edges.select(*cols).dropna(how="any").where(F.col("source_id") != F.col("target_id")).distinct().sortWithinPartitions("kind")
        return self._view("steps", ("edges",), build)

    @cached_property
    def imports(self) -> DataFrame:
        """(source_file_id, target_file_id): files that use symbols of another file."""
        pair = ["source_file_id", "target_file_id"]
        build = lambda: self.linked.where((F.col("kind") != "contains") & (F.col(pair[0]) != F.col(pair[1]))).select(*pair).distinct()
        return self._view("imports", ("edges", "symbols", "files"), build)


#: The same views for the oracle.
SQL = """
fc AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, id DESC) AS rn FROM files) WHERE rn = 1),
sc AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY stable_id ORDER BY id DESC) AS rn FROM symbols) WHERE rn = 1),
ec AS (SELECT source_id, target_id, kind, file_id, line, col, confidence, min(id) AS id FROM edges GROUP BY ALL),
cc AS (SELECT DISTINCT * FROM commits),
ch AS (SELECT DISTINCT commit_hash, file_path, status, rename_from FROM file_changes),
sf AS (SELECT s.*, f.path, f.is_test FROM sc s JOIN fc f ON f.id = s.file_id),
im AS (SELECT DISTINCT a.file_id AS source_file_id, b.file_id AS target_file_id FROM ec e JOIN sc a ON a.stable_id = e.source_id
       JOIN sc b ON b.stable_id = e.target_id WHERE e.kind <> 'contains' AND a.file_id <> b.file_id),
bp AS (SELECT split_part(path, '/', 1) AS project FROM fc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
nm AS (SELECT name, row_number() OVER (ORDER BY n DESC, name) AS nth FROM (SELECT name, count(*) AS n FROM sf WHERE NOT is_test AND kind IN ('function', 'method') GROUP BY 1) ORDER BY n DESC, name LIMIT 2),
pn AS (SELECT regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '') AS file, name FROM sf WHERE NOT is_test AND kind IN ('function', 'method') AND name = (SELECT name FROM nm WHERE nth = 1) ORDER BY stable_id LIMIT 1)
"""


def with_views(sql: str, recursive: bool = False) -> str:
    """An oracle query over the current views; ``sql`` may start with further CTEs."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = sql.strip()
    return head + SQL.strip() + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)
