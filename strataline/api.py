"""One object with the questions as methods, over the tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataline.operators import embedding, vector
from strataline.plans import git, risk, search, structure, surfaces, symbols
from strataline.tables import Tables


class Project:
    """Questions about one indexed data directory; every answer is a DataFrame."""

    def __init__(self, spark: SparkSession, data_dir: str):
        self.t = Tables(spark, data_dir)

    def _id(self, query: str) -> str:
        row = self.resolve(query).first()
        if row is None:
            raise LookupError(f"no symbol for {query!r}")
        return row["stable_id"]

    def status(self) -> DataFrame:
        return symbols.status(self.t)

    def resolve(self, query: str) -> DataFrame:
        return symbols.resolve(self.t, query)

    def search(self, query: str, exact: bool = False, **kw) -> DataFrame:
        return surfaces.find(self.t, query, exact, **kw)

    def search_everywhere(self, part: str, limit: int = 20) -> DataFrame:
        return surfaces.find_everywhere(self.t, part, limit)

    def ask(self, query: str, encoder=None, k: int = 10) -> DataFrame:
        """Symbols nearest in meaning to a text; without an encoder by hashed words."""
        return search.by_meaning(self.t, query, encoder or embedding.hashed(), k)

    def symbol_detail(self, query: str) -> dict[str, DataFrame]:
        return surfaces.symbol_detail(self.t, self._id(query))

    def file_article(self, path: str) -> dict[str, DataFrame]:
        return surfaces.file_article(self.t, path)

    def overview(self, query: str, depth: int = 2, limit: int = 10) -> dict[str, DataFrame]:
        return surfaces.overview(self.t, self._id(query), depth, limit)

    def dependency_rows(self, query: str, direction: str = "upstream") -> DataFrame:
        return surfaces.dependency_rows(self.t, self._id(query), direction)

    def dependency_stats(self, query: str, direction: str = "upstream", depth: int = 3) -> DataFrame:
        return surfaces.dependency_stats(self.t, self._id(query), direction, depth)

    def affected_tests(self, query: str, depth: int = 5) -> DataFrame:
        return surfaces.blast_tests(self.t, self._id(query), depth)

    def test_coverage(self, query: str) -> DataFrame:
        return surfaces.test_coverage(self.t, self._id(query))

    def api_trace(self, pattern: str, role: str | None = None) -> DataFrame:
        return surfaces.api_trace(self.t.raw("api_endpoints"), self.t, pattern, role)

    def show_channel(self, kind: str, value: str) -> DataFrame:
        return structure.show_channel(self.t.raw("channel_hits"), self.t, kind, value)

    def subsystem(self, name: str) -> DataFrame:
        return surfaces.subsystem_detail(self.t, name)

    def subsystem_neighbours(self, name: str) -> DataFrame:
        return surfaces.subsystem_neighbours(self.t, name)

    def symbol_subsystem(self, query: str) -> DataFrame:
        return surfaces.symbol_subsystem(self.t, self._id(query))

    def used_elsewhere(self, project: str, query: str, depth: int = 2) -> DataFrame:
        return surfaces.fan_out(self.t, surfaces.project_edges(self.t), project, self._id(query), depth)

    def search_content(self, literal: str, **kw) -> DataFrame:
        return search.content(self.t, literal, **kw)

    def semantic_search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Nearest symbols of query vectors (id, v)."""
        return vector.search(queries, search.vectors(self.t), k)

    def files(self, include_tests: bool = True) -> DataFrame:
        return symbols.files_listing(self.t, include_tests)

    def file_symbols(self, path: str) -> DataFrame:
        return symbols.file_outline(self.t).where(symbols.F.col("path") == path)

    def top_exported(self, limit: int = 8) -> DataFrame:
        return symbols.top_exported(self.t, limit)

    def call_sites(self, query: str, inbound: bool = True, kind: str | None = None) -> DataFrame:
        return symbols.call_sites(self.t, inbound, kind).where(symbols.F.col("stable_id") == self._id(query))

    def deps(self, query: str, direction: str = "upstream", depth: int = 3) -> DataFrame:
        return risk.dependencies(self.t, self._id(query), direction, depth)

    def blast(self, query: str, depth: int = 5, include_tests: bool = True) -> DataFrame:
        return risk.blast_radius(self.t, self._id(query), depth, include_tests)

    def trace(self, source: str, target: str, **kw) -> DataFrame:
        return risk.trace(self.t, self._id(source), self._id(target), **kw)

    def dead_code(self, **kw) -> DataFrame:
        return risk.dead_code(self.t, **kw)

    def internal_only(self, within: str) -> DataFrame:
        return risk.internal_only(self.t, within)

    def test_links(self) -> DataFrame:
        return risk.test_links(self.t)

    def untested_symbols(self) -> DataFrame:
        return risk.untested(self.t)

    def hotspots(self, **kw) -> DataFrame:
        return risk.hotspots(self.t, **kw)

    def hot_fragile(self, **kw) -> DataFrame:
        return risk.hot_fragile(self.t, **kw)

    def flows(self, depth: int = 5) -> DataFrame:
        return risk.flows(self.t, depth)

    def duplicates(self, **kw) -> DataFrame:
        return search.duplicates(self.t, **kw)

    def churn(self, **kw) -> DataFrame:
        return git.churn(self.t, **kw)

    def file_history(self, path: str) -> DataFrame:
        return git.file_history(self.t, path)

    def contributors(self, per_file: bool = False) -> DataFrame:
        return git.contributors(self.t, per_file)

    def last_changed(self) -> DataFrame:
        return git.last_changed(self.t)

    def co_change(self, **kw) -> DataFrame:
        return git.co_change(self.t, **kw)

    def subsystems(self) -> DataFrame:
        return structure.subsystem_summary(self.t)

    def channels(self) -> DataFrame:
        return structure.channels(self.t)

    def project_links(self) -> DataFrame:
        return structure.project_links(self.t)
