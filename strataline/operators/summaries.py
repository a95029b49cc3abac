"""Summaries of symbols by a pluggable provider, made again only where the source changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[str], "str | None"]


def prompt(kind, name, path, source):
    """The question put to a provider, as a column."""
    return F.concat_ws("\n", F.concat(F.lit("Describe in one sentence what this "), kind, F.lit(" does.")), F.concat(F.lit("Name: "), name), F.concat(F.lit("File: "), path), source)


def stale(sources: DataFrame, summaries: DataFrame) -> DataFrame:
    """Rows of ``sources`` (stable_id, source, ...) without a summary of their present source; with ``source_hash``."""
    x = sources.where(F.col("source").isNotNull()).withColumn("source_hash", F.sha2("source", 256))
    have = summaries.select(F.col("symbol_stable_id").alias("stable_id"), "source_hash").distinct()
    return x.join(have, ["stable_id", "source_hash"], "left_anti")


def summarize(rows: DataFrame, provider: Provider | None, model: str, now_ms: int) -> DataFrame:
    """(symbol_stable_id, summary, model, generated_at, source_hash) of rows (stable_id, prompt, source_hash).

    Without a provider nothing is made; rows for which it gives nothing have no summary.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, s.strip(), model, now_ms, h) for i, p, h in zip(b["stable_id"], b["prompt"], b["source_hash"]) if provider and (s := provider(p))]
            yield pd.DataFrame(out, columns=["symbol_stable_id", "summary", "model", "generated_at", "source_hash"])

    return rows.select("stable_id", "prompt", "source_hash").mapInPandas(run, "symbol_stable_id string, summary string, model string, generated_at long, source_hash string")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Summaries with those of ``new`` in place of older ones of the same symbol."""
    return old.join(new.select("symbol_stable_id"), "symbol_stable_id", "left_anti").select(*new.columns).unionByName(new)
