"""Arguments of registered queries, taken from the data: the largest project, the most frequent names.

The oracle has them as the views bp, nm and pn (``tables.SQL``).
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from strataline.tables import Tables


def largest_project(t: Tables) -> str:
    """The project with most files; ties go to the smaller name."""
    row = t.files.groupBy(F.substring_index("path", "/", 1).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p").first()
    return row["p"] if row else ""


def common_names(t: Tables) -> list[str]:
    """The two most frequent names of functions and methods outside tests; ties go to the smaller."""
    x = t.placed.where(~F.col("is_test") & F.col("kind").isin("function", "method"))
    return [r["name"] for r in x.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(2).collect()]


def placed_name(t: Tables) -> str:
    """``file:name`` of the symbol of least id with the most frequent name."""
    name = (common_names(t) or [""])[0]
    row = t.placed.where((F.col("name") == name) & ~F.col("is_test") & F.col("kind").isin("function", "method")).orderBy("stable_id").select("path").first()
    return re.sub(r"\.[^.]*$", "", row["path"].rsplit("/", 1)[-1]) + ":" + name if row else ":"


def spoken(t: Tables) -> str:
    """The first two words of the most frequent name."""
    return " ".join(re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", (common_names(t) or [""])[0])[:2]).lower()

