"""Ask a question from the shell: python -m strataline DIR QUESTION [ARG...] [--json] [--limit N]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame

from strataline.api import Project
from strataline.session import local_session


def lines(df: DataFrame, limit: int):
    """Rows as JSON objects, one a line."""
    return (r[0] for r in df.limit(limit).selectExpr("to_json(struct(*))").toLocalIterator())


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="strataline")
    p.add_argument("dir")
    p.add_argument("question", choices=sorted(n for n in dir(Project) if not n.startswith("_") and callable(getattr(Project, n))))
    p.add_argument("args", nargs="*")
    p.add_argument("--json", action="store_true")
    p.add_argument("--limit", type=int, default=50)
    a = p.parse_args(argv)
    got = getattr(Project(local_session(), a.dir), a.question)(*a.args)
    for name, df in (got if isinstance(got, dict) else {"": got}).items():
        if name:
            print(f"# {name}")
        if a.json or not sys.stdout.isatty():
            print(*lines(df, a.limit), sep="\n")
        else:
            df.show(a.limit, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
