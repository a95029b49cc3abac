import random

from strataline.operators import hierarchy as h


def brute(rows):
    parent = {}
    ids = {i for i, _ in rows if i is not None}
    for i, p in rows:
        if i is not None:
            c = [x for x in (parent.get(i), p if p in ids else None) if x is not None]
            parent[i] = min(c) if c else None
    out = {}
    for i in parent:
        seen, x = [], i
        while parent[x] is not None and x not in seen:
            seen.append(x)
            x = parent[x]
        if parent[x] is None:
            out[i] = (x, len(seen))
        else:
            out[i] = (min(seen[seen.index(x):]), -1)
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, p, "x", "y") for i, p in rows], "stable_id string, parent_id string, root_id string, depth string")
    return h.hierarchy(df, **kw)


def check(spark, rows):
    got = {r["id"]: (r["root_id"], r["depth"]) for r in run(spark, rows).collect()}
    assert got == brute(rows)


def test_chain_cycle_nulls_and_repeats(spark):
    rows = [(f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(40)]
    rows += [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("s", "s"), ("t", "s")]
    rows += [("o", "nowhere"), ("", None), ("p", ""), (None, "a"), ("n005", "n004"), ("two", "a"), ("two", "n001")]
    check(spark, rows)


def test_random_forest(spark):
    r = random.Random(3)
    check(spark, [(f"{i}", f"{r.randrange(-5, 60)}") for i in range(60)])


def test_empty_and_paths(spark):
    assert run(spark, []).collect() == []
    rows = [("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "x")]
    paths = run(spark, rows, with_path=True)
    assert {x["id"]: x["path"] for x in paths.collect()} == {"r": "r", "a": "r/a", "b": "r/a/b", "x": None, "y": None}
    assert sorted(tuple(x) for x in h.descendants(paths).collect()) == [("a", "b", 1), ("r", "a", 1), ("r", "b", 2)]


def test_hot_parent(spark, monkeypatch):
    monkeypatch.setattr(h, "HOT_ROWS", 1)
    rows = [("r", None), ("h", "r")] + [(f"c{i}", "h") for i in range(50)]
    check(spark, rows)
