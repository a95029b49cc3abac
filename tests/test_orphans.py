import pytest

from strataline.operators import orphans as o
from strataline.operators.skew import hot_keys, lookup


def test_match_semantics(spark):
    parents = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, None, 0)], "x int, y string, z int")
    refs = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, None, "b"), (4, None, "q"), (5, None, None), (6, 3, None), (7, 9, None), (7, 9, None)], "z int, rx int, ry string")
    keys = [("rx", "x"), ("ry", "y")]
    got = {m: sorted(r["z"] for r in o.orphans(refs, parents, keys, m).collect()) for m in o.MATCH}
    assert got == {"simple": [2], "partial": [2, 4, 7, 7], "full": [2, 3, 4, 6, 7, 7]}
    assert o.orphans(refs, parents, keys).columns == refs.columns
    with pytest.raises(ValueError):
        o.orphans(refs, parents, keys, "other")


def test_empty_tables_and_clashing_names(spark):
    parents = spark.createDataFrame([], "stable_id string, ref string")
    refs = spark.createDataFrame([("a", "x"), (None, "y")], "ref string, stable_id string")
    assert [r["ref"] for r in o.orphans(refs, parents, [("ref", "stable_id")]).collect()] == ["a"]
    assert o.orphans(refs.limit(0), parents, [("ref", "stable_id")]).collect() == []


def test_missing_ends(spark):
    edges = spark.createDataFrame([(1, "a", "b", 7), (2, "", None, 7), (3, "zz", "zz", None), (4, "A", "a", 8)], "id long, source_id string, target_id string, file_id long")
    symbols = spark.createDataFrame([("a",), ("a",), (None,)], "stable_id string")
    files = spark.createDataFrame([(7, 1_600_000_000_000)], "id long, indexed_at long")
    got = sorted((r["edge_id"], r["missing_end"]) for r in o.missing_ends(edges, symbols).collect())
    assert got == [(1, "target"), (3, "source"), (3, "target"), (4, "source")]
    rep = {(r["missing_end"], r["month"]): r["orphans"] for r in o.missing_ends_by_month(edges, symbols, files).collect()}
    assert rep == {("target", "2020-09"): 1, ("source", None): 2, ("target", None): 1}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_lookup_equals_plain_join(spark, how):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), ("m", 2), (None, 3)] + [("g", i) for i in range(30)], "k string, v int")
    right = spark.createDataFrame([("h", "H"), ("c", "C")], "k string, w string")
    hot = hot_keys(left, "k", least=10)
    b = left.join(right, "k", how).collect()
    for once in (False, True):
        a = lookup(left, right, "k", how, hot, once).collect()
        assert sorted(map(str, a)) == sorted(map(str, b))


def test_pairs_within_hot_groups(spark, monkeypatch):
    from strataline.operators import skew

    monkeypatch.setattr(skew.hot_keys, "__defaults__", (10,))
    rows = [("h", i) for i in range(20)] + [("c", 1), ("c", 2), (None, 3)]
    got = [(r["k"], r["v_a"], r["v_b"]) for r in skew.pairs_within(spark.createDataFrame(rows, "k string, v int"), "k").collect()]
    assert sorted(got) == sorted((k, a, b) for k, a in rows for j, b in rows if k == j and k)
