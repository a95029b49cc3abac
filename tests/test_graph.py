from strataline.operators import graph as g
from strataline.operators import relational as R
from strataline.operators import text as T
from strataline.operators import vector as V


def test_reach_cycles_depth_and_seed_depths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "d"), (None, "x"), ("d", "d")], "src string, dst string")
    s = spark.createDataFrame([("q", "a")], "key string, id string")
    assert {r["id"]: r["depth"] for r in g.reach(s, e).collect()} == {"a": 0, "b": 1, "c": 2, "d": 1}
    assert {r["id"] for r in g.reach(s, e, 1).collect()} == {"a", "b", "d"}
    late = spark.createDataFrame([("q", "b", 0), ("q", "a", 2), ("q", "z", 3)], "key string, id string, depth int")
    assert {r["id"]: r["depth"] for r in g.reach(late, e).collect()} == {"b": 0, "c": 1, "a": 2, "d": 2, "z": 3}
    assert g.reach(s.limit(0), e).collect() == []


def test_simple_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("a", "e"), ("e", "f"), ("f", "d")], "src string, dst string")
    got = sorted(r["path"] for r in g.simple_paths(e, "a", "d", max_paths=3).collect())
    assert got == [["a", "b", "d"], ["a", "c", "d"], ["a", "e", "f", "d"]]
    assert g.simple_paths(e, "a", "zz").collect() == []


def test_communities_modularity_conductance(spark):
    tri = lambda p: [(f"{p}1", f"{p}2", 5.0), (f"{p}2", f"{p}3", 5.0), (f"{p}1", f"{p}3", 5.0)]
    w = spark.createDataFrame(tri("a") + tri("b") + [("a1", "b1", 1.0)], "a string, b string, weight double")
    lab = g.communities(w)
    got = {r["id"]: r["label"] for r in lab.collect()}
    assert len({got[x] for x in ("a1", "a2", "a3")}) == 1 and got["a1"] != got["b1"]
    assert g.modularity(w, lab).first()[0] > 0.4
    assert {r["members"] for r in g.conductance(w, lab).collect()} == {3}
    assert {r["conductance"] for r in g.conductance(w, lab).collect()} == {round(1 / 31, 6)}


def test_louvain_finds_a_ring_of_cliques(spark):
    """Six cliques of five on a ring: each is a community; modularity by the formula."""
    e = [(5 * c + i, 5 * c + j, 1.0) for c in range(6) for i in range(5) for j in range(i + 1, 5)] + [(5 * c + 4, (5 * c + 5) % 30, 1.0) for c in range(6)]
    w = spark.createDataFrame(e, "a long, b long, weight double")
    lab = g.communities(w)
    groups = {}
    for r in lab.collect():
        groups.setdefault(r["label"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [list(range(5 * c, 5 * c + 5)) for c in range(6)]
    assert g.modularity(w, lab).first()[0] == round(60 / 66 - 1 / 6, 6)
    assert sorted(map(tuple, g.communities(w.repartition(7)).collect())) == sorted(map(tuple, lab.collect()))
    assert g.communities(w.limit(0)).collect() == []


def test_relational(spark):
    paths = spark.createDataFrame([("a/b/c.py",), ("a/x.py",), ("z.py",)], "path string")
    pre = spark.createDataFrame([("a", "A"), ("a/b/", "AB")], "dir string, label string")
    assert {r["path"]: r["label"] for r in R.longest_prefix(paths, "path", pre, "dir", "label").collect()} == {"a/b/c.py": "AB", "a/x.py": "A", "z.py": None}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert sorted(tuple(r) for r in R.diff(old, new.dropDuplicates(["k"]), "k", "v").collect()) == [(1, "deleted"), (2, "modified"), (3, "added")]
    assert R.upsert(old, new, ["k"]).count() == 4 and R.insert_ignore(old, new, ["k"]).count() == 3
    import re

    for glob, yes, no in [("a/b", "a/b", "xa/b"), ("**/gen/**", "x/gen/y", "x/gene/y"), ("**/*mock*", "a/my_mock.go", "mock/a"), ("**/go.mod", "x/go.mod", "xgo.mod"), ("*.ts", "a/b.ts", "b.tsx"), ("a?b", "q", "a?b!")]:
        assert bool(re.search(R.glob_to_regex(glob), yes)) == (glob != "a?b") and not re.search(R.glob_to_regex(glob), no)


def test_stems_and_search(spark):
    for w, s in [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("controlling", "control"), ("rate", "rate"), ("adoption", "adopt")]:
        assert T.stem(w) == s, w
    d = spark.createDataFrame([(1, "parse tokens fast"), (2, "token parser"), (3, None), (4, "")], "id long, t string")
    idx = T.inverted_index(d, "id", ["t"])
    assert {r["id"] for r in T.bm25(idx, "id", "token pars").collect()} == {1, 2}
    assert T.bm25(idx, "id", "!!").collect() == []
    hits = T.content_search(d, "id", "t", "token", per_file=1)
    assert sorted(r["id"] for r in hits.collect()) == [1, 2]


def test_exact_vector_search(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 2.0]), (4, [5.0, 0.0])], "id long, v array<float>")
    got = {(r["query_id"], r["id"]) for r in V.search(rows.where("id = 1"), rows, 2).collect()}
    assert got == {(1, 4), (1, 2)}
