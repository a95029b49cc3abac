"""Compound answers, searches, encoders and projects on a small index and on the smallest test tables."""

import hashlib
import os
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline import __main__ as cli
from strataline.api import Project
from strataline.functions import judge
from strataline.operators import embedding, summaries
from strataline.plans import structure, surfaces
from strataline.sources import channels, gitlog, index
from strataline.tables import Tables

DATA = "/root/testdata/sf0.001"
TREE = {
    "shop/src/db.ts": "export function load(id: string): void {\n  run(`SELECT * FROM orders WHERE id = ${id}`);\n  const k = process.env.SHOP_KEY;\n}\nexport function save(): void {\n  run('INSERT INTO orders VALUES (1)');\n  load('x');\n}\n",
    "shop/src/api.ts": "import { load } from './db';\n// Serves one order.\nexport function serve(): void {\n  app.get('/orders/:id', () => load('1'));\n  load('2');\n}\n",
    "web/src/page.ts": "import { load } from '../../shop/src/db';\nexport function page(): void {\n  load('3');\n  fetch('/orders/7');\n}\nexport function book(): void {\n  page();\n}\n",
}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for p, t in TREE.items():
        os.makedirs(f"{root}/src/{os.path.dirname(p)}", exist_ok=True)
        with open(f"{root}/src/{p}", "w") as f:
            f.write(t)
    index.build(spark, f"{root}/src", f"{root}/out", 5)
    return Tables(spark, f"{root}/out")


def ids(t):
    return {r["name"]: r["stable_id"] for r in t.placed.collect()}


def test_routes_and_channels(spark, shop):
    got = [(r["role"], r["path_pattern"], r["line"]) for r in surfaces.api_trace(shop.raw("api_endpoints"), shop, "ORDERS").collect()]
    assert got == [("client", "/orders/7", 4), ("server", "/orders/:id", 4)]
    assert surfaces.api_trace(shop.raw("api_endpoints"), shop, "orders", "server").count() == 1
    assert [tuple(r) for r in structure.listed_channels(shop.raw("channel_hits"), "sql_table").collect()] == [("sql_table", "orders", 2, 2)]
    assert [(r["name"], r["line"], r["detail"]) for r in structure.show_channel(shop.raw("channel_hits"), shop, "sql_table", "orders").collect()] == [("load", 2, "from"), ("save", 6, "into")]
    assert channels.graphql_templates("const q = gql`\n type Order { id: ID }\n`") == [("Order", 1)]


def test_search_box(spark, shop):
    names = lambda *a, **k: [r["name"] for r in surfaces.find(shop, *a, **k).collect()]
    assert names("serves") == ["serve"] and names("load", exact=True) == ["load"] and names("???") == []
    told = spark.createDataFrame([(ids(shop)["page"], "Shows what the order box needs")], "symbol_stable_id string, summary string")
    assert names("serves", summaries=told) == ["serve"] and names("order", summaries=told) == ["serve", "page"]
    assert names("order", summaries=told, kind="class") == []
    assert [(r["project"], r["name"]) for r in surfaces.find_everywhere(shop, "O").collect()] == [("web", "book"), ("shop", "load")]


def test_details(spark, shop):
    i = ids(shop)
    d = surfaces.symbol_detail(shop, i["load"])
    assert {r["name"] for r in d["upstream"].collect()} == {"save", "serve", "page"} and d["source"].first()["source"].startswith("export function load")
    assert {r["path"] for r in surfaces.file_article(shop, "shop/src/db.ts")["used_by"].collect()} == {"shop/src/api.ts", "web/src/page.ts"}
    assert {(r["depth"], r["nodes"]) for r in surfaces.overview(shop, i["load"])["stats"].collect()} == {(1, 3), (2, 1)}


def test_projects(spark, shop):
    i = ids(shop)
    x = surfaces.project_edges(shop)
    assert {(r["source_project"], r["target_stable_id"]) for r in x.collect()} == {("web", i["load"])}
    assert {(r["project"], r["stable_id"], r["depth"]) for r in surfaces.fan_out(shop, x, "shop", i["load"]).collect()} == {("web", i["page"], 0), ("web", i["book"], 1)}
    both = spark.createDataFrame([("shop", i["load"]), ("shop", i["save"])], "project string, stable_id string")
    assert [r["stable_id"] for r in surfaces.has_inbound(x, both).collect()] == [i["load"]]
    e = [("a", "1", "b", "2"), ("b", "2", "c", "3"), ("b", "2", "c", "4"), ("a", "1", "c", "4"), ("c", "4", "a", "1")]
    ring = spark.createDataFrame(e, "source_project string, source_stable_id string, target_project string, target_stable_id string")
    assert sorted((r["hops"], r["chain"]) for r in surfaces.chains(ring, "a", "1", "c").collect()) == [(1, ["a 1", "c 4"]), (2, ["a 1", "b 2", "c 3"])]
    assert surfaces.chains(ring, "a", "1", "c", 0).collect() == []
    across = surfaces.trace_across(shop, x, "web", i["page"], "shop", i["load"])
    assert across.count() <= 1
    parts = {"p": spark.createDataFrame([("s1", 0.3), ("s2", 0.1)], "stable_id string, distance double"), "q": spark.createDataFrame([("s3", 0.2)], "stable_id string, distance double")}
    assert [r["stable_id"] for r in surfaces.merged(parts, 2).collect()] == ["s2", "s3"]


def test_encoders_are_retried_in_halves():
    calls = []

    def fussy(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError("bad text")
        return np.ones((len(texts), 2))

    got = embedding.batched(["a"] * 5 + ["bad"] + ["b"] * 4, fussy)
    assert [v is None for v in got] == [False] * 5 + [True] + [False] * 4 and calls[0] == 10
    assert all(v is None for v in embedding.batched(["bad"] * 40, fussy, retries=3))
    v = embedding.hashed(32)(["readFile now", "read the file", "zebra", ""])
    assert v[0] @ v[1] > v[0] @ v[2] and not v[3].any()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_search_by_meaning_and_stale_vectors(spark):
    p = Project(spark, DATA)
    assert p.ask("token store", k=3).count() == 3
    from strataline.plans import search

    todo = search.stale_embeddings(p.t).select("symbol_stable_id").distinct().count()
    new = search.embed_stale(p.t, embedding.hashed())
    assert 0 < new.select("symbol_stable_id").distinct().count() <= todo and len(new.first()["embedding"]) == 64


def test_summaries_are_made_once(spark):
    src = spark.createDataFrame([("a", "x = 1"), ("b", "y = 2"), ("c", None)], "stable_id string, source string")
    none = spark.createDataFrame([], "symbol_stable_id string, summary string, model string, generated_at long, source_hash string")
    ask = lambda df: summaries.stale(df, none).withColumn("prompt", summaries.prompt(F.lit("variable"), F.col("stable_id"), F.lit("f"), F.col("source")))
    first = summaries.summarize(ask(src), lambda p: "says " + p[-1] if "x" in p else None, "m", 1)
    assert [(r["symbol_stable_id"], r["summary"]) for r in first.collect()] == [("a", "says 1")]
    assert {r["stable_id"] for r in summaries.stale(src, first).collect()} == {"b"}
    assert summaries.summarize(ask(src), None, "m", 1).count() == 0 and summaries.merge(first, first.withColumn("summary", F.lit("new"))).first()["summary"] == "new"


def test_scores(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "e array<string>, a array<string>")
    assert [r[0] for r in rows.select(judge.f1(F.col("e"), F.col("a"))).collect()] == [0.5, 1.0, 0.0]
    assert spark.range(1).select(judge.within(F.lit(10), F.lit(12), F.lit(2)), judge.within(F.lit(10), F.lit(12), F.lit(None))).first()[:] == (1.0, 0.0)


def test_diff_of_a_work_tree(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, text=True).stdout
    git("init", "-q")
    for n, t in (("a", "one\n" * 20), ("b", "two\n"), ("c", "three\n")):
        (tmp_path / n).write_text(t)
    git("add", "-A")
    git("commit", "-qm", "first")
    base = git("rev-parse", "HEAD").strip()
    git("mv", "a", "tab\tname")
    (tmp_path / "b").write_text("more\n")
    (tmp_path / "c").unlink()
    (tmp_path / "new").write_text("x")
    assert {tuple(r) for r in gitlog.diff(spark, str(tmp_path), base).collect()} == {("tab\tname", "renamed", "a"), ("b", "modified", None), ("c", "deleted", None), ("new", "added", None)}


def test_command_line(spark, shop, capsys):
    assert cli.main([shop.dir, "search", "load", "--json"]) == 0
    assert '"name":"load"' in capsys.readouterr().out


@pytest.mark.parametrize("pairs", [0, 3, 50_000, 80_000, 140_000])
def test_topology_hash_of_any_size(spark, monkeypatch, pairs):
    """The plain sum while it fits a long; larger sums wrap instead of failing."""
    g = spark.range(pairs).selectExpr("id AS a", "id + 1 AS b", "CAST(id % 3 + 1 AS DOUBLE) AS weight")
    monkeypatch.setattr(structure, "file_graph", lambda t: g)
    total = sum(int(hashlib.sha256(f"{i}:{i + 1}:{i % 3 + 1}".encode()).hexdigest()[:12], 16) for i in range(pairs))
    got = structure.topology_hash(None)
    assert got.dtypes == [("pairs", "bigint"), ("hash", "bigint")]
    assert tuple(got.first()) == (pairs, (total + 2**63) % 2**64 - 2**63 if pairs else None)
