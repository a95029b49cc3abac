import os
import subprocess

from strataline.operators import incremental as inc
from strataline.sources import channels, discovery, extract, gitlog, manifests
from strataline.streaming.watch import watch


def test_log_and_mailmap(spark):
    h = "a" * 40
    raw = f"{gitlog.MARK}{h}\tAda\tada@x\t100\tsubject\twith tab\nA\0x.py\0R90\0old\0new\0C75\0p\0q\0T\0skip\0D\0gone\0{gitlog.MARK}nothex\tA\tb\t1\ts\n"
    commits, changes = gitlog.parse_log(raw)
    assert commits == [(h, "Ada", "ada@x", 100_000, "subject\twith tab")]
    assert [c[1:] for c in changes] == [("x.py", "A", None), ("new", "R", "old"), ("q", "A", "p"), ("gone", "D", None)]
    rows = gitlog.parse_mailmap("# c\nAda L <ada@x>\n<right@x> <wrong@x>\nBo <bo@x> Bobby <both@x>\nCe <ce@x> <both@x>\n")
    m = spark.createDataFrame(rows, "from_name string, from_email string, to_name string, to_email string")
    c = spark.createDataFrame([("1", "q", "ADA@x"), ("2", "bobby", "both@x"), ("3", "else", "both@x"), ("4", "Bo", "none@x")], "hash string, author_name string, author_email string")
    got = {r["hash"]: (r["author_name"], r["author_email"]) for r in gitlog.apply_mailmap(c, m).collect()}
    assert got == {"1": ("Ada L", "ada@x"), "2": ("Bo", "bo@x"), "3": ("Ce", "ce@x"), "4": ("Bo", "none@x")}


def test_real_repository(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n" * 20)
    run("add", "."), run("commit", "-qm", "one")
    os.rename(tmp_path / "a.py", tmp_path / "b.py")
    run("add", "-A"), run("commit", "-qm", "two")
    c, f = gitlog.ingest(spark, str(tmp_path))
    assert c.count() == 2 and {(r["file_path"], r["status"], r["rename_from"]) for r in f.collect()} == {("a.py", "A", None), ("b.py", "R", "a.py")}


def test_discovery_and_watch(spark, tmp_path):
    src = tmp_path / "src"
    for p, t in {"a.ts": "export function f() {}", "tests/t.test.ts": "x", "node_modules/m.js": "x", "skip/z.py": "x", "n.txt": "x"}.items():
        q = src / p
        q.parent.mkdir(parents=True, exist_ok=True)
        q.write_text(t)
    (src / ".gitignore").write_text("skip/\n# c\n!no\n*.bak\n")
    got = {r["path"]: r["is_test"] for r in discovery.discover(spark, str(src)).collect()}
    assert got == {"a.ts": False, "tests/t.test.ts": True}
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "9"), ("d", "2"), ("e", "4")], "path string, content_hash string")
    assert sorted((r["path"], r["change"], r["old_path"]) for r in discovery.changes(old, new).collect()) == [("a", "modified", None), ("c", "deleted", None), ("d", "renamed", "b"), ("e", "added", None)]
    seen = []
    q = watch(spark, str(src), lambda df, n: seen.extend(r["path"].rsplit("/", 1)[-1] for r in df.collect()), checkpoint=str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert {"a.ts", "t.test.ts"} <= set(seen)


def test_extractors(spark):
    py = extract.python("m.py", "import os\nfrom .x import y\nMAX = 1\nclass A(B):\n    def f(self):\n        '''Doc.'''\n        g()\ndef _g(): pass\n")
    assert [(s[2], s[3], s[4]) for s in py.symbols] == [("MAX", "variable", True), ("A", "class", True), ("f", "method", True), ("_g", "function", False)]
    assert ("m.py", "m.py::A", "m.py::A.f", "contains", 5, "resolved") in py.edges and py.imports == [("m.py", "os", 1), ("m.py", ".x", 2)]
    ts = extract.REGISTRY["typescript"]("a.ts", "import {q} from './q'\n// Doc\nexport class S extends T {\n  run(x: number): void { help('}') }\n}\nconst h = (a) => a\nenum E { A }\n")
    assert [(s[2], s[3], s[4]) for s in ts.symbols] == [("S", "class", True), ("run", "method", True), ("h", "function", False), ("E", "enum", False)]
    go = extract.REGISTRY["go"]("a.go", 'package p\nimport "fmt"\ntype R struct {\n  a int\n}\nfunc (r *R) Do(x int) error {\n  return help(x)\n}\n')
    assert [(s[1], s[3]) for s in go.symbols] == [("a.go::R", "class"), ("a.go::R.a", "property"), ("a.go::R.Do", "method")]
    rs = extract.REGISTRY["rust"]("a.rs", "use a::b;\npub trait T {\n  fn t(&self);\n}\nimpl T for S {\n  pub fn new() -> S { make() }\n}\n")
    assert ("a.rs::S.new", "method") in [(s[1], s[3]) for s in rs.symbols] and any(e[3] == "type_ref" for e in rs.edges)
    assert extract.fingerprint("func (r R) Do(a int, b map[string]int) (int, error)", "Do") == "Do/2/2"
    assert [(e[0], e[1], e[2]) for e in extract.endpoints("axios.post('/a/:id', x)\nr.GET(\"/a/{id}\", h)\nfetch(`/z`)")] == [("/a/:id", "POST", "client"), ("/a/{id}", "GET", "server"), ("/z", "GET", "client")]
    files = spark.createDataFrame([("d/m.py", "python", "def f(): pass"), ("d/n.ts", "typescript", "import a from './sub/../x'\nimport b from 'lib'"), ("d/x.ts", "typescript", None)], "path string, language string, content string")
    assert extract.symbols(files).count() == 1
    assert {r["import_path"]: r["target"] for r in extract.resolve_imports(extract.imports(files), files).collect()} == {"./sub/../x": "d/x.ts", "lib": None}


def test_channels_and_links(spark):
    text = 'q("SELECT * FROM users JOIN dbo.orders")\nlog("from and to project")\nx = process.env.STRIPE_KEY\nos.Getenv("PATH")\nbus.publish("order.created")\nq("WITH recent AS (SELECT 1) SELECT * FROM recent")'
    got = {(k, v, n) for k, v, n, _ in channels.hits(text)}
    assert got == {("sql_table", "users", 1), ("sql_table", "orders", 1), ("env_var", "STRIPE_KEY", 3), ("queue_topic", "order.created", 5)}
    src = spark.createDataFrame([(1, text)], "file_id long, text string")
    sym = spark.createDataFrame([(1, "outer", 1, 9), (1, "inner", 1, 2)], "file_id long, stable_id string, line_start int, line_end int")
    rows = {(r["value"], r["symbol_stable_id"]) for r in channels.link(src, sym).collect()}
    assert ("users", "inner") in rows and ("STRIPE_KEY", "outer") in rows
    from strataline.plans.structure import boundaries, endpoint_links, federated_dead

    e = spark.createDataFrame([("/A/:id/", "GET", "client", "c1"), ("/a/{key}", "POST", "server", "s1"), ("/a/${x}", None, "server", "s2")], "path_pattern string, http_method string, role string, symbol_stable_id string")
    assert [tuple(r) for r in endpoint_links(e).collect()] == [("/a/{param}", "c1", "s2")]
    x = spark.createDataFrame([("a", "1", "b", "2", "resolved"), ("b", "2", "c", "3", "heuristic"), ("c", "3", "a", "1", "heuristic")], "source_project string, source_stable_id string, target_project string, target_stable_id string, confidence string")
    assert [tuple(r) for r in boundaries(x, "a", "1", "c", 3).collect()] == [("3", 2)] and boundaries(x, "a", "1", "c", 1).collect() == []
    dead = spark.createDataFrame([("2",), ("3",)], "stable_id string")
    assert [r[0] for r in federated_dead(dead, x).collect()] == ["3"]


def test_manifests(spark):
    f = spark.createDataFrame([("go.mod", "module example.com/m\n"), ("w/package.json", '{"name": "w"}'), ("b/package.json", "{"), ("p/pyproject.toml", '[project]\nname = "pp"\n'), ("x.proto", "message M {} // message N {}\nservice S { rpc Do (M) returns (M); }"), ("o.yaml", "openapi: 3\ncomponents:\n  schemas:\n    Pet:\n      type: object\n    Tag:\n      x: 1\n"), ("o.json", '{"swagger": "2", "definitions": {"D": {}}}')], "path string, content string")
    assert {(r["name"], r["kind"], r["root_dir"]) for r in manifests.modules(f).collect()} == {("m", "go", ""), ("w", "node", "w"), ("pp", "python", "p")}
    p = manifests.proto_symbols(f)
    assert {(r["kind"], r["name"]) for r in p.collect()} == {("message", "M"), ("service", "S"), ("rpc", "Do")}
    s = spark.createDataFrame([("M", "1", "class"), ("M", "2", "function"), ("Do", "3", "method")], "name string, stable_id string, kind string")
    assert {r["stable_id"] for r in manifests.proto_links(p, s).collect()} == {"1", "3"}
    assert {(r["path"], r["name"]) for r in manifests.openapi_schemas(f).collect()} == {("o.yaml", "Pet"), ("o.yaml", "Tag"), ("o.json", "D")}


def test_rename_and_delete(spark):
    from pyspark.sql import functions as F

    files = spark.createDataFrame([(1, "a.py"), (2, "b.py")], "id long, path string")
    sym = files.select(F.col("id").alias("file_id"), F.concat("path", F.lit("::f")).alias("qualified_name"), F.lit("function").alias("kind"), "path").withColumn("stable_id", F.substring(F.sha2(F.concat_ws(":", "path", "kind", "qualified_name"), 256), 1, 32)).drop("path").withColumn("parent_id", F.lit(None).cast("string"))
    ids = {r["qualified_name"]: r["stable_id"] for r in sym.collect()}
    edges = spark.createDataFrame([(ids["b.py::f"], ids["a.py::f"], 2, "calls", "heuristic", 3, 4)], "source_id string, target_id string, file_id long, kind string, confidence string, line int, col int")
    flows = spark.createDataFrame([(1, ids["a.py::f"], [ids["b.py::f"], ids["a.py::f"]])], "id long, root_stable_id string, symbol_ids array<string>")
    t = {"files": files, "symbols": sym, "edges": edges, "flows": flows}
    out = inc.rename_symbols(t, spark.createDataFrame([("a.py", "c.py")], "old_path string, new_path string"))
    import hashlib

    want = hashlib.sha256(b"c.py:function:c.py::f").hexdigest()[:32]
    assert {r["path"] for r in out["files"].collect()} == {"b.py", "c.py"} and want in {r["stable_id"] for r in out["symbols"].collect()}
    assert out["edges"].first()["target_id"] == want and out["flows"].first()["symbol_ids"] == [ids["b.py::f"], want]
    gone = inc.delete_files(t, spark.createDataFrame([("b.py",)], "path string"))
    assert gone["symbols"].count() == 1 and gone["edges"].count() == 0
    assert inc.drop_heuristic_calls(edges, spark.createDataFrame([(2, 3, 4)], "file_id long, line int, col int")).count() == 0
    assert inc.drop_cross_file_edges(edges.withColumn("file_id", F.lit(None).cast("long")), sym).count() == 0
