"""From source trees to tables: resolution across files, and incremental runs."""

import os

import pytest
from pyspark.sql import functions as F

from strataline.plans import risk
from strataline.sources import extract, index, references
from strataline.tables import Tables

TREE = {
    "web/src/math.ts": "export function add(a: number, b: number): number {\n  return a + b;\n}\nexport class Calc {\n  total: number;\n  run(x: number): number {\n    return add(x, this.half(x));\n  }\n  half(x: number): number {\n    return x;\n  }\n}\nexport interface Shape {\n  side: number;\n  area(): number;\n}\n",
    "web/src/index.ts": "import { add as plus, Calc, Shape } from './math';\nimport * as m from './math';\nexport class Big extends Calc implements Shape {\n  side: number;\n}\nexport function main(s: Shape): void {\n  const c = new Calc();\n  plus(1, 2);\n  m.add(3, 4);\n  c.run(5);\n  console.log(c.total);\n  [1].map(plus);\n  later();\n}\n",
    "web/tests/math.test.ts": "import { add } from '../src/math';\ntest('adds numbers', () => {\n  add(1, 2);\n});\n",
    "svc/go.mod": "module example.org/svc\n",
    "svc/main.go": 'package main\n\nimport (\n\t"example.org/svc/store"\n\tlib "example.org/other/lib"\n)\n\nfunc main() {\n\ts := store.NewStore()\n\ts.Save(1)\n\tlib.Help()\n\tlocal()\n}\n',
    "svc/local.go": "package main\n\nfunc local() {\n}\n",
    "svc/store/store.go": "package store\n\ntype Store struct {\n\tsize int\n}\n\nfunc NewStore() *Store {\n\treturn &Store{}\n}\n",
    "svc/store/save.go": "package store\n\nfunc (s *Store) Save(n int) {\n}\n",
    "svc/vendor/example.org/other/lib/lib.go": "package lib\n\nfunc Help() {\n}\n",
    "app/pkg/__init__.py": "",
    "app/pkg/util.py": "class Tool:\n    def use(self):\n        return self.inner()\n\n    def inner(self):\n        return 1\n\n\ndef helper(x):\n    return x\n",
    "app/run.py": "from pkg import util\nfrom pkg.util import Tool, helper\n\n\ndef go(t: Tool):\n    t.use()\n    k = Tool()\n    k.inner()\n    map(helper, [])\n    return util.helper(1)\n",
    "rs/src/lib.rs": "use crate::deep::work;\n\npub fn start() {\n    work(1);\n}\n",
    "rs/src/deep.rs": "pub fn work(n: i32) -> i32 {\n    n\n}\n",
}
WANT = {
    ("web/src/math.ts::Calc.run", "web/src/math.ts::add", "calls"), ("web/src/math.ts::Calc.run", "web/src/math.ts::Calc.half", "calls"),
    ("web/src/index.ts::main", "web/src/math.ts::add", "calls"), ("web/src/index.ts::main", "web/src/math.ts::Calc", "instantiates"), ("web/src/index.ts::main", "web/src/math.ts::Calc.run", "calls"),
    ("web/src/index.ts::main", "web/src/math.ts::Calc.total", "field_access"), ("web/src/index.ts::main", "web/src/math.ts::add", "passed_as"), ("web/src/index.ts::main", "web/src/math.ts::Shape", "type_ref"),
    ("web/src/index.ts::Big", "web/src/math.ts::Calc", "extends"), ("web/src/index.ts::Big", "web/src/math.ts::Shape", "type_ref"), ("web/tests/math.test.ts::test:adds numbers", "web/src/math.ts::add", "calls"),
    ("svc/main.go::main", "svc/store/store.go::NewStore", "calls"), ("svc/main.go::main", "svc/store/save.go::Store.Save", "calls"), ("svc/main.go::main", "svc/local.go::local", "calls"),
    ("svc/main.go::main", "svc/vendor/example.org/other/lib/lib.go::Help", "calls"), ("svc/store/store.go::NewStore", "svc/store/store.go::Store", "instantiates"),
    ("app/run.py::go", "app/pkg/util.py::Tool.use", "calls"), ("app/run.py::go", "app/pkg/util.py::Tool", "instantiates"), ("app/run.py::go", "app/pkg/util.py::Tool.inner", "calls"), ("app/run.py::go", "app/pkg/util.py::helper", "passed_as"),
    ("app/run.py::go", "app/pkg/util.py::helper", "calls"), ("app/run.py::go", "app/pkg/util.py::Tool", "type_ref"), ("app/pkg/util.py::Tool.use", "app/pkg/util.py::Tool.inner", "calls"),
    ("rs/src/lib.rs::start", "rs/src/deep.rs::work", "calls"),
}


def write(root, tree):
    for p, t in tree.items():
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        with open(f"{root}/{p}", "w") as f:
            f.write(t)


def named(spark, out):
    s = spark.read.parquet(f"{out}/symbols.parquet")
    e = spark.read.parquet(f"{out}/edges.parquet").where("kind <> 'contains'")
    ids = lambda side: s.select(F.col("stable_id").alias(f"{side}_id"), F.col("qualified_name").alias(side))
    return {(r["source"], r["target"], r["kind"]) for r in e.join(ids("source"), "source_id").join(ids("target"), "target_id").collect()}


@pytest.fixture
def project(spark, tmp_path):
    write(f"{tmp_path}/src", TREE)
    return f"{tmp_path}/src", f"{tmp_path}/out", spark.createDataFrame([("example.org/svc", "svc")], "module_path string, root_dir string")


def test_names_are_resolved_across_files(spark, project):
    root, out, modules = project
    index.build(spark, root, out, 1000, modules=modules)
    got = named(spark, out)
    assert WANT - got == set()
    assert {x for x in got - WANT if x[2] in ("calls", "instantiates", "extends", "passed_as")} == set()
    t = Tables(spark, out)
    imports = spark.read.parquet(f"{out}/imports.parquet")
    assert imports.where("import_path = './math' and target_file_id is not null").count() == 2
    assert [r["name"] for r in risk.untested(t).collect() if r["name"] == "add"] == []  # the test's callback calls it


def test_update_follows_changes(spark, project):
    root, out, modules = project
    index.build(spark, root, out, 1000, modules=modules)
    os.remove(f"{root}/svc/local.go")
    write(root, {"web/src/later.ts": "export function later(): void {\n}\n", "web/src/index.ts": TREE["web/src/index.ts"].replace("import * as m", "import { later } from './later';\nimport * as m")})
    os.rename(f"{root}/rs/src/deep.rs", f"{root}/rs/src/far.rs")
    done = {(r["path"], r["change"]) for r in index.update(spark, root, out, 2000, modules=modules).collect()}
    assert done == {("svc/local.go", "deleted"), ("web/src/later.ts", "added"), ("web/src/index.ts", "modified"), ("rs/src/far.rs", "renamed")}
    got = named(spark, out)
    assert ("web/src/index.ts::main", "web/src/later.ts::later", "calls") in got
    assert not any("local" in b or "rs/src" in b for _, b, _ in got)
    assert ("web/src/index.ts::main", "web/src/math.ts::Calc.run", "calls") in got
    files = {r["path"]: r["indexed_at"] for r in spark.read.parquet(f"{out}/files.parquet").collect()}
    assert files["web/src/math.ts"] == 1000 and files["web/src/index.ts"] == 2000 and "svc/local.go" not in files
    whole = f"{out}-whole"
    index.build(spark, root, whole, 2000, modules=modules)
    assert named(spark, whole) == got


def test_members_and_test_cases():
    found = extract.REGISTRY["typescript"]("a.ts", TREE["web/src/math.ts"])
    assert {(s[2], s[3]) for s in found.symbols} >= {("total", "property"), ("side", "property"), ("area", "method"), ("half", "method")}
    label = "x" * 200
    found = extract.REGISTRY["typescript"]("a.test.ts", f"it('{label}', async () => {{\n  go();\n}});\n")
    assert [s[2] for s in found.symbols] == ["test:" + "x" * 80]


def test_scopes_and_bindings():
    assert references.file_scope("a/b/index.ts") == "a/b" and references.file_scope("a/x.d.ts") == "a/x" and references.file_scope("pkg/__init__.py") == "pkg"
    rows = references.uses("p/a.ts", "typescript", "import d, { x, y as z } from '@/lib';\nconst { q } = require('../w.js');\nimport { e } from 'external';\n", {"@/": "p/src/"})
    assert {(r[3], r[4], r[8]) for r in rows if r[0] == "bind"} == {("d", "default", "p/src/lib"), ("x", "x", "p/src/lib"), ("z", "y", "p/src/lib"), ("q", "q", "w")}
    assert references.uses("a.x", "cobol", "x") == [] and references.uses("a.py", "python", "def (") == [] and references.uses("a.go", "go", "") == []


def test_follow_sees_deletions(spark, tmp_path):
    import time

    from strataline.streaming import watch

    write(f"{tmp_path}/src", {"p/a.py": "def a():\n    pass\n", "p/b.py": "def b():\n    pass\n"})
    root, out, seen = f"{tmp_path}/src", f"{tmp_path}/out", []
    index.build(spark, root, out, 1)
    os.remove(f"{root}/p/b.py")
    write(root, {"p/c.py": "from .a import a\n\n\ndef c():\n    a()\n"})
    q = watch.follow(spark, root, out, lambda: 2, "1 second", lambda d: seen.extend((r["path"], r["change"]) for r in d.collect()))
    for _ in range(240):
        if seen or not q.isActive:
            break
        time.sleep(0.25)
    q.stop()
    assert sorted(seen) == [("p/b.py", "deleted"), ("p/c.py", "added")]
    assert named(spark, out) == {("p/c.py::c", "p/a.py::a", "calls")}
    assert watch.listing(spark, root) == watch.listing(spark, root)
