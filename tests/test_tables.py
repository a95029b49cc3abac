"""Views of a data directory: pruned, pushed down, stored once per state; stored tables and their scope."""

import os

import pytest

from strataline import session
from strataline.plans import risk
from strataline.tables import Tables

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_views_prune_columns_and_push_filters(spark):
    t = Tables(spark, DATA)
    p = plan(t.symbols.where("kind = 'class'").select("stable_id"))
    assert "doc_comment" not in p and "signature" not in p and "EqualTo(kind,class)" in p and "Exchange" not in p
    p = plan(t.files.where("path = 'x'").select("id"))
    assert "ReadSchema: struct<id:bigint,path:string>" in p and "EqualTo(path,x)" in p
    p = plan(t.linked.where("kind = 'calls'").select("target_id"))
    assert "EqualTo(kind,calls)" in p and "project" not in p.split("ReadSchema")[1]


def test_views_follow_their_files(spark, tmp_path):
    d = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(r, "path string, indexed_at long, id long").coalesce(1).write.mode("overwrite").parquet(f"{d}/files.parquet")
    rows(("a", 1, 1), ("a", 2, 2), ("b", 1, 3))
    assert {tuple(r) for r in Tables(spark, d).files.collect()} == {("a", 2, 2), ("b", 1, 3)}
    rows(("a", 5, 9))
    assert [tuple(r) for r in Tables(spark, d).files.collect()] == [("a", 5, 9)]


def test_scope_drops_what_a_query_stored(spark):
    with session.scope():
        a = session.Stored(spark.range(5), "x")
        b = session.Stored(spark.range(5), "y", kept=True, counted=True)
        assert a.bytes() > 0 and b.rows == 5
    assert a.path not in session._live and b.path in session._live
    b.drop()
    assert not os.path.exists(b.path.removeprefix("file:"))


def test_generated_paths(spark, tmp_path):
    paths = ["p/fake_a.go", "p/mock_x.ts", "x_mock.jsx", "mocks/a.txt", "p/fakes/b", "p/__generated__/c.rs"]
    plain = ["p/fake_.go", "p/_mock.ts", "p/mock_x.rs", "p/generated/a.go", "p/a.pb.go", "p/mymocks/a.go", "p/mocks", "fake_go"]
    d = str(tmp_path)
    spark.createDataFrame([(i, x, 1) for i, x in enumerate(paths + plain)], "id long, path string, indexed_at long").write.parquet(f"{d}/files.parquet")
    texts = [(len(paths), "// code GENERATED by x. do not edit."), (len(paths) + 1, "Code generated\nDO NOT EDIT"), (len(paths) + 2, " " * 5000 + "Code generated, DO NOT EDIT"), (None, "Code generated DO NOT EDIT")]
    spark.createDataFrame(texts, "file_id long, text string").write.parquet(f"{d}/documents.parquet")
    assert sorted(r[0] for r in risk.generated_files(Tables(spark, d)).collect()) == list(range(len(paths) + 1))
