"""Derived tables of the smallest test tables."""

import os

import pytest

from strataline.plans import persist, risk, structure
from strataline.tables import Tables

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_flows_are_stored_and_listed(spark):
    t = Tables(spark, DATA)
    table = persist.flows_table(t, 7)
    rows = table.collect()
    assert rows and all(r["symbol_ids"][0] == r["root_stable_id"] and len(r["symbol_ids"]) >= 2 and r["generated_at"] == 7 for r in rows)
    listed = persist.flow_listing(table, t)
    assert listed.count() == risk.flows(t).count()
    assert {r["position"] for r in listed.where("position = 0").collect()} == {0}


def test_subsystems_are_stored_with_their_files(spark):
    t = Tables(spark, DATA)
    table = persist.subsystems_table(t, 7, "abc").cache()
    files = persist.files_with_subsystem(t, table)
    named = {r["id"]: r["subsystem_id"] for r in files.collect()}
    for r in table.collect():
        assert len(r["member_file_ids"]) >= 2 and all(named[f] == r["id"] for f in r["member_file_ids"])
    assert len(named) == t.files.count() and files.columns == t.files.columns
    assert persist.modularity_of(t, table).first()[0] > 0
    h = structure.topology_hash(t).first()["hash"]
    assert persist.same_topology(t, h) and not persist.same_topology(t, h + 1) and not persist.same_topology(t, None)
