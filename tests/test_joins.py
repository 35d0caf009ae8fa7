"""How views join: what grows with a table is not sent to the driver."""

import pytest
from graphs import levels

from treelens.operators.view import Expansion, Forest, View
from treelens.plans.query import query, select

THREE = query("Root", select("level1", select("level2", sort=["name"]), sort=["name"]), sort=["name"])


def broadcasts(forest):
    return forest.rows()._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.fixture
def stored(spark, tmp_path):
    """The small graph from files, whose sizes Spark knows."""
    g = levels(spark)
    for t in ("Root", "L1", "L2"):
        g.nodes(t).write.parquet(str(tmp_path / t))
        g.bind_nodes(t, spark.read.parquet(str(tmp_path / t)))
    for t, e in (("Root", "level1"), ("L1", "level2")):
        g.edges(t, e).pairs.write.parquet(str(tmp_path / e))
        g.bind_edges(t, e, spark.read.parquet(str(tmp_path / e)), distinct=True, one_source=True)
    return g


def test_edges_and_targets_are_not_broadcast(stored):
    assert broadcasts(Forest(stored, THREE)) == 0
    assert [(r["type"], r["id"]) for r in Forest(stored, THREE).flat().collect()] == [("Root", 2), ("L1", 13), ("Root", 1), ("L1", 12), ("L2", 23), ("L1", 11), ("L2", 22), ("L2", 21)]


def test_parents_that_were_clicked_on_are(stored):
    opened = Forest(stored, THREE, Expansion(frozenset({("Root", 1, "level1"), ("L1", 11, "level2")})))
    plan = opened.rows()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 4 and plan.count("SortMergeJoin") >= 2
    assert [(r["type"], r["id"]) for r in opened.flat().collect()] == [("Root", 2), ("Root", 1), ("L1", 12), ("L1", 11), ("L2", 22), ("L2", 21)]


def test_a_place_at_a_path_builds_the_view_once(stored, monkeypatch):
    built, rows = [], Forest.rows
    monkeypatch.setattr(Forest, "rows", lambda self: built.append(self) or rows(self))
    v = View(stored, THREE)
    v.expand_all()
    assert v.path_to_index(1, ("level1", 1), ("level2", 0)) == 6 and len(built) == 1
    assert v.path_to_index(2) == 0
