"""Registered queries that cover the whole of a table."""

import os

import pytest

from treelens import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def orders(spark):
    return {(r["o_custkey"], r["o_orderkey"]) for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderkey").collect()}


def test_every_link_is_watched_from_both_ends(spark):
    got = {(r["type"], r["id"], r["other_id"]) for r in catalog.QUERIES["node_watch_link_all"](spark, SF).collect()}
    assert got == {x for c, o in orders(spark) for x in (("Order", o, c), ("Customer", c, o))}


def test_every_edge_is_found(spark):
    assert {(r["src"], r["dst"]) for r in catalog.QUERIES["has_edge_all"](spark, SF).collect()} == orders(spark)


def test_every_order_stands_under_the_hidden_root(spark):
    got = catalog.QUERIES["virtual_root_all"](spark, SF).collect()
    assert {r["id"] for r in got} == {o for _, o in orders(spark)} and sorted(r["pos"] for r in got) == list(range(len(got)))
