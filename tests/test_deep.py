"""Recursion deeper than any cap, on a real chain."""

from graphs import prop
from pyspark.sql import functions as F

from treelens import Graph, parse_schema
from treelens.operators.view import Forest
from treelens.plans.query import query, select

CHAIN = {"types": [{"name": "N", "properties": prop("v:int"), "edges": [{"name": "next", "target": "N", "reverse": "prev"}, {"name": "prev", "target": "N", "reverse": "next"}]}]}


def test_recursion_has_no_cap(spark):
    n = 1500
    g = Graph(spark, parse_schema(CHAIN)).bind_nodes("N", spark.range(n).select("id", F.col("id").alias("v")))
    g.bind_edges("N", "next", spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), distinct=True, one_target=True, one_source=True)
    rows = Forest(g, query("N", select("next", sort=["-v"], recursive=True), where=[("id", "eq", 0)])).flat().collect()
    assert [(r["id"], r["depth"], r["parent_id"]) for r in rows] == [(i, i, i - 1 if i else None) for i in range(n)]


def test_levels_of_many_sources_have_no_cap(spark):
    n = 12  # each node leads to the next and the one after: many paths, one walk
    g = Graph(spark, parse_schema(CHAIN)).bind_nodes("N", spark.range(n).select("id", F.col("id").alias("v")))
    pairs = [(i, j) for i in range(n) for j in (i + 1, i + 2) if j < n]
    g.bind_edges("N", "next", spark.createDataFrame(pairs, "src long, dst long"), distinct=True)
    rows = Forest(g, query("N", select("next", sort=["v"], recursive=True), where=[("id", "eq", 0)])).flat().collect()
    assert [(r["id"], r["depth"]) for r in rows] == [(i, i) for i in range(n)]
    capped = Forest(g, query("N", select("next", sort=["v"], recursive=True), where=[("id", "eq", 0)]), max_depth=3).flat().collect()
    assert max(r["depth"] for r in capped) == 3


NEXT = query("N", select("next", sort=["v"], recursive=True), where=[("id", "eq", 0)])


def chain(spark, n, side=(), **kinds):
    """0 to n - 1 in a row, and further nodes as only or other children of some."""
    pairs = [(i, i + 1) for i in range(n - 1)] + [(p, n + k) for k, p in enumerate(side)]
    g = Graph(spark, parse_schema(CHAIN)).bind_nodes("N", spark.range(n + len(side)).select("id", (-F.col("id")).alias("v")))
    return g.bind_edges("N", "next", spark.createDataFrame(pairs, "src long, dst long"), distinct=True, one_source=True, **kinds)


def longest_key(forest):
    return forest.rows().agg(F.max(F.size("o1_1x_p"))).first()[0]


def test_keys_of_a_chain_are_of_one_size_and_those_of_a_tree_grow_with_its_forks(spark):
    assert longest_key(Forest(chain(spark, 40, one_target=True), NEXT)) == 2
    assert longest_key(Forest(chain(spark, 40), NEXT)) == 2
    n, side = 40, [10, 30, 41]  # 40 stands below 10, 41 below 30, and 42 below 41
    tree = Forest(chain(spark, n, side), NEXT)
    assert longest_key(tree) == 6
    rows = [(r["id"], r["depth"], r["parent_id"]) for r in tree.flat().collect()]
    main = lambda a, b: [(i, i, i - 1 if i else None) for i in range(a, b)]
    assert rows == [*main(0, 11), (40, 11, 10), *main(11, 31), (41, 31, 30), (42, 32, 41), *main(31, 40)]
    assert [r["id"] for r in Forest(chain(spark, n, side), NEXT, max_depth=2).flat().collect()] == [0, 1, 2]
