"""The registered queries of the graph engine, one or more an operator, each
with the same question as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.ordering import numbered, sort_keys
from .operators.events import diff, in_order, window_state
from .operators.mutations import LOG, as_of, dangling_links, delete_nodes, watch
from .operators.rollups import with_fields
from .operators.select import edge_targets, filtered, linked, roots
from .operators.view import Expansion, Forest, View, clamp_offset
from .plans.access import explain_query
from .plans.query import Filter, analyze, parse_query, query, select
from .schema import Sort, parse_schema
from .sdk import Database
from .sources.graph import Graph
from .sources.warehouse import warehouse
from .streaming.live import LiveView

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}

NESTED = {
    "root": "Region", "sort": [{"field": "r_name"}],
    "edges": [{
        "name": "nations", "sort": [{"field": "n_name", "direction": "desc"}],
        "edges": [{"name": "customers", "sort": [{"field": "c_acctbal", "direction": "desc"}]}],
    }],
}


def entry(sql: str | None = None, name: str | None = None):
    """Register a function of the warehouse graph under its name, with its SQL."""

    def add(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(warehouse(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


# ------------------------------------------------------------ scans and filters


@entry("SELECT c_custkey AS id, c_name, c_acctbal, c_mktsegment FROM customer")
def scan_customer(g):
    return roots(g, "Customer")


@entry("SELECT o_orderkey AS id, o_orderstatus, o_totalprice, c_name AS customer_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 42")
def get_by_id(g):
    # an id is looked up past the filters
    return roots(g, "Order", [Filter("o_totalprice", "lt", -1.0)], node_id=42, also=["customer_name"]).select("id", "o_orderstatus", "o_totalprice", "customer_name")


@entry("SELECT c_custkey AS id, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'")
def filter_eq(g):
    return filtered(g, "Customer", [Filter("c_mktsegment", "eq", "MACHINERY")]).select("id", "c_name")


@entry("SELECT c_custkey AS id, c_name FROM customer WHERE c_mktsegment IS DISTINCT FROM 'MACHINERY'")
def filter_neq(g):
    return filtered(g, "Customer", [Filter("c_mktsegment", "neq", "MACHINERY")]).select("id", "c_name")


@entry("SELECT c_custkey AS id, c_acctbal FROM customer WHERE c_acctbal > 5000")
def filter_gt(g):
    return filtered(g, "Customer", [Filter("c_acctbal", "gt", 5000)]).select("id", "c_acctbal")


@entry("SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size >= 25")
def filter_gte(g):
    return filtered(g, "Part", [Filter("p_size", "gte", 25)]).select("id", F.col("p_size").cast("long"))


@entry("SELECT c_custkey AS id, c_acctbal FROM customer WHERE c_acctbal IS NULL OR c_acctbal < 0")
def filter_lt(g):
    return filtered(g, "Customer", [Filter("c_acctbal", "lt", 0.0)]).select("id", "c_acctbal")


@entry("SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size IS NULL OR p_size <= 5")
def filter_lte(g):
    return filtered(g, "Part", [Filter("p_size", "lte", 5)]).select("id", F.col("p_size").cast("long"))


@entry("SELECT c_custkey AS id, c_mktsegment FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')")
def filter_in(g):
    q = analyze(g.schema, parse_query({"root": "Customer", "filter": [{"field": "c_mktsegment", "op": "in", "value": ["MACHINERY", "BUILDING"]}]}))
    return filtered(g, q.root, q.filters).select("id", "c_mktsegment")


def _missing(op: str, value, condition: str) -> None:
    @entry(f"SELECT d.doc_id AS id, CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE {condition}", f"filter_missing_{op}_{'null' if value is None else value}")
    def _(g):
        return filtered(g, "Document", [Filter("quality", op, value)]).select("id", F.col("quality").cast("long"))


_missing("eq", None, "l.quality IS NULL")
_missing("neq", None, "l.quality IS NOT NULL")
_missing("neq", 1, "l.quality IS DISTINCT FROM 1")
_missing("lt", 1, "l.quality IS NULL OR l.quality < 1")
_missing("lte", 0, "l.quality IS NULL OR l.quality <= 0")
_missing("gt", None, "l.quality IS NOT NULL")
_missing("gte", None, "TRUE")
_missing("lt", None, "FALSE")
_missing("lte", None, "l.quality IS NULL")


@entry("SELECT p_partkey AS id FROM part WHERE p_size > 25.5")
def filter_int_by_number(g):
    return filtered(g, "Part", [Filter("p_size", "gt", 25.5)]).select("id")


@entry("SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def filter_strict_tags(g):
    """An int is below every number and null below every int: `lte -25.5` holds
    for all, `gt -1` for ints of 0 and more; what is left lacks the field."""
    return filtered(g, "Document", [Filter("quality", "lte", -25.5), Filter("quality", "lt", 0)], strict_tags=True).select("id")


@entry("SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000 AND o_orderpriority IS DISTINCT FROM '1-URGENT'")
def filter_and(g):
    where = [Filter("o_orderstatus", "eq", "O"), Filter("o_totalprice", "gte", 100000), Filter("o_orderpriority", "neq", "1-URGENT")]
    return filtered(g, "Order", where).select("id", "o_totalprice")


@entry("SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def filter_cross_edge(g):
    return filtered(g, "Order", [Filter("customer.c_mktsegment", "eq", "BUILDING")]).select("id")


@entry("SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def filter_cross_edge_deep(g):
    return filtered(g, "Order", [Filter("customer.nation.region.r_name", "eq", "ASIA")]).select("id")


@entry("SELECT c_custkey AS id FROM customer WHERE c_custkey <= 10 AND c_custkey IS DISTINCT FROM 3")
def filter_by_id(g):
    return filtered(g, "Customer", [Filter("id", "lte", 10), Filter("id", "neq", 3)]).select("id")


# --------------------------------------------------------------- sort and page


@entry("SELECT c_custkey AS id, ROW_NUMBER() OVER (ORDER BY c_mktsegment ASC NULLS FIRST, c_acctbal DESC NULLS LAST, c_custkey) - 1 AS pos FROM customer")
def sort_multi(g):
    return numbered(roots(g, "Customer"), sort_keys([Sort("c_mktsegment"), Sort("c_acctbal", "desc")])).select("id", "pos")


@entry("SELECT o_orderkey AS id, ROW_NUMBER() OVER (ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey) - 1 AS pos FROM orders")
def sort_desc_ties(g):
    return numbered(roots(g, "Order"), sort_keys([Sort("o_orderpriority", "desc")])).select("id", "pos")


@entry("SELECT d.doc_id AS id, ROW_NUMBER() OVER (ORDER BY l.quality DESC NULLS LAST, d.doc_id) - 1 AS pos FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def sort_missing_desc(g):
    return numbered(roots(g, "Document", sorts=[Sort("quality", "desc")]), sort_keys([Sort("quality", "desc")])).select("id", "pos")


def _page(g, offset: int) -> DataFrame:
    forest = Forest(g, query("Customer", sort=["-c_acctbal"]))
    return forest.window(clamp_offset(forest.total(), offset, 30), 30).select("id", "pos")


@entry("SELECT id, pos FROM (SELECT c_custkey AS id, ROW_NUMBER() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) - 1 AS pos FROM customer) WHERE pos >= 100 AND pos < 130")
def viewport(g):
    return _page(g, 100)


@entry("SELECT id, pos FROM (SELECT c_custkey AS id, ROW_NUMBER() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer) WHERE pos >= n - 30")
def viewport_clamped(g):
    return _page(g, 10**9)


@entry("SELECT c_custkey AS id, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 5000 ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 30")
def top_customers(g):
    q = query("Customer", where=[("c_mktsegment", "eq", "MACHINERY"), ("c_acctbal", "gt", 5000)], sort=["-c_acctbal"])
    return roots(g, q.root, q.filters, q.sorts).orderBy(*sort_keys(q.sorts)).limit(30).select("id", "c_name", "c_acctbal")


# ----------------------------------------------------------------------- edges


@entry("SELECT c_custkey AS src, o_orderkey AS id, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey")
def edge_targets_all(g):
    return edge_targets(g, "Customer", "orders", names=["o_totalprice"])[0].select("src", "id", "o_totalprice")


@entry("SELECT o_orderkey AS id, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_custkey = 7")
def edge_targets_of_one(g):
    df, order = edge_targets(g, "Customer", "orders", 7)
    return df.withColumn("pos", (F.row_number().over(Window.partitionBy("src").orderBy(*order)) - 1).cast("long")).select("id", "pos")


@entry("""SELECT o_custkey AS src, o_orderkey AS dst, FALSE AS next FROM orders
UNION ALL SELECT a.o_custkey, b.o_orderkey, TRUE FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 AND b.o_custkey = a.o_custkey""")
def has_edge(g):
    # asked: each order's customer about it and about the next order
    own = g.edges("Order", "customer").pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(False).alias("next"))
    asked = own.unionByName(own.select("src", (F.col("dst") + 1).alias("dst"), F.lit(True).alias("next")))
    return linked(g, "Customer", "orders", asked)


@entry("SELECT o_custkey AS src, o_orderkey AS dst FROM orders")
def has_edge_all(g):
    # asked: each order with its own customer and with the customer of the next number
    own = g.edges("Order", "customer").pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    asked = own.unionByName(own.select((F.col("src") + 1).alias("src"), "dst"))
    return linked(g, "Customer", "orders", asked)


@entry("SELECT o_orderkey AS src, o_custkey AS dst FROM orders")
def reverse_edges(g):
    return g.edges("Order", "customer").pairs.select("src", "dst")


@entry("SELECT p_partkey AS id, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def inverted_counts(g):
    return g.source_counts("LineItem", "part")


# ------------------------------------------------------------------- traversal


@entry("""SELECT o_custkey AS parent_id, o_orderkey AS id, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) - 1 AS pos
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'""")
def hop_filtered_sorted(g):
    q = query("Customer", select("orders", where=[("o_orderstatus", "eq", "F")], sort=["-o_totalprice"]), where=[("c_mktsegment", "eq", "BUILDING")])
    rows = Forest(g, q).rows().where("type = 'Order'")
    place = Window.partitionBy("parent_id").orderBy(F.col("o1_1x_0").desc_nulls_last(), "id")
    return rows.select("parent_id", "id", (F.row_number().over(place) - 1).cast("long").alias("pos"))


NESTED_SQL = """WITH v AS (
  SELECT 'Region' AS type, CAST(r_regionkey AS BIGINT) AS id, NULL AS parent_id, 0 AS depth, r_name AS k0, CAST(r_regionkey AS BIGINT) AS i0, NULL AS k1, NULL AS i1, NULL AS k2, NULL AS i2 FROM region
  UNION ALL SELECT 'Nation', n_nationkey, r_regionkey, 1, r_name, r_regionkey, n_name, n_nationkey, NULL, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'Customer', c_custkey, n_nationkey, 2, r_name, r_regionkey, n_name, n_nationkey, c_acctbal, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
) SELECT type, id, CAST(parent_id AS BIGINT) AS parent_id, CAST(depth AS INTEGER) AS depth,
  ROW_NUMBER() OVER (ORDER BY k0, i0, i1 IS NOT NULL, k1 DESC NULLS LAST, i1, i2 IS NOT NULL, k2 DESC NULLS LAST, i2) - 1 AS pos FROM v"""


@entry(NESTED_SQL)
def nested_three_level(g):
    return Forest(g, parse_query(NESTED)).positions().select("type", "id", "parent_id", "depth", "pos")


@entry("""WITH v AS (
  SELECT 'Nation' AS type, CAST(n_nationkey AS BIGINT) AS id, NULL AS edge, n_name AS k0, n_nationkey AS i0, NULL AS e, NULL AS k1, NULL AS i1 FROM nation
  UNION ALL SELECT 'Customer', c_custkey, 'customers', n_name, n_nationkey, 1, c_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'Supplier', s_suppkey, 'suppliers', n_name, n_nationkey, 2, s_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
) SELECT type, id, edge, ROW_NUMBER() OVER (ORDER BY k0, i0, e NULLS FIRST, k1 NULLS FIRST, i1 NULLS FIRST) - 1 AS pos FROM v""")
def sibling_edges(g):
    q = query("Nation", select("suppliers", sort=["s_name"]), select("customers", sort=["c_name"]), sort=["n_name"])
    return Forest(g, q).positions().select("type", "id", "edge", "pos")


@entry("""WITH v AS (
  SELECT 'Region' AS type, CAST(r_regionkey AS BIGINT) AS id, NULL AS parent_id, NULL AS edge, 0 AS depth, r_name AS k0, NULL AS k1, NULL AS k2, NULL AS i2 FROM region
  UNION ALL SELECT 'Customer', c_custkey, r_regionkey, 'nations', 1, r_name, n_name, c_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
) SELECT type, id, CAST(parent_id AS BIGINT) AS parent_id, edge, CAST(depth AS INTEGER) AS depth, ROW_NUMBER() OVER (ORDER BY k0, k1 NULLS FIRST, k2 NULLS FIRST, i2 NULLS FIRST) - 1 AS pos FROM v""")
def virtual_edge(g):
    q = query("Region", select("nations", select("customers", sort=["c_name"]), sort=["n_name"], virtual=True), sort=["r_name"])
    return Forest(g, q).positions().select("type", "id", "parent_id", "edge", "depth", "pos")


@entry("""SELECT 'Customer' AS type, CAST(c_custkey AS BIGINT) AS id, CAST(0 AS INTEGER) AS depth,
  ROW_NUMBER() OVER (ORDER BY n_name DESC NULLS LAST, n_nationkey, c_acctbal DESC NULLS LAST, c_custkey) - 1 AS pos FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def virtual_root(g):
    q = query("Nation", select("customers", sort=["-c_acctbal"]), sort=["-n_name"], virtual=True)
    return Forest(g, q).positions().select("type", "id", "depth", "pos")


@entry("SELECT 'Order' AS type, o_orderkey AS id, CAST(0 AS INTEGER) AS depth, ROW_NUMBER() OVER (ORDER BY c_name, c_custkey, o_orderdate DESC NULLS LAST, o_orderkey) - 1 AS pos FROM orders JOIN customer ON o_custkey = c_custkey")
def virtual_root_all(g):
    q = query("Customer", select("orders", sort=["-o_orderdate"]), sort=["c_name"], virtual=True)
    return Forest(g, q).positions().select("type", "id", "depth", "pos")


@entry("""WITH RECURSIVE r AS (
  SELECT conv_id * 1000 + turn AS id, CAST(NULL AS BIGINT) AS parent_id, 0 AS depth, conv_id FROM conversations WHERE turn = 0
  UNION ALL SELECT c.conv_id * 1000 + c.turn, r.id, r.depth + 1, c.conv_id FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.depth + 1
) SELECT id, parent_id, CAST(depth AS INTEGER) AS depth, ROW_NUMBER() OVER (ORDER BY conv_id, depth) - 1 AS pos FROM r""")
def recursive_chain(g):
    q = query("Turn", select("next", recursive=True), where=[("turn", "eq", 0)])
    return Forest(g, q).positions().select("id", "parent_id", "depth", "pos")


def _one_type(name: str, properties: dict[str, str], edge: str, reverse: str) -> dict:
    """A schema of one type with an edge to itself."""
    ends = [{"name": edge, "target": name, "reverse": reverse}, {"name": reverse, "target": name, "reverse": edge}]
    return {"types": [{"name": name, "properties": [{"name": n, "type": k} for n, k in properties.items()], "edges": ends[: 2 if edge != reverse else 1]}]}


#: turns of a conversation lead to the next and to the one after
SKIP_SCHEMA = _one_type("Turn", {"turn": "int"}, "later", "earlier")


@entry("""WITH RECURSIVE r AS (
  SELECT conv_id, turn, [conv_id] AS path FROM conversations WHERE turn = 0
  UNION ALL SELECT c.conv_id, c.turn, list_append(r.path, -c.turn) FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn IN (r.turn + 1, r.turn + 2)
), places AS (SELECT conv_id, turn, min(path) AS path FROM r GROUP BY conv_id, turn)
SELECT conv_id * 1000 + turn AS id, CASE len(path) WHEN 1 THEN NULL WHEN 2 THEN conv_id * 1000 ELSE conv_id * 1000 - path[len(path) - 1] END AS parent_id,
  CAST(len(path) - 1 AS INTEGER) AS depth, ROW_NUMBER() OVER (ORDER BY path) - 1 AS pos FROM places""")
def recursive_dag(g):
    """Each turn is reached on many paths and stands at the first of its places."""
    turns = g.nodes("Turn").select("id", "turn", "conv_id")
    ahead = turns.select(F.col("id").alias("src"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    pairs = ahead.select("src", (F.col("src") + F.col("k")).alias("dst")).join(turns.select(F.col("id").alias("dst")), "dst", "left_semi")
    dag = Graph(g.spark, parse_schema(SKIP_SCHEMA)).bind_nodes("Turn", turns).bind_edges("Turn", "later", pairs, distinct=True)
    return Forest(dag, query("Turn", select("later", sort=["-turn"], recursive=True), where=[("turn", "eq", 0)])).positions().select("id", "parent_id", "depth", "pos")


CHAIN_SCHEMA = _one_type("Order", {"head": "bool"}, "next", "prev")


@entry("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 200 > 0 THEN o_orderkey - 1 END AS parent_id, CAST(o_orderkey % 200 AS INTEGER) AS depth,
  ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders""")
def recursive_deep(g):
    """Orders as chains of two hundred."""
    orders = g.nodes("Order").select("id", (F.col("id") % 200 == 0).alias("head"))
    pairs = orders.where("NOT head").select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    chain = Graph(g.spark, parse_schema(CHAIN_SCHEMA)).bind_nodes("Order", orders).bind_edges("Order", "next", pairs, distinct=True, one_target=True, one_source=True)
    return Forest(chain, query("Order", select("next", recursive=True), where=[("head", "eq", True)])).positions().select("id", "parent_id", "depth", "pos")


NEIGHBOUR_SCHEMA = _one_type("Nation", {"n_name": "string"}, "neighbours", "neighbours")


@entry("""WITH n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_name, n_nationkey) - 1 AS k, min(n_name) OVER (PARTITION BY n_regionkey) AS leader FROM nation)
SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(k AS INTEGER) AS depth, ROW_NUMBER() OVER (ORDER BY leader, k) - 1 AS pos FROM n""")
def recursive_symmetric(g):
    """Nations of a region are neighbours of each other, and all are roots."""
    nations, within = g.nodes("Nation"), g.edges("Nation", "region").pairs
    pairs = within.join(within.select(F.col("src").alias("other"), "dst"), "dst").where("src <= other").select("src", F.col("other").alias("dst"))
    net = Graph(g.spark, parse_schema(NEIGHBOUR_SCHEMA)).bind_nodes("Nation", nations).bind_edges("Nation", "neighbours", pairs)
    return Forest(net, query("Nation", select("neighbours", sort=["n_name"], recursive=True), sort=["n_name"])).positions().select("id", "depth", "pos")


# ------------------------------------------------------------- sorted edges

#: customers' orders have an order of their own: the dearest first
SORTED_SCHEMA = {
    "types": [
        {
            "name": "Customer", "properties": [{"name": "c_name", "type": "string"}],
            "edges": [{"name": "orders", "target": "Order", "reverse": "customer", "sort": {"property": "o_totalprice", "direction": "desc"}}],
            "rollups": [{"name": "dearest", "traverse": {"edge": "orders", "property": "o_orderpriority"}}],
        },
        {
            "name": "Order", "properties": [{"name": "o_totalprice", "type": "number"}, {"name": "o_orderstatus", "type": "string"}, {"name": "o_orderpriority", "type": "string"}],
            "edges": [{"name": "customer", "target": "Customer", "reverse": "orders"}],
        },
    ]
}


def _sorted_graph(g: Graph) -> Graph:
    out = Graph(g.spark, parse_schema(SORTED_SCHEMA)).bind_nodes("Customer", g.nodes("Customer")).bind_nodes("Order", g.nodes("Order"))
    return out.bind_edges("Order", "customer", g.edges("Order", "customer").pairs, distinct=True, one_target=True)


_DEAREST = "(SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) - 1 AS place FROM orders)"


@entry(f"SELECT o_custkey AS src, o_orderkey AS id, place FROM {_DEAREST}")
def edge_targets_sorted(g):
    df, order = edge_targets(_sorted_graph(g), "Customer", "orders")
    return df.select("src", "id", (F.row_number().over(Window.partitionBy("src").orderBy(*order)) - 1).cast("long").alias("place"))


@entry(f"SELECT c_custkey AS id, o_orderpriority AS dearest FROM customer LEFT JOIN (SELECT * FROM {_DEAREST} WHERE place = 0) ON o_custkey = c_custkey")
def rollup_traverse_sorted(g):
    return with_fields(_sorted_graph(g), "Customer", ["dearest"]).select("id", "dearest")


@entry(f"SELECT c_custkey AS id FROM customer JOIN (SELECT * FROM {_DEAREST} WHERE place = 0) ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def filter_cross_edge_first(g):
    """A dotted path over an edge of many targets reads the first of them."""
    return filtered(_sorted_graph(g), "Customer", [Filter("orders.o_orderstatus", "eq", "F")]).select("id")


# --------------------------------------------------------------------- rollups


@entry("SELECT o_orderkey AS id, count(l_orderkey) AS item_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def rollup_count(g):
    return with_fields(g, "Order", ["item_count"]).select("id", "item_count")


@entry("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def rollup_count_zero(g):
    return filtered(g, "Order", [Filter("item_count", "eq", 0)]).select("id")


@entry("SELECT o_orderkey AS id, c_name AS customer_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def rollup_traverse(g):
    return with_fields(g, "Order", ["customer_name"]).select("id", "customer_name")


@entry("SELECT o_orderkey AS id, n_name AS customer_nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def rollup_traverse_nested(g):
    return with_fields(g, "Order", ["customer_nation"]).select("id", "customer_nation")


_FIRST = "SELECT id, {0} FROM (SELECT c_custkey AS id, {1}, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY {2}) AS r FROM customer LEFT JOIN orders ON o_custkey = c_custkey) WHERE r = 1"


@entry(_FIRST.format("latest_status", "o_orderstatus AS latest_status", "o_orderdate DESC NULLS LAST, o_orderkey"))
def rollup_first(g):
    return with_fields(g, "Customer", ["latest_status"]).select("id", "latest_status")


@entry(_FIRST.format("latest_order", "o_orderkey AS latest_order", "o_orderdate DESC NULLS LAST, o_orderkey"))
def rollup_first_id(g):
    return with_fields(g, "Customer", ["latest_order"]).select("id", "latest_order")


@entry(_FIRST.format("oldest_order", "o_orderkey AS oldest_order", "o_orderdate ASC NULLS FIRST, o_orderkey DESC"))
def rollup_last(g):
    return with_fields(g, "Customer", ["oldest_order"]).select("id", "oldest_order")


@entry("SELECT o_orderkey AS id, count(*) AS item_count FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) >= 5")
def filter_by_rollup(g):
    return filtered(g, "Order", [Filter("item_count", "gte", 5)]).select("id", "item_count")


@entry("SELECT c_custkey AS id, count(o_orderkey) AS order_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def sort_by_rollup(g):
    sorts = [Sort("order_count", "desc")]
    return roots(g, "Customer", sorts=sorts).orderBy(*sort_keys(sorts)).limit(50).select("id", "order_count")


# ----------------------------------------------------------------------- views


@entry("""WITH v AS (
  SELECT 'Region' AS type, CAST(r_regionkey AS BIGINT) AS id, 0 AS depth, r_name AS k0, NULL AS k1 FROM region
  UNION ALL SELECT 'Nation', n_nationkey, 1, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey IN (1, 3)
) SELECT type, id, CAST(depth AS INTEGER) AS depth, TRUE AS has_children, ROW_NUMBER() OVER (ORDER BY k0, k1 NULLS FIRST) - 1 AS pos FROM v""")
def view_flatten(g):
    q = query("Region", select("nations", sort=["n_name"]), sort=["r_name"])
    open_ = Expansion(frozenset({("Region", 1, "nations"), ("Region", 3, "nations")}))
    return Forest(g, q, open_).positions().select("type", "id", "depth", "has_children", "pos")


@entry(NESTED_SQL.replace("FROM v", "FROM v WHERE depth <= 1"))
def view_expand_all_depth(g):
    return Forest(g, parse_query(NESTED), Expansion(all=True, depth=1)).positions().select("type", "id", "parent_id", "depth", "pos")


@entry("SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS total")
def view_total(g):
    return Forest(g, parse_query(NESTED)).rows().agg(F.count(F.lit(1)).alias("total"))


@entry(f"SELECT id, pos FROM ({NESTED_SQL}) WHERE type = 'Customer' AND id = 77")
def view_index_of(g):
    at = Forest(g, parse_query(NESTED)).index_of("Customer", 77)
    return g.spark.createDataFrame([(77, at)], "id long, pos long")


@entry(f"SELECT type, id, pos FROM ({NESTED_SQL}) WHERE pos >= 40 AND pos < 65")
def view_window(g):
    return Forest(g, parse_query(NESTED)).window(40, 25).select("type", "id", "pos")


def _opened(g, limit: int = 0) -> View:
    """Regions with all nations and customers, opened by clicks on two regions and a nation of each."""
    v = View(g, parse_query(NESTED), limit)
    for region, nation in ((1, 1), (3, 6)):
        v.expand("Region", region, "nations")
        v.expand("Nation", nation, "customers")
    return v


_OPEN = f"(SELECT *, ROW_NUMBER() OVER (ORDER BY pos) - 1 AS place FROM ({NESTED_SQL}) WHERE depth = 0 OR (depth = 1 AND parent_id IN (1, 3)) OR (depth = 2 AND parent_id IN (1, 6) AND parent_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))))"
_SHUT = f"(SELECT *, ROW_NUMBER() OVER (ORDER BY pos) - 1 AS place FROM ({NESTED_SQL}) WHERE depth = 0 OR (depth = 1 AND parent_id = 3) OR (depth = 2 AND parent_id = 6 AND parent_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)))"


@entry(f"SELECT type, id, parent_id, depth, place AS pos FROM {_OPEN}")
def view_expand(g):
    return _opened(g).items().select("type", "id", "parent_id", "depth", "pos")


@entry(f"SELECT type, id, parent_id, depth, place AS pos FROM {_SHUT}")
def view_collapse(g):
    """Collapsing a region forgets its nation too: it stays shut when the region opens again."""
    v = _opened(g)
    v.collapse("Region", 1, "nations")
    return v.items().select("type", "id", "parent_id", "depth", "pos")


@entry(f"SELECT type, id, depth, pos FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY pos) - 1 AS p FROM ({NESTED_SQL}) WHERE depth < 1 OR (depth = 1 AND parent_id IN (1, 3)) OR (depth = 2 AND parent_id = 6 AND parent_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3))) AS v(type, id, x, depth, y, pos)")
def view_toggle(g):
    v = _opened(g)
    shut, opened = v.toggle("Region", 1, "nations"), v.toggle("Region", 1, "nations")
    assert not shut and opened and v.is_expanded("Region", 1, "nations") and not v.is_expanded("Nation", 1, "customers")
    return v.items().select("type", "id", "depth", "pos")


@entry("SELECT 'Region' AS type, CAST(r_regionkey AS BIGINT) AS id, ROW_NUMBER() OVER (ORDER BY r_name, r_regionkey) - 1 AS pos FROM region")
def view_collapse_all(g):
    v = _opened(g)
    v.expand_all()
    v.collapse_all()
    return v.items().select("type", "id", "pos")


@entry(f"SELECT type, id, pos FROM ({NESTED_SQL}) WHERE pos >= 52 AND pos < 62")
def view_scroll_by(g):
    v = View(g, parse_query(NESTED), 10)
    v.expand_all()
    v.scroll_to(60)
    v.scroll_by(-8)
    return v.items().select("type", "id", "pos")


@entry(f"SELECT type, id, pos FROM (SELECT *, count(*) OVER () AS n, max(CASE WHEN type = 'Customer' AND id = 77 THEN pos END) OVER () AS there FROM ({NESTED_SQL})) WHERE pos >= least(there, n - 10) AND pos < least(there, n - 10) + 10")
def view_scroll_to_node(g):
    v = View(g, parse_query(NESTED), 10)
    v.expand_all()
    v.scroll_to_node("Customer", 77)
    return v.items().select("type", "id", "pos")


@entry(f"SELECT type, id, pos FROM ({NESTED_SQL}) WHERE pos IN (0, 17, 100)")
def view_node_at(g):
    v = View(g, parse_query(NESTED))
    v.expand_all()
    rows = [v.node_at(k) for k in (0, 17, 100)]
    return g.spark.createDataFrame([(r["type"], r["id"], r["pos"]) for r in rows], "type string, id long, pos long")


@entry(f"""WITH n AS (SELECT n_nationkey, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC, n_nationkey) - 1 AS k FROM nation WHERE n_regionkey = 2),
c AS (SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) - 1 AS k FROM customer WHERE c_nationkey = (SELECT n_nationkey FROM n WHERE k = 1))
SELECT type, id, pos FROM ({NESTED_SQL}) WHERE (type = 'Region' AND id = 2) OR (type = 'Nation' AND id = (SELECT n_nationkey FROM n WHERE k = 1)) OR (type = 'Customer' AND id = (SELECT c_custkey FROM c WHERE k = 3))""")
def view_paths(g):
    """What stands at paths of edges and numbers, and where."""
    v = View(g, parse_query(NESTED))
    v.expand_all()
    paths = [(), (("nations", 1),), (("nations", 1), ("customers", 3))]
    rows = [(*v.node_at_path(2, *p), v.path_to_index(2, *p)) for p in paths]
    return g.spark.createDataFrame(rows, "type string, id long, pos long")


@entry(f"SELECT count(*) AS total, greatest(count(*) - 10, 0) AS at, least(count(*), 10) AS shown, 4 AS expanded FROM {_OPEN}")
def view_stats(g):
    v = _opened(g, 10)
    v.scroll_to(10**9)
    s = v.stats()
    return g.spark.createDataFrame([(s["total"], s["offset"], v.visible_count(), s["expanded"])], "total long, at long, shown long, expanded int")


@entry("""SELECT r_name || '|' || n_name AS names, CAST(n_nationkey AS BIGINT) AS id FROM nation JOIN region ON n_regionkey = r_regionkey""")
def view_properties(g):
    forest = Forest(g, query("Region", select("nations")))
    props = forest.with_properties(forest.rows().select("type", "id", "parent_type", "parent_id", "edge", "depth")).where("type = 'Nation'")
    text = lambda f: F.get_json_object("properties", f"$.{f}")
    return props.select(F.concat_ws("|", text("region_name"), text("n_name")).alias("names"), "id")


@entry("""SELECT t AS type, n FROM (VALUES ('Region', (SELECT count(*) FROM region)), ('Nation', (SELECT count(*) FROM nation)), ('Customer', (SELECT count(*) FROM customer)),
('Supplier', (SELECT count(*) FROM supplier)), ('Part', (SELECT count(*) FROM part)), ('Order', (SELECT count(*) FROM orders)), ('LineItem', (SELECT count(*) FROM lineitem)),
('User', (SELECT count(DISTINCT user_id) FROM events)), ('Event', (SELECT count(*) FROM events)), ('Document', (SELECT count(*) FROM documents)), ('Label', (SELECT count(*) FROM labels)),
('Turn', (SELECT count(*) FROM conversations))) AS x(t, n)""")
def node_count(g):
    return g.node_count()


@entry("SELECT 0 AS index_no, 1 AS equality, 'c_acctbal' AS range_field, 0 AS sort_fields, 150 AS score")
def index_coverage(g):
    q = query("Customer", where=[("c_mktsegment", "eq", "MACHINERY"), ("c_acctbal", "gt", 5000)], sort=["-c_acctbal"])
    c = explain_query(g.schema, q, require_index=True)
    return g.spark.createDataFrame([(c.index, c.equality, c.range_field, c.sort, c.score)], "index_no int, equality int, range_field string, sort_fields int, score int")


# -------------------------------------------------------- mutations and events

def _log(seq, op: str, type_name: str, node, props=None, edge: str | None = None, target=None) -> list:
    """The columns of a log row."""
    none = F.lit(None)
    return [
        seq.cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(type_name).alias("type"), node.alias("id"),
        (none if props is None else props).cast("map<string,string>").alias("props"), F.lit(edge).cast("string").alias("edge"), (none if target is None else target).cast("long").alias("target"),
    ]


#: the events table as a log on users: the last event sets a user's state
STATE_SCHEMA = {"types": [{"name": "User", "properties": [{"name": "event_type", "type": "string"}, {"name": "value", "type": "number"}]}]}
T1, T2 = 0.6, 0.8


def _state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    props = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("value"), F.col("value").cast("string"))
    # the numbers from 0 in order of ts are the event ids
    return events.select(*_log(F.col("event_id"), "insert", "User", F.col("user_id"), props)).select(LOG.fieldNames())


def _state_graph(spark: SparkSession) -> Graph:
    return Graph(spark, parse_schema(STATE_SCHEMA))


def _cut(spark: SparkSession, sf_dir: str, share: float) -> int:
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0]
    return int((last + 1) * share)


_AS_OF = "(SELECT user_id AS id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE event_id <= CAST(floor((SELECT max(event_id) + 1 FROM events) * {0}) AS BIGINT) GROUP BY 1)"
_WINDOW = "(SELECT *, ROW_NUMBER() OVER (ORDER BY value DESC NULLS LAST, id) - 1 AS pos FROM " + _AS_OF + " WHERE value > 20 QUALIFY pos < 30)"


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = as_of(_state_graph(spark), _state_log(spark, sf_dir), _cut(spark, sf_dir, T1))
    return g.nodes("User").select("id", "event_type", "value")


QUERIES["snapshot_asof"] = _snapshot
ORACLE_SQL["snapshot_asof"] = f"SELECT * FROM {_AS_OF.format(T1)}"


def _events(kind: str | None) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = query("User", where=[("value", "gt", 20)], sort=["-value"])
        log, base = _state_log(spark, sf_dir), _state_graph(spark)
        old, new = (window_state(as_of(base, log, _cut(spark, sf_dir, t)), q, 0, 30) for t in (T1, T2))
        found = diff(old, new)
        return found.where(F.col("event") == kind).select("id", "from_index", "to_index") if kind else found.select("event", "id", "from_index", "to_index")

    return run


for _kind, _where in (
    ("enter", "a.id IS NULL"), ("leave", "b.id IS NULL"),
    ("change", "a.id = b.id AND (a.event_type IS DISTINCT FROM b.event_type OR a.value IS DISTINCT FROM b.value)"),
    ("move", "a.id = b.id AND a.value IS DISTINCT FROM b.value AND a.pos <> b.pos"),
):
    QUERIES[f"events_{_kind}"] = _events(_kind)
    ORACLE_SQL[f"events_{_kind}"] = f"WITH a AS {_WINDOW.format(T1)}, b AS {_WINDOW.format(T2)} SELECT coalesce(a.id, b.id) AS id, a.pos AS from_index, b.pos AS to_index FROM a FULL JOIN b ON a.id = b.id WHERE {_where}"


_ALL_EVENTS = " UNION ALL ".join(
    f"SELECT '{kind}' AS event, {rank} AS rank, coalesce(a.id, b.id) AS id, a.pos AS from_index, b.pos AS to_index FROM a FULL JOIN b ON a.id = b.id WHERE {where}"
    for kind, rank, where in (
        ("leave", 1, "b.id IS NULL"), ("enter", 2, "a.id IS NULL"),
        ("change", 3, "a.id = b.id AND (a.event_type IS DISTINCT FROM b.event_type OR a.value IS DISTINCT FROM b.value)"),
        ("move", 4, "a.id = b.id AND a.value IS DISTINCT FROM b.value AND a.pos <> b.pos"),
    )
)
_WINDOWS = f"WITH a AS {_WINDOW.format(T1)}, b AS {_WINDOW.format(T2)}, e AS ({_ALL_EVENTS})"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live view that takes in the log in two batches: the events of the second."""
    log, first, second = _state_log(spark, sf_dir), _cut(spark, sf_dir, T1), _cut(spark, sf_dir, T2)
    live = LiveView(_state_graph(spark), query("User", where=[("value", "gt", 20)], sort=["-value"]), lambda events, batch: None, height=30)
    live.apply(log.where(F.col("seq") <= first), 0)
    return live.apply(log.where((F.col("seq") > first) & (F.col("seq") <= second)), 1).select("event", "id", "from_index", "to_index")


QUERIES["live_view"] = _live
ORACLE_SQL["live_view"] = f"{_WINDOWS} SELECT event, id, from_index, to_index FROM e"


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the order in which a viewer applies them (as many as the window allows)."""
    q = query("User", where=[("value", "gt", 20)], sort=["-value"])
    log, base = _state_log(spark, sf_dir), _state_graph(spark)
    old, new = (window_state(as_of(base, log, _cut(spark, sf_dir, t)), q, 0, 30) for t in (T1, T2))
    rows = in_order(diff(old, new)).select("event", "id").collect()
    return spark.createDataFrame([(n, r["event"], r["id"]) for n, r in enumerate(rows)], "n long, event string, id long")


QUERIES["events_in_order"] = _ordered
ORACLE_SQL["events_in_order"] = f"""{_WINDOWS} SELECT event, id, ROW_NUMBER() OVER (
  ORDER BY rank > 1, CASE WHEN rank = 1 THEN -from_index ELSE to_index END, rank, id) - 1 AS n FROM e"""


@entry("""SELECT o_orderkey AS id, o_orderstatus, c_name AS customer_name, (SELECT count(*) FROM lineitem WHERE l_orderkey = 42) AS item_count
FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 42""")
def sdk_get(g):
    """An entity's properties and derived fields."""
    order = Database(g).get("Order", 42)
    row = (order.id(), *(getattr(order, f).get() for f in ("o_orderstatus", "customer_name", "item_count")))
    return g.spark.createDataFrame([row], "id long, o_orderstatus string, customer_name string, item_count long")


@entry("SELECT o_orderkey AS id, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders WHERE o_custkey = 7")
def sdk_edges(g):
    """An entity's targets, one after another."""
    rows = [(e.id(), k) for k, e in enumerate(Database(g).get("Customer", 7).orders)]
    return g.spark.createDataFrame(rows, "id long, place long")


@entry("""SELECT o_orderkey AS id, CASE WHEN o_custkey = 7 THEN 'seven' ELSE c_name END AS customer_name
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey > 0 UNION ALL SELECT 0, 'seven'""")
def sdk_writes(g):
    """A customer is renamed and takes over an order: what all orders show then."""
    db = Database(g)
    customer, order = db.get("Customer", 7), db.get("Order", 0)
    for owner in order.customer:
        order.customer.unlink(owner)
    order.customer.link(customer)
    customer.update(c_name="seven")
    return with_fields(db.graph, "Order", ["customer_name"]).select("id", "customer_name")


@entry("""SELECT CAST(c_custkey AS BIGINT) AS seq, 'link' AS event, 'Nation' AS type, CAST(c_nationkey AS BIGINT) AS id, 'customers' AS edge, c_custkey AS other_id FROM customer
UNION ALL SELECT c_custkey, 'link', 'Customer', c_custkey, 'nation', CAST(c_nationkey AS BIGINT) FROM customer""")
def node_watch_link(g):
    """Links written from the end of few nodes: hot ones."""
    pairs = g.edges("Customer", "nation").pairs
    return watch(g.schema, pairs.select(*_log(F.col("src"), "link", "Nation", F.col("dst"), edge="customers", target=F.col("src")))).select("seq", "event", "type", "id", "edge", "other_id")


@entry("""SELECT o_orderkey AS seq, 'link' AS event, 'Order' AS type, o_orderkey AS id, 'customer' AS edge, o_custkey AS other_id FROM orders
UNION ALL SELECT o_orderkey, 'link', 'Customer', o_custkey, 'orders', o_orderkey FROM orders""")
def node_watch_link_all(g):
    return _watched(g, g.edges("Order", "customer").pairs)


def _watched(g: Graph, pairs: DataFrame) -> DataFrame:
    log = pairs.select(*_log(F.col("src"), "link", "Order", F.col("src"), edge="customer", target=F.col("dst")))
    return watch(g.schema, log).select("seq", "event", "type", "id", "edge", "other_id")


@entry("""SELECT o_orderkey * 3 AS seq, 'change' AS event, 'Order' AS type, o_orderkey AS id, NULL AS edge, NULL AS other_id FROM orders
UNION ALL SELECT o_orderkey * 3 + 1, 'unlink', 'Order', o_orderkey, 'customer', o_custkey FROM orders
UNION ALL SELECT o_orderkey * 3 + 1, 'unlink', 'Customer', o_custkey, 'orders', o_orderkey FROM orders
UNION ALL SELECT o_orderkey * 3 + 2, 'delete', 'Order', o_orderkey, NULL, NULL FROM orders""")
def node_watch_kinds(g):
    """Every order is changed, loses its customer and is deleted."""
    pairs = g.edges("Order", "customer").pairs
    at = F.col("src") * 3
    log = pairs.select(*_log(at, "update", "Order", F.col("src"), F.create_map(F.lit("o_orderstatus"), F.lit("X"))))
    log = log.unionByName(pairs.select(*_log(at + 1, "unlink", "Order", F.col("src"), edge="customer", target=F.col("dst"))))
    log = log.unionByName(pairs.select(*_log(at + 2, "delete", "Order", F.col("src"))))
    return watch(g.schema, log).select("seq", "event", "type", "id", "edge", "other_id")


@entry("""SELECT o_custkey AS src, o_orderkey AS dst FROM orders
UNION SELECT o_custkey + 1, o_orderkey FROM orders WHERE o_custkey + 1 IN (SELECT c_custkey FROM customer)""")
def link_log(g):
    """Each order is linked to the next customer too, from the customer's end,
    twice; links to customers that don't exist do nothing."""
    pairs = g.edges("Order", "customer").pairs
    twice = pairs.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    log = twice.select(*_log(F.col("src") * 2 + F.col("k"), "link", "Customer", F.col("dst") + 1, edge="orders", target=F.col("src")))
    return as_of(g, log).edges("Customer", "orders").pairs.select("src", "dst")


@entry("SELECT o_orderkey AS seq, 'Customer' AS type, 'orders' AS edge, o_custkey + 1 AS src, o_orderkey AS dst FROM orders WHERE o_custkey + 1 NOT IN (SELECT c_custkey FROM customer)")
def link_dangling(g):
    pairs = g.edges("Order", "customer").pairs
    log = pairs.select(*_log(F.col("src"), "link", "Customer", F.col("dst") + 1, edge="orders", target=F.col("src")))
    return dangling_links(g, log)


@entry("SELECT o_orderkey AS id, CASE WHEN c_acctbal < 0 THEN 'in debt' ELSE c_name END AS customer_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def set_property(g):
    """One property of some nodes is set; the fields derived from it follow."""
    poor = g.nodes("Customer").where("c_acctbal < 0")
    log = poor.select(*_log(F.col("id"), "update", "Customer", F.col("id"), F.create_map(F.lit("c_name"), F.lit("in debt"))))
    return with_fields(as_of(g, log), "Order", ["customer_name"]).select("id", "customer_name")


@entry("SELECT CAST(n_nationkey AS BIGINT) AS id, count(c_custkey) AS customer_count FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON c_nationkey = n_nationkey GROUP BY 1")
def delete_cascade(g):
    poor = filtered(g, "Customer", [Filter("c_acctbal", "lt", 0.0)]).select("id")
    return with_fields(delete_nodes(g, "Customer", poor), "Nation", ["customer_count"]).select("id", "customer_count")


@entry("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS customer_id FROM orders WHERE o_orderkey % 11 <> 0")
def link_unlink_log(g):
    """Orders divisible by 7 lose their customer, those by 11 are deleted."""
    pairs = g.edges("Order", "customer").pairs.where("src % 7 = 0")
    log = pairs.select(*_log(F.col("src"), "unlink", "Order", F.col("src"), edge="customer", target=F.col("dst")))
    log = log.unionByName(g.nodes("Order").where("id % 11 = 0").select(*_log(F.col("id"), "delete", "Order", F.col("id"))))
    after = as_of(g, log)
    left = after.edges("Order", "customer").pairs.select(F.col("src").alias("id"), F.col("dst").alias("customer_id"))
    return after.nodes("Order").select("id").join(left, "id", "left")


@entry("SELECT o_orderkey AS id, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def update_merge(g):
    """A later write of a property wins; null removes; others stay."""
    orders = g.nodes("Order")

    def written(rows: DataFrame, seq, value) -> DataFrame:
        return rows.select(*_log(seq, "update", "Order", F.col("id"), F.create_map(F.lit("o_orderpriority"), F.lit(value).cast("string"))))

    first, late = written(orders.where("id % 5 < 2"), F.col("id"), "first"), F.col("id") + 10**9
    later = written(orders.where("id % 5 = 0"), late, "changed").unionByName(written(orders.where("id % 5 = 1"), late, None))
    return as_of(g, first.unionByName(later)).nodes("Order").select("id", "o_orderstatus", "o_orderpriority")

