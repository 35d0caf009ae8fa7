"""The driver's tables as a graph: foreign keys become edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Schema, parse_schema
from .graph import Graph


def _type(name: str, properties: str, edges: str = "", rollups: list | None = None, indexes: list | None = None) -> dict:
    """Short form: "name:string age:int", "edge>Target<reverse"."""
    out = {"name": name, "properties": [dict(zip(("name", "type"), p.split(":"), strict=True)) for p in properties.split()], "edges": [], "rollups": rollups or [], "indexes": [{"fields": i} for i in indexes or []]}
    for e in edges.split():
        edge, rest = e.split(">")
        target, reverse = rest.split("<")
        out["edges"].append({"name": edge, "target": target, "reverse": reverse})
    return out


def _field(name: str, direction: str = "asc", kind: str = "property") -> dict:
    return {"field": name, "direction": direction, "kind": kind}


SCHEMA = {
    "types": [
        _type("Region", "r_name:string", "nations>Nation<region", [{"name": "nation_count", "count": "nations"}], [[_field("r_name")]]),
        _type("Nation", "n_name:string", "region>Region<nations customers>Customer<nation suppliers>Supplier<nation", [{"name": "region_name", "traverse": {"edge": "region", "property": "r_name"}}, {"name": "customer_count", "count": "customers"}], [[_field("n_name")]]),
        _type(
            "Customer", "c_name:string c_acctbal:number c_mktsegment:string", "nation>Nation<customers orders>Order<customer",
            [
                {"name": "order_count", "count": "orders"}, {"name": "nation_name", "traverse": {"edge": "nation", "property": "n_name"}},
                {"name": "latest_status", "first": {"edge": "orders", "field": "o_orderdate", "direction": "desc", "property": "o_orderstatus"}},
                {"name": "latest_order", "first": {"edge": "orders", "field": "o_orderdate", "direction": "desc"}},
                {"name": "oldest_order", "last": {"edge": "orders", "field": "o_orderdate", "direction": "desc"}},
                {"name": "cheapest_price", "first": {"edge": "orders", "field": "o_totalprice", "property": "o_totalprice"}},
            ],
            [[_field("c_mktsegment"), _field("c_acctbal", "desc")], [_field("c_acctbal", "desc")]],
        ),
        _type("Supplier", "s_name:string s_acctbal:number", "nation>Nation<suppliers items>LineItem<supplier", [{"name": "item_count", "count": "items"}], [[_field("s_name")]]),
        _type("Part", "p_name:string p_brand:string p_type:string p_size:int p_retailprice:number", "items>LineItem<part", [{"name": "item_count", "count": "items"}], [[_field("p_size"), _field("p_retailprice")]]),
        _type(
            "Order", "o_orderstatus:string o_totalprice:number o_orderdate:string o_orderpriority:string", "customer>Customer<orders items>LineItem<order",
            [
                {"name": "item_count", "count": "items"}, {"name": "customer_name", "traverse": {"edge": "customer", "property": "c_name"}},
                {"name": "customer_nation", "traverse": {"edge": "customer", "property": "nation_name"}},
            ],
            [[_field("customer", kind="edge"), _field("o_orderdate", "desc")], [_field("o_orderdate", "desc")]],
        ),
        _type("LineItem", "l_linenumber:int l_quantity:number l_extendedprice:number l_discount:number l_tax:number l_returnflag:string l_linestatus:string l_shipdate:string", "order>Order<items part>Part<items supplier>Supplier<items"),
        _type("User", "", "events>Event<user", [{"name": "event_count", "count": "events"}, {"name": "latest_type", "first": {"edge": "events", "field": "ts", "direction": "desc", "property": "event_type"}}]),
        _type("Event", "ts:string event_type:string value:number", "user>User<events", None, [[_field("user", kind="edge"), _field("ts", "desc")]]),
        _type("Document", "lang:string source:string n_chars:int", "label>Label<document", [{"name": "quality", "traverse": {"edge": "label", "property": "quality"}}]),
        _type("Label", "quality:int toxic:int", "document>Document<label"),
        _type("Turn", "conv_id:int turn:int role:string", "next>Turn<prev prev>Turn<next", None, [[_field("turn")]]),
    ]
}


def schema() -> Schema:
    return parse_schema(SCHEMA)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def warehouse(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the tables under sf_dir.  A line item has no key of its own:
    its id is a 64-bit hash of the five columns that tell line items apart."""
    opened: dict[str, DataFrame] = {}

    def t(name: str):
        """Opens a table when it is first needed, once."""

        def get() -> DataFrame:
            if name not in opened:
                opened[name] = derived[name]() if name in derived else table(spark, sf_dir, name)
            return opened[name]

        return get

    derived = {
        "item": lambda: t("lineitem")().withColumn("id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")),
        "user": lambda: t("events")().select("user_id").distinct(),
        "turn": lambda: t("conversations")().withColumn("id", F.col("conv_id") * 1000 + F.col("turn")),
        "next": lambda: t("turn")().where("turn > 0").select((F.col("id") - 1).alias("src"), F.col("id").alias("dst")),
    }
    g = Graph(spark, schema())
    g.bind_nodes("Region", t("region"), "r_regionkey").bind_nodes("Nation", t("nation"), "n_nationkey")
    g.bind_nodes("Customer", t("customer"), "c_custkey").bind_nodes("Supplier", t("supplier"), "s_suppkey")
    g.bind_nodes("Part", t("part"), "p_partkey").bind_nodes("Order", t("orders"), "o_orderkey")
    g.bind_key("Nation", "region", t("nation"), "n_nationkey", "n_regionkey")
    g.bind_key("Customer", "nation", t("customer"), "c_custkey", "c_nationkey")
    g.bind_key("Supplier", "nation", t("supplier"), "s_suppkey", "s_nationkey")
    g.bind_key("Order", "customer", t("orders"), "o_orderkey", "o_custkey")
    g.bind_nodes("LineItem", t("item"))
    for edge, key in (("order", "l_orderkey"), ("part", "l_partkey"), ("supplier", "l_suppkey")):
        g.bind_key("LineItem", edge, t("item"), "id", key)
    g.bind_nodes("User", t("user"), "user_id").bind_nodes("Event", t("events"), "event_id")
    g.bind_key("Event", "user", t("events"), "event_id", "user_id")
    g.bind_nodes("Document", t("documents"), "doc_id").bind_nodes("Label", t("labels"), "doc_id")
    g.bind_edges("Label", "document", t("labels"), "doc_id", "doc_id", distinct=True, one_target=True, one_source=True)
    g.bind_nodes("Turn", t("turn"))
    g.bind_edges("Turn", "next", t("next"), distinct=True, one_target=True, one_source=True)
    return g
