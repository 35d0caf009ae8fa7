"""Writes as a log, and graphs as of a point of it.

A log row is (seq, op, type, id, props, edge, target): op is insert, update or
delete (type, id, props: property -> text, null removes), link or unlink (type,
id, edge, target).  The graph as of seq is the base graph with the last write of
each property and of each pair; one combined aggregation by key, then a join."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SPARK_TYPES, Schema
from ..sources.graph import EdgePairs, Graph

LOG = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("type", T.StringType()), T.StructField("id", T.LongType()),
    T.StructField("props", T.MapType(T.StringType(), T.StringType())), T.StructField("edge", T.StringType()), T.StructField("target", T.LongType()),
])
NODE_OPS, EDGE_OPS = ("insert", "update", "delete"), ("link", "unlink")


def text_of(value) -> str | None:
    """A property value as the log holds it."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return repr(value) if isinstance(value, float) else str(value)


def log_frame(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), LOG)


def check_values(schema: Schema, type_name: str, props: dict) -> None:
    """Raise unless all names are declared and all values fit their types."""
    declared = schema[type_name].properties
    for name, value in props.items():
        if name not in declared:
            raise ValueError(f"{type_name} has no property {name!r}")
        kind = declared[name]
        fits = value is None or {"bool": isinstance(value, bool), "int": isinstance(value, int) and not isinstance(value, bool), "number": isinstance(value, (int, float)) and not isinstance(value, bool), "string": isinstance(value, str)}[kind]
        if not fits:
            raise ValueError(f"{type_name}.{name} is {kind}, not {value!r}")


def deleted(log: DataFrame, type_name: str) -> DataFrame:
    return log.where((F.col("op") == "delete") & (F.col("type") == type_name)).select("id").distinct()


def _nodes(graph: Graph, log: DataFrame, type_name: str) -> DataFrame:
    t = graph.schema[type_name]
    base = graph.nodes(type_name)
    own = log.where((F.col("type") == type_name) & F.col("op").isin(*NODE_OPS))
    sets = lambda p: F.map_contains_key(F.coalesce("props", F.create_map().cast("map<string,string>")), F.lit(p))
    writes = own.groupBy("id").agg(
        F.max((F.col("op") == "insert").cast("int")).alias("__new"), F.max((F.col("op") == "delete").cast("int")).alias("__gone"),
        *(F.max_by(F.when(sets(p), F.struct(F.col("props")[p].alias("v"))), F.when(sets(p), F.col("seq"))).alias(f"__{p}") for p in t.properties),
    )
    both = base.withColumn("__base", F.lit(1)).join(writes, "id", "full_outer")
    both = both.where(F.coalesce("__gone", F.lit(0)) == 0).where(F.col("__base").isNotNull() | (F.col("__new") == 1))
    kinds = {p: base.schema[p].dataType if p in base.columns else SPARK_TYPES[k] for p, k in t.properties.items()}
    return both.select("id", *(F.when(F.col(f"__{p}").isNotNull(), F.col(f"__{p}")["v"].cast(kinds[p])).otherwise(F.col(f"`{p}`")).alias(p) for p in t.properties))


def canonical_links(graph: Graph, log: DataFrame, type_name: str, edge: str) -> DataFrame:
    """(src, dst, seq, op) of link and unlink rows of an edge pair, written from
    either end, as seen from type_name."""
    e = graph.schema.edge(type_name, edge)
    rows = log.where(F.col("op").isin(*EDGE_OPS))
    ahead = rows.where((F.col("type") == type_name) & (F.col("edge") == edge)).select(F.col("id").alias("src"), F.col("target").alias("dst"), "seq", "op")
    back = rows.where((F.col("type") == e.target) & (F.col("edge") == e.reverse)).select(F.col("target").alias("src"), F.col("id").alias("dst"), "seq", "op")
    return ahead.unionByName(back)


def _ends(graph: Graph, log: DataFrame, rows: DataFrame, type_name: str, end: str) -> DataFrame:
    """rows (with seq) and `known_<end>`: whether the node in the column `end`
    exists at that point: in the base or inserted before, and not deleted before."""
    own = log.where((F.col("type") == type_name) & F.col("op").isin("insert", "delete")).groupBy(F.col("id").alias(end)).agg(
        F.min(F.when(F.col("op") == "insert", F.col("seq"))).alias("__born"), F.min(F.when(F.col("op") == "delete", F.col("seq"))).alias("__died"),
    )
    base = graph.nodes(type_name).select(F.col("id").alias(end), F.lit(True).alias("__base"))
    born = F.coalesce("__base", F.col("__born") < F.col("seq"), F.lit(False))
    found = rows.join(base, end, "left").join(own, end, "left")
    return found.withColumn(f"known_{end}", born & F.coalesce(F.col("__died") > F.col("seq"), F.lit(True))).drop("__base", "__born", "__died")


def _checked_links(graph: Graph, log: DataFrame, type_name: str, edge: str) -> DataFrame:
    """canonical_links() and `fits`: a link fits if both ends exist."""
    links = canonical_links(graph, log, type_name, edge)
    links = _ends(graph, log, _ends(graph, log, links, type_name, "src"), graph.schema.edge(type_name, edge).target, "dst")
    return links.select("src", "dst", "seq", "op", ((F.col("op") == "unlink") | (F.col("known_src") & F.col("known_dst"))).alias("fits"))


def dangling_links(graph: Graph, log: DataFrame) -> DataFrame:
    """(seq, type, edge, src, dst) of the links of a log whose ends don't both
    exist when they are written: errors, which as_of() leaves out."""
    parts = []
    for type_name, edge in graph.edge_names():
        bad = _checked_links(graph, log, type_name, edge).where(~F.col("fits"))
        parts.append(bad.select("seq", F.lit(type_name).alias("type"), F.lit(edge).alias("edge"), "src", "dst"))
    return reduce(DataFrame.unionByName, parts)


def _pairs(graph: Graph, log: DataFrame, type_name: str, edge: str) -> EdgePairs:
    e = graph.schema.edge(type_name, edge)
    last = _checked_links(graph, log, type_name, edge).where("fits").groupBy("src", "dst").agg(F.max_by("op", "seq").alias("op"))
    base = graph.edges(type_name, edge).pairs.withColumn("__base", F.lit(1))
    both = base.join(last, ["src", "dst"], "full_outer").where((F.col("op") == "link") | (F.col("op").isNull() & F.col("__base").isNotNull()))
    kept = both.select("src", "dst")
    kept = kept.join(deleted(log, type_name).withColumnRenamed("id", "src"), "src", "left_anti")
    kept = kept.join(deleted(log, e.target).withColumnRenamed("id", "dst"), "dst", "left_anti")
    return EdgePairs(kept.select("src", "dst"))


def as_of(graph: Graph, log: DataFrame, seq: int | None = None) -> Graph:
    """The graph after all log rows up to seq (None: all).  Deleting a node
    takes its edges with it; ids are not used again.  A link between nodes that
    don't both exist at its point does nothing (dangling_links() lists them)."""
    if seq is not None:
        log = log.where(F.col("seq") <= seq)
    # functions: a query plans only the types and edges that it reads
    nodes = {t: (lambda t=t: _nodes(graph, log, t)) for t in graph.schema.types}
    edges = {key: (lambda key=key: _pairs(graph, log, *key)) for key in graph.edge_names()}
    return graph.replaced(nodes, edges)


def delete_nodes(graph: Graph, type_name: str, ids: DataFrame) -> Graph:
    """The graph without the nodes of ids (a column id) and their edges."""
    ids = ids.select(F.col("id").cast("long")).distinct()

    def nodes_of(t: str) -> DataFrame:
        return graph.nodes(t).join(ids, "id", "left_anti") if t == type_name else graph.nodes(t)

    def pairs_of(t: str, e: str) -> EdgePairs:
        bound = graph.edges(t, e)
        pairs = bound.pairs
        if t == type_name:
            pairs = pairs.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
        if graph.schema.edge(t, e).target == type_name:
            pairs = pairs.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return EdgePairs(pairs.select("src", "dst"), bound.one_target, bound.one_source)

    nodes = {t: (lambda t=t: nodes_of(t)) for t in graph.schema.types}
    edges = {key: (lambda key=key: pairs_of(*key)) for key in graph.edge_names()}
    return graph.replaced(nodes, edges)


def watch(schema: Schema, log: DataFrame, type_name: str | None = None, node_id: int | None = None) -> DataFrame:
    """(seq, event, type, id, edge, other_id): change, delete, link and unlink
    of nodes; a link is an event of both its ends, under the edge's name there."""
    parts = [log.where(F.col("op").isin("update", "delete")).select("seq", F.when(F.col("op") == "update", "change").otherwise("delete").alias("event"), "type", "id", F.lit(None).cast("string").alias("edge"), F.lit(None).cast("long").alias("other_id"))]
    for t in schema.types.values():
        for e in t.edges.values():
            rows = log.where(F.col("op").isin(*EDGE_OPS) & (F.col("type") == t.name) & (F.col("edge") == e.name))
            parts.append(rows.select("seq", F.col("op").alias("event"), F.lit(t.name).alias("type"), "id", F.lit(e.name).alias("edge"), F.col("target").alias("other_id")))
            twice = rows.where(F.col("id") != F.col("target")) if schema.is_symmetric(t.name, e.name) else rows
            parts.append(twice.select("seq", F.col("op").alias("event"), F.lit(e.target).alias("type"), F.col("target").alias("id"), F.lit(e.reverse).alias("edge"), F.col("id").alias("other_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if type_name is not None:
        out = out.where(F.col("type") == type_name)
    return out if node_id is None else out.where(F.col("id") == node_id)
