"""Derived fields of nodes: count, traverse, first and last.

They are columns joined to a type's nodes on demand, never stored, so they
cannot go stale.  A count is one combined aggregation by source.  The first or
last target of each source is a row_number of 1, which Spark limits before the
shuffle, so a source with very many targets ships one row a task.  Edges of one
target (foreign keys) need neither."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import reversed_keys, sort_keys
from ..schema import Rollup, Sort
from ..sources.graph import EdgePairs, Graph


def with_fields(graph: Graph, type_name: str, names: Iterable[str] | None = None) -> DataFrame:
    """(id, properties, the named rollups; all if names is None) of a type."""
    t = graph.schema[type_name]
    wanted = [r for r in t.rollups if names is None or r in set(names)]
    df = graph.nodes(type_name)
    for name in wanted:
        df = _join(graph, df, type_name, t.rollups[name])
    return df


def _join(graph: Graph, df: DataFrame, type_name: str, r: Rollup) -> DataFrame:
    values = rollup_values(graph, type_name, r).withColumnRenamed("src", "id")
    out = df.join(values, "id", "left")
    return out.withColumn(r.name, F.coalesce(F.col(r.name), F.lit(0).cast("long"))) if r.kind == "count" else out


def rollup_values(graph: Graph, type_name: str, r: Rollup) -> DataFrame:
    """(src, value named as the rollup) of the sources that have a target."""
    edge = graph.schema.edge(type_name, r.edge)
    bound = graph.edges(type_name, r.edge)
    targets = graph.nodes(edge.target)
    if r.kind == "count":
        return bound.pairs.groupBy("src").agg(F.count(F.lit(1)).alias(r.name))
    sorts = [Sort(r.field, r.direction)] if r.kind != "traverse" else [edge.sort] if edge.sort else []
    needed = [f for f in {r.property, *(s.field for s in sorts)} if f and f != "id"]
    targets = with_fields(graph, edge.target, needed).select("id", *needed)
    first = first_targets(bound, targets, sorts, last=r.kind == "last")
    return first.select("src", (F.col("id") if r.property in (None, "id") else F.col(f"`{r.property}`")).alias(r.name))


def first_targets(bound: EdgePairs, targets: DataFrame, sorts: list[Sort], last: bool = False) -> DataFrame:
    """(src, columns of targets): each source's first target by sorts, then id;
    or its last, which is the first of the whole order backwards."""
    pairs = bound.pairs.withColumnRenamed("dst", "id")
    if bound.one_target:
        return pairs.join(targets, "id")
    if not sorts:
        return pairs.groupBy("src").agg((F.max if last else F.min)("id").alias("id")).join(targets, "id")
    order: list[Column] = reversed_keys(sorts) if last else sort_keys(sorts)
    ranked = pairs.join(targets, "id").withColumn("__rank", F.row_number().over(Window.partitionBy("src").orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")
