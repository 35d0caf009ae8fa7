"""Filtered nodes of one type, edge targets and membership."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import sort_keys
from ..functions.predicates import compare
from ..plans.query import Filter, fields_of
from ..schema import Sort
from ..sources.graph import Graph
from .rollups import first_targets, with_fields


def _first_of_path(graph: Graph, type_name: str, path: Sequence[str]) -> DataFrame:
    """(src, value): the last name of the path at the first target of each edge
    before it; sources without a target are left out."""
    hop, *rest = path
    edge = graph.schema.edge(type_name, hop)
    sorts = [edge.sort] if edge.sort else []
    if len(rest) == 1:
        names = [n for n in {rest[0], *(s.field for s in sorts)} if n != "id"]
        targets = with_fields(graph, edge.target, names).select("id", *names)
        return first_targets(graph.edges(type_name, hop), targets, sorts).select("src", F.col(f"`{rest[0]}`").alias("value"))
    names = [s.field for s in sorts if s.field != "id"]
    first = first_targets(graph.edges(type_name, hop), with_fields(graph, edge.target, names).select("id", *names), sorts).select("src", "id")
    deeper = _first_of_path(graph, edge.target, rest).withColumnRenamed("src", "id")
    return first.join(deeper, "id").select("src", "value")


def filtered(graph: Graph, type_name: str, filters: Sequence[Filter] = (), also: Sequence[str] | None = (), strict_tags: bool = False) -> DataFrame:
    """Nodes of a type that pass all filters, with properties and the rollups
    that the filters or `also` name (None: all)."""
    names = None if also is None else fields_of(filters, ()) | set(also)
    df = with_fields(graph, type_name, names)
    conditions = []
    for k, f in enumerate(filters):
        field = f.field
        if "." in field:
            values = _first_of_path(graph, type_name, field.split(".")).select(F.col("src").alias("id"), F.col("value").alias(f"__path{k}"))
            df, field = df.join(values, "id", "left"), f"__path{k}"
        conditions.append(compare(F.col(f"`{field}`"), f.op, f.value, df.schema[field].dataType, strict_tags))
    if conditions:
        df = df.where(reduce(lambda a, b: a & b, conditions))
    return df.drop(*(c for c in df.columns if c.startswith("__path")))


def roots(graph: Graph, type_name: str, filters: Sequence[Filter] = (), sorts: Sequence[Sort] = (), node_id: int | None = None, also: Sequence[str] | None = (), strict_tags: bool = False) -> DataFrame:
    """Root nodes of a query.  An id is looked up past the filters."""
    extra = None if also is None else {*also, *(s.field for s in sorts)}
    if node_id is not None:
        return filtered(graph, type_name, (), extra).where(F.col("id") == node_id)
    return filtered(graph, type_name, filters, extra, strict_tags)


def edge_targets(graph: Graph, type_name: str, edge: str, src: int | None = None, names: Sequence[str] = ()) -> tuple[DataFrame, list]:
    """(src, id, fields) of an edge's targets, of one source or all, and the
    order of each source's targets: the edge's own sort, then id."""
    e = graph.schema.edge(type_name, edge)
    sorts = [e.sort] if e.sort else []
    pairs = graph.edges(type_name, edge).pairs
    if src is not None:
        pairs = pairs.where(F.col("src") == src)
    wanted = [n for n in dict.fromkeys([*names, *(s.field for s in sorts)]) if n != "id"]
    targets = with_fields(graph, e.target, wanted).select("id", *wanted)
    return pairs.withColumnRenamed("dst", "id").join(targets, "id"), sort_keys(sorts)


def linked(graph: Graph, type_name: str, edge: str, wanted: DataFrame) -> DataFrame:
    """The rows of wanted (src, dst) that are linked."""
    return wanted.join(graph.edges(type_name, edge).pairs, ["src", "dst"], "left_semi")
