"""Binding of a schema to DataFrames: one of nodes for each type and one of
(src, dst) pairs for each edge pair."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Schema


@dataclass(frozen=True)
class EdgePairs:
    """pairs: (src, dst), each pair once.  one_target: a src has one dst at
    most; one_source: a dst has one src at most (both allow cheaper plans)."""

    pairs: DataFrame
    one_target: bool = False
    one_source: bool = False

    def swapped(self) -> EdgePairs:
        pairs = self.pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return EdgePairs(pairs, self.one_source, self.one_target)


Source = DataFrame | Callable[[], DataFrame]


def _frame(source: Source) -> DataFrame:
    return source if isinstance(source, DataFrame) else source()


class Graph:
    """Nodes and edges of a schema.  Frames are lazy; nothing is collected.  A
    source may be a function: it is opened when a query first needs it."""

    def __init__(self, spark: SparkSession, schema: Schema, nodes: dict[str, Source] | None = None, edges: dict[tuple[str, str], EdgePairs | Callable[[], EdgePairs]] | None = None):
        self.spark, self.schema = spark, schema
        self._nodes: dict[str, Source] = dict(nodes or {})
        self._edges: dict[tuple[str, str], EdgePairs | Callable[[], EdgePairs]] = dict(edges or {})

    # ------------------------------------------------------------- binding

    def bind_nodes(self, type_name: str, df: Source, key: str = "id", **columns: str) -> Graph:
        """Nodes of a type from df: key and the columns of its properties (by
        their own name unless given)."""
        t = self.schema[type_name]
        named = {p: columns.get(p, p) for p in t.properties}
        self._nodes[type_name] = lambda: _frame(df).select(F.col(key).cast("long").alias("id"), *(F.col(c).alias(p) for p, c in named.items()))
        return self

    def bind_edges(self, type_name: str, edge: str, df: Source, src: str = "src", dst: str = "dst", distinct: bool = False, one_target: bool = False, one_source: bool = False) -> Graph:
        """Pairs of an edge, seen from type_name; its reverse is bound with it.
        distinct: the pairs are known to be different."""
        self.schema.edge(type_name, edge)

        def bound() -> EdgePairs:
            pairs = _frame(df).select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).where("src is not null and dst is not null")
            if self.schema.is_symmetric(type_name, edge):
                pairs = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
            elif not distinct:
                pairs = pairs.distinct()
            return EdgePairs(pairs, one_target, one_source)

        self._edges[type_name, edge] = bound
        return self

    def bind_key(self, type_name: str, edge: str, df: Source, id_col: str, key: str) -> Graph:
        """A foreign key: each row of df (a node of type_name) has one target."""
        return self.bind_edges(type_name, edge, df, id_col, key, distinct=True, one_target=True)

    # ------------------------------------------------------------- reading

    def nodes(self, type_name: str) -> DataFrame:
        """(id, properties...) of all nodes of a type."""
        t = self.schema[type_name]
        if type_name not in self._nodes:
            return self.spark.createDataFrame([], t.struct())
        self._nodes[type_name] = found = _frame(self._nodes[type_name])
        return found

    def edges(self, type_name: str, edge: str) -> EdgePairs:
        """Pairs of an edge from type_name's end."""
        e = self.schema.edge(type_name, edge)
        for key in ((type_name, edge), (e.target, e.reverse)):
            if key in self._edges:
                found = self._edges[key]
                self._edges[key] = found = found if isinstance(found, EdgePairs) else found()
                return found if key == (type_name, edge) else found.swapped()
        return EdgePairs(self.spark.createDataFrame([], "src long, dst long"), True, True)

    def edge_names(self) -> list[tuple[str, str]]:
        """One end of each edge pair: the first in order of declaration."""
        seen, out = set(), []
        for t in self.schema.types.values():
            for e in t.edges.values():
                if (e.target, e.reverse) not in seen:
                    seen.add((t.name, e.name))
                    out.append((t.name, e.name))
        return out

    def replaced(self, nodes: dict[str, Source], edges: dict[tuple[str, str], EdgePairs | Callable[[], EdgePairs]]) -> Graph:
        return Graph(self.spark, self.schema, nodes, edges)

    # ------------------------------------------------------------- look-ups

    def get(self, type_name: str, node_id: int) -> DataFrame:
        return self.nodes(type_name).where(F.col("id") == node_id)

    def has_edge(self, type_name: str, src: int, edge: str, dst: int) -> bool:
        return not self.edges(type_name, edge).pairs.where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def node_count(self) -> DataFrame:
        """(type, n) of every type."""
        parts = [self.nodes(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("type"), "n") for t in self.schema.types]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def source_counts(self, type_name: str, edge: str) -> DataFrame:
        """(id, n): how many sources point at each target of an edge."""
        pairs = self.edges(type_name, edge).pairs
        return pairs.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))

    def sources(self, type_name: str, edge: str, target: int) -> DataFrame:
        return self.edges(type_name, edge).pairs.where(F.col("dst") == target).select(F.col("src").alias("id"))
