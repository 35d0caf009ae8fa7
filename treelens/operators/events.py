"""Events of a window: what changes between two snapshots of it.

enter: in the new window only; leave: in the old only; change: in both, a
property differs; move: in both, its own sort key differs and so does its
place.  Neighbours that only shift make no event.  Windows are as long as the
viewport, so the comparison is small whatever the graph's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.query import Query
from ..sources.graph import Graph
from .select import roots
from .view import Expansion, Forest

EVENTS = ("leave", "enter", "change", "move")


def window_state(graph: Graph, q: Query, offset: int = 0, height: int = 0, expansion: Expansion | None = None, include_rollups: bool = False) -> DataFrame:
    """(type, id, pos, sort_key, props) of the rows of a view's window."""
    forest = Forest(graph, q, expansion or Expansion())
    rows = forest.window(offset, height) if height else forest.positions()
    parts = []
    for name in dict.fromkeys(forest._types):
        t = graph.schema[name]
        sorts = _sorts_of(graph, q, name)
        extra = [s.field for s in sorts if s.field in t.rollups]
        fields = roots(graph, name, (), (), None, list(t.rollups) if include_rollups else extra)
        shown = [*t.properties, *(t.rollups if include_rollups else ())]
        opts = {"ignoreNullFields": "false"}
        values = fields.select(
            "id", F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(f"`{p}`") for p in shown)), opts).alias("props"),
            F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(f"`{s.field}`") for s in sorts)), opts).alias("sort_key"),
        )
        parts.append(rows.where(F.col("type") == name).select("type", "id", "pos").join(values, "id", "left"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("type", "id", "pos", "sort_key", "props")


def _sorts_of(graph: Graph, q: Query, type_name: str):
    found = list(q.sorts) if q.root == type_name else []

    def visit(at, selections):
        for s in selections:
            target = graph.schema.edge(at, s.edge).target
            if target == type_name:
                found.extend(x for x in s.sorts if x not in found)
            visit(target, s.selections)

    visit(q.root, q.selections)
    return found


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(event, type, id, from_index, to_index, old_props, props) between two
    window states; a row can both change and move."""
    a = old.select("type", "id", F.col("pos").alias("from_index"), F.col("sort_key").alias("old_key"), F.col("props").alias("old_props"))
    b = new.select("type", "id", F.col("pos").alias("to_index"), "sort_key", "props")
    both = a.join(b, ["type", "id"], "full_outer")
    was, now = F.col("from_index").isNotNull(), F.col("to_index").isNotNull()
    stays = was & now
    moved = stays & (F.col("from_index") != F.col("to_index")) & ~F.col("old_key").eqNullSafe(F.col("sort_key"))
    found = F.array_compact(F.array(
        F.when(was & ~now, "leave"), F.when(now & ~was, "enter"),
        F.when(stays & ~F.col("old_props").eqNullSafe(F.col("props")), "change"), F.when(moved, "move"),
    ))
    return both.select(F.explode(found).alias("event"), "type", "id", "from_index", "to_index", "old_props", "props")


def in_order(events: DataFrame) -> DataFrame:
    """Leaves from the last place, then the others from the first."""
    rank = F.array_position(F.array(*(F.lit(e) for e in EVENTS)), F.col("event"))
    place = F.when(F.col("event") == "leave", -F.col("from_index")).otherwise(F.col("to_index"))
    return events.orderBy(F.when(rank == 1, 0).otherwise(1), place, rank, "type", "id")


def replay(old: DataFrame, new: DataFrame, events: DataFrame) -> DataFrame:
    """(type, id) of the new window from the old one and the events: for tests."""
    gone = events.where("event = 'leave'").select("type", "id")
    come = events.where("event = 'enter'").select("type", "id")
    return old.select("type", "id").join(gone, ["type", "id"], "left_anti").unionByName(come)


