"""Views: a query's forest as one frame in depth-first order, the set of
expanded edges, and the window that is looked at.

Order.  A row carries the sort values of each of its ancestors and its own, a
group of columns a level: o{L}_e, the rank of the edge among its siblings, the
level's sort values, and o{L}_id.  Levels a row doesn't have are null, and a
null edge rank sorts first, so parents precede their children and the plain
sort over all groups is the depth-first order.  It needs no rank within a
parent: a parent with a third of all children is no task of its own, and a
window at the top is a top-k.

Below a recursive edge the levels are not known beforehand.  There a row has one
column for all of them, o{L}_..._p: an array of the place of the row that it
started from, then the edge's rank and the node's place in the edge's order, a
pair a level.  Arrays sort with prefixes first, which is depth first again.

A node stands once in a view, at its first place in that order.  Only queries
that can reach a node twice pay for this (one aggregation by node).  Recursion
keeps one place a node while it goes on: a level's rows continue only where they
are new or come before the place known so far.  So a graph of many paths costs
its edges a level, not its paths, and cycles end by themselves; there is no cap
on levels.  An edge whose targets have one source each (a tree or a chain) is
followed by doubling: levels in rounds of their logarithm.  Its arrays hold no
pair a level: only how many only children follow each other, then a place where
ways part, in turn.  So they grow with the forks above a row, not with its depth,
and stay of one size along a chain."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import numbered, sort_column, sort_keys
from ..plans.query import Query, Selection, analyze, children_of, in_edge_order
from ..schema import Schema, Sort
from ..sources.graph import Graph
from ..sources.shared import keep_until_exit, materialize, shared_dir
from .rollups import with_fields
from .select import filtered, roots

BASE = ("type", "id", "parent_type", "parent_id", "edge", "depth")


@dataclass(frozen=True)
class Expansion:
    """Expanded (parent type, parent id, edge) triples; everything if all is
    set, down to `depth` levels if that is given."""

    triples: frozenset[tuple[str, int, str]] = frozenset()
    all: bool = False
    depth: int | None = None

    @property
    def few(self) -> bool:
        return not self.all and len(self.triples) <= MAX_BROADCAST

    def frame(self, graph: Graph, type_name: str, edge: str) -> DataFrame:
        return _clicked(graph, ((i,) for t, i, e in self.triples if (t, e) == (type_name, edge)), "parent_id long")


ALL = Expansion(all=True)

#: so many rows of clicks or of starts of a recursion are broadcast at most
MAX_BROADCAST = 100_000


def _clicked(graph: Graph, rows: Iterable[tuple], columns: str) -> DataFrame:
    """A frame of what a user clicked on; broadcast while it is small."""
    kept = sorted(set(rows))
    df = graph.spark.createDataFrame(kept, columns)
    return F.broadcast(df) if len(kept) <= MAX_BROADCAST else df


def _order_names(level: int, slot: str, sorts: Sequence[Sort]) -> list[tuple[str, bool]]:
    return [(f"o{level}_{slot}_{k}", s.descending) for k, s in enumerate(sorts)]


def _keyed(df: DataFrame, level: int, slot: str, sorts: Sequence[Sort], rank: int) -> list[Column]:
    names = _order_names(level, slot, sorts)
    return [
        F.lit(rank).alias(f"o{level}_e"), *(F.col(f"`{s.field}`").alias(n) for (n, _), s in zip(names, sorts, strict=True)),
        F.col("id").alias(f"o{level}_id"),
    ]


def _states(schema: Schema, type_name: str, s: Selection) -> tuple[list[tuple[str, Selection]], list[list[tuple[int, int]]]]:
    """The selections that rows below a recursive one can stand for, each with
    the type that it starts from, s first; and what follows each: (rank, which)."""
    own: list[tuple[str, Selection]] = [(type_name, s)]
    after: list[list[tuple[int, int]]] = []
    for source, x in own:  # grows while it is walked
        target = schema.edge(source, x.edge).target
        follows = []
        for rank, below in enumerate(in_edge_order(children_of(x)), 1):
            if (target, below) not in own:
                own.append((target, below))
            follows.append((rank, own.index((target, below))))
        after.append(follows)
    return own, after


class Forest:
    """All visible rows of a query under an expansion."""

    def __init__(self, graph: Graph, q: Query, expansion: Expansion = ALL, strict_tags: bool = False, max_depth: int | None = None):
        self.graph, self.query, self.expansion = graph, analyze(graph.schema, q), expansion
        self.strict, self.max_depth = strict_tags, max_depth
        self._parts: list[DataFrame] = []
        self._keys: dict[str, tuple[int, int, str, bool]] = {}
        self._types: list[str] = []
        self._repeats = False
        self._written: DataFrame | None = None
        self._build()

    # ------------------------------------------------------------ building

    def _note(self, level: int, slot: str, sorts: Sequence[Sort]) -> None:
        self._keys[f"o{level}_e"] = (level, 0, "", False)
        for k, (name, desc) in enumerate(_order_names(level, slot, sorts)):
            self._keys[name] = (level, 1 + k, slot, desc)
        self._keys[f"o{level}_id"] = (level, 1 << 20, "", False)

    def _build(self) -> None:
        q, graph = self.query, self.graph
        top = roots(graph, q.root, q.filters, q.sorts, q.id, (), self.strict)
        self._note(0, "r", q.sorts)
        rows = top.select(
            F.lit(q.root).alias("type"), "id", F.lit(None).cast("string").alias("parent_type"), F.lit(None).cast("long").alias("parent_id"),
            F.lit(None).cast("string").alias("edge"), F.lit(-1 if q.virtual else 0).alias("depth"), *_keyed(top, 0, "r", q.sorts, 0),
        )
        if not q.virtual:
            self._parts.append(rows)
            self._types.append(q.root)
        self._below(rows, q.root, q.selections, 0, "")

    def _below(self, rows: DataFrame, type_name: str, selections: Iterable[Selection], level: int, path: str) -> None:
        """Add what the selections lead to from rows (nodes of type_name).
        path: the ranks of the edges so far, which name the order's columns."""
        for rank, s in enumerate(in_edge_order(selections), 1):
            slot = f"{path}{rank}x"
            if s.recursive:
                self._recur(rows, type_name, s, level + 1, rank, slot)
                continue
            reached = self._hop(rows, type_name, s, level + 1, rank, slot)
            if reached is not None:
                self._below(reached, self.graph.schema.edge(type_name, s.edge).target, s.selections, level + 1, slot)

    def _hop(self, rows: DataFrame, type_name: str, s: Selection, level: int, rank: int, slot: str) -> DataFrame | None:
        graph, schema = self.graph, self.graph.schema
        edge = schema.edge(type_name, s.edge)
        bound = graph.edges(type_name, s.edge)
        if self.max_depth is not None and level > self.max_depth:
            return None
        if self.expansion.depth is not None and not s.virtual:
            rows = rows.where(F.col("depth") + 1 <= self.expansion.depth)
        parents = rows
        if not self.expansion.all:
            wanted = self.expansion.frame(graph, type_name, s.edge).withColumnRenamed("parent_id", "id")
            parents = parents.join(wanted, "id", "left_semi")
        targets = filtered(graph, edge.target, s.filters, [x.field for x in s.sorts], self.strict)
        self._note(level, slot, s.sorts)
        keys = targets.select(F.col("id").alias("__id"), *_keyed(targets, level, slot, s.sorts, rank))
        pairs = bound.pairs.select(F.col("src").alias("id"), F.col("dst").alias("__id"))
        # the parent as shown: a hidden node hands on its own parent and edge
        seen = parents.select(
            "id", F.col("type").alias("__type"), F.col("depth").alias("__depth"),
            F.col("parent_type").alias("__pt"), F.col("parent_id").alias("__pi"), F.col("edge").alias("__edge"),
            (F.col("__hidden") if "__hidden" in parents.columns else F.lit(False)).alias("__hidden"),
            *(c for c in parents.columns if c in self._keys),
        )
        # edges and targets are as large as their tables, and a file that packs well would
        # pass for a small one: only parents that were clicked on, once each, are broadcast
        near = F.broadcast(seen).join(pairs, "id") if self.expansion.few and not self._repeats else seen.join(pairs.hint("merge"), "id")
        joined = near.join(keys.hint("merge"), "__id")
        if not bound.one_source or edge.target in self._types:
            self._repeats = True
        hidden = F.col("__hidden")
        out = joined.select(
            F.lit(edge.target).alias("type"), F.col("__id").alias("id"),
            F.when(hidden, F.col("__pt")).otherwise(F.col("__type")).alias("parent_type"), F.when(hidden, F.col("__pi")).otherwise(F.col("id")).alias("parent_id"),
            F.when(hidden, F.col("__edge")).otherwise(F.lit(s.edge)).alias("edge"),
            (F.col("__depth") + (0 if s.virtual else 1)).alias("depth"), F.lit(s.virtual).alias("__hidden"),
            *(c for c in joined.columns if c in self._keys),
        )
        if self.query.virtual and level == 1 and not s.virtual:
            out = out.withColumns({"parent_type": F.lit(None).cast("string"), "parent_id": F.lit(None).cast("long")})
        if not s.virtual:
            self._parts.append(out.drop("__hidden"))
            self._types.append(edge.target)
        return out

    # ----------------------------------------------------------- recursion

    def _recur(self, rows: DataFrame, type_name: str, s: Selection, level: int, rank: int, slot: str) -> None:
        """Add all that a recursive selection leads to from rows."""
        schema = self.graph.schema
        self._keys[f"o{level}_e"], self._keys[f"o{level}_{slot}_p"] = (level, 0, "", False), (level, 1, slot, False)
        most = None if self.max_depth is None else self.max_depth - level + 1
        hidden = F.col("__hidden") if "__hidden" in rows.columns else F.lit(False)
        starts = numbered(rows.withColumn("__hidden", hidden), [c for n, c in self._sorted() if n in rows.columns], "__start")
        own, after = _states(schema, type_name, s)
        target = schema.edge(type_name, s.edge).target
        tree = type_name == target and not s.selections and not s.virtual and self.graph.edges(type_name, s.edge).one_source
        found = self._doubled(starts, type_name, s, most) if tree else self._leveled(starts, own, after, level, most).withColumn("__from", F.element_at("__path", 1))
        kept = [c for c in rows.columns if c in self._keys]
        origin = starts.select(F.col("__start").alias("__from"), *kept, *((F.col(c).alias(f"__s_{c}") for c in ("parent_type", "parent_id", "edge", "depth", "__hidden"))))
        if starts.count() <= MAX_BROADCAST:  # few starts: all rows may stand below one of them
            origin = F.broadcast(origin)
        out = found.join(origin, "__from")
        if tree:  # depths and the parents that hidden starts hand on
            first = F.col("__steps") == 1
            for c in ("parent_type", "parent_id", "edge"):
                out = out.withColumn(c, F.when(first & F.col("__s___hidden"), F.col(f"__s_{c}")).otherwise(F.col(c)))
            out = out.withColumn("depth", (F.col("__s_depth") + F.col("__steps")).cast("int"))
            if self.query.virtual and level == 1:
                out = out.withColumns({c: F.when(~first, F.col(c)) for c in ("parent_type", "parent_id")})
            if self.expansion.depth is not None:
                out = out.where(F.col("depth") <= self.expansion.depth)
        self._parts.append(out.select(*BASE, F.lit(rank).alias(f"o{level}_e"), F.col("__path").alias(f"o{level}_{slot}_p"), *kept))
        self._types += [schema.edge(t, x.edge).target for t, x in own if not x.virtual]
        self._repeats = True

    def _steps(self, type_name: str, s: Selection) -> DataFrame:
        """(src, dst, pos) of the edges that a selection follows; pos is the
        place of dst among all targets in the selection's order."""
        graph = self.graph
        bound = graph.edges(type_name, s.edge)
        targets = filtered(graph, graph.schema.edge(type_name, s.edge).target, s.filters, [x.field for x in s.sorts], self.strict)
        if s.sorts:
            targets = numbered(targets, sort_keys(s.sorts)).select(F.col("id").alias("dst"), "pos")
        else:
            targets = targets.select(F.col("id").alias("dst"), F.col("id").alias("pos"))
        pairs = bound.pairs
        if not self.expansion.all:
            wanted = self.expansion.frame(graph, type_name, s.edge).withColumnRenamed("parent_id", "src")
            pairs = pairs.join(wanted, "src", "left_semi")
        # both are as large as their tables: files that pack well must not pass for small ones
        return materialize(pairs.join(targets.hint("merge"), "dst").select("src", "dst", "pos"))

    def _doubled(self, starts: DataFrame, type_name: str, s: Selection, most: int | None) -> DataFrame:
        """Rows below starts along an edge of one source.  A node knows the way
        down from an ancestor and from the first of the starts on it; each round
        it takes in what that ancestor knows, so that ways double.  Nodes that
        know their way from the top rest, and only serve those below them."""
        steps = self._steps(type_name, s)
        if self.graph.edges(type_name, s.edge).one_target:  # chains: a way is a number of steps
            one, longer, path, count = F.lit(1), lambda a, b: a + b, F.array("at", F.col("down").cast("long")), F.col("down")
        else:  # steps to only children, then a place at a fork, and so on
            forks = steps.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("src", F.lit(True).alias("fork"))
            steps = steps.join(forks, "src", "left")
            zero = F.lit(0).cast("long")
            one = F.when(F.col("fork"), F.array(zero, F.col("pos"), zero)).otherwise(F.array(zero + 1))
            longer = lambda a, b: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.element_at(a, -1) + F.element_at(b, 1)), F.slice(b, 2, F.size(b)))
            path = F.concat(F.array("at"), "down")
            count = F.aggregate(F.filter("down", lambda _, k: k % 2 == 0), zero, lambda a, b: a + b) + F.floor(F.size("down") / 2)
        first = starts.groupBy(F.col("id").alias("src")).agg(F.min("__start").alias("at"))
        # way: down from `up`, which is null at the top; down: from the first start `at`
        ways = steps.join(first, "src", "left").select(
            F.col("dst").alias("node"), "src", F.col("src").alias("up"), one.alias("way"), "at", F.when(F.col("at").isNotNull(), one).alias("down"), F.lit(True).alias("going"), F.lit(True).alias("changed")
        )
        base, written = f"{shared_dir(self.graph.spark)}/ways-{uuid.uuid4().hex}", []
        keep_until_exit(self.graph.spark, base)
        while True:  # a row is written again only while it goes on
            path_now = f"{base}/{len(written)}"
            now = materialize(ways.withColumn("round", F.lit(len(written))), path_now)
            written.append(path_now)
            known = self.graph.spark.read.schema(now.schema).parquet(*written)
            last = F.col("round") == len(written) - 1
            left = now.agg(F.max("changed").alias("changed"), F.max("going").alias("going")).first()
            if not left["changed"] or not left["going"]:  # a way of each length up to the longest changes in its round
                break
            upper = known.where((F.col("going") & last) | (~F.col("going") & F.col("at").isNotNull())).select(
                F.col("node").alias("up"), F.col("up").alias("up2"), F.col("way").alias("way2"), F.col("at").alias("at2"), F.col("down").alias("down2")
            )
            before = F.col("at2").isNotNull() & (F.col("at").isNull() | (F.col("at2") < F.col("at")))
            ways = now.where("going").join(upper.hint("merge"), "up", "left").select(
                "node", "src", F.col("up2").alias("up"), F.when(F.col("up2").isNotNull(), longer(F.col("way2"), F.col("way"))).alias("way"), F.when(before, F.col("at2")).otherwise(F.col("at")).alias("at"),
                F.when(before, longer(F.col("down2"), F.col("way"))).otherwise(F.col("down")).alias("down"), F.col("up2").isNotNull().alias("going"), F.coalesce(before, F.lit(False)).alias("changed"),
            )
        found = known.where(F.col("at").isNotNull() & (~F.col("going") | last)).withColumn("__steps", count.cast("long"))
        if most is not None:
            found = found.where(F.col("__steps") <= most)
        return found.select(
            F.lit(type_name).alias("type"), F.col("node").alias("id"), F.lit(type_name).alias("parent_type"), F.col("src").alias("parent_id"),
            F.lit(s.edge).alias("edge"), path.alias("__path"), F.col("at").alias("__from"), "__steps",
        )

    def _leveled(self, starts: DataFrame, own: list[tuple[str, Selection]], after: list[list[tuple[int, int]]], level: int, most: int | None) -> DataFrame:
        """Rows below starts level by level.  own: the selections that rows can
        stand for; after: what follows each, with its rank."""
        schema, spark = self.graph.schema, self.graph.spark
        steps = [self._steps(t, x) for t, x in own]
        fields = ["type", "id", "parent_type", "parent_id", "edge", "depth", "__hidden", "__state", "__path"]

        def follow(rows: DataFrame, k: int, rank: int) -> DataFrame:
            type_name, x = own[k]
            if self.expansion.depth is not None and not x.virtual:
                rows = rows.where(F.col("depth") + 1 <= self.expansion.depth)
            hidden = F.col("__hidden")
            return rows.join(steps[k], F.col("id") == F.col("src")).select(
                F.lit(schema.edge(type_name, x.edge).target).alias("type"), F.col("dst").alias("id"),
                F.when(hidden, F.col("parent_type")).otherwise(F.col("type")).alias("parent_type"), F.when(hidden, F.col("parent_id")).otherwise(F.col("id")).alias("parent_id"),
                F.when(hidden, F.col("edge")).otherwise(F.lit(x.edge)).alias("edge"), (F.col("depth") + (0 if x.virtual else 1)).cast("int").alias("depth"),
                F.lit(x.virtual).alias("__hidden"), F.lit(k).alias("__state"), F.concat("__path", F.array(F.lit(rank).cast("long"), F.col("pos"))).alias("__path"),
            )

        base, written = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}", []
        best = F.min(F.struct("__path", *(c for c in fields if c not in ("__path", "__state", "id")))).alias("best")
        # a start that is reached again stands at its own place, if that is before
        first = starts.groupBy(F.col("type").alias("t"), F.col("id").alias("i")).agg(F.min("__start").alias("p"))

        def place(rows: DataFrame) -> DataFrame:
            rows = rows.join(first, (F.col("type") == F.col("t")) & (F.col("id") == F.col("i")) & (F.col("p") <= F.element_at("__path", 1)), "left_anti")
            return rows.groupBy("__state", "id").agg(best).select("__state", "id", "best.*").select(fields)

        at = starts.withColumn("__path", F.array("__start"))
        reached = place(follow(at, 0, 1))
        if self.query.virtual and level == 1 and not own[0][1].virtual:
            reached = reached.withColumns({"parent_type": F.lit(None).cast("string"), "parent_id": F.lit(None).cast("long")})
        while most is None or len(written) < most:
            now = materialize(reached, f"{base}/{len(written)}")
            written.append(f"{base}/{len(written)}")
            if now.isEmpty():
                break
            parts = [follow(now.where(F.col("__state") == k), n, rank) for k, follows in enumerate(after) for rank, n in follows]
            if not parts:
                break
            known = spark.read.schema(now.schema).parquet(*written).select(F.col("__state").alias("s"), F.col("id").alias("i"), F.col("__path").alias("p"))
            new = place(reduce(DataFrame.unionByName, parts))
            reached = new.join(known, (F.col("__state") == F.col("s")) & (F.col("id") == F.col("i")) & (F.col("p") <= F.col("__path")), "left_anti")
        keep_until_exit(spark, base)
        return place(spark.read.schema(reached.schema).parquet(*written)).where(~F.col("__hidden")) if written else place(reached.limit(0))

    # ------------------------------------------------------------- reading

    def _sorted(self) -> list[tuple[str, Column]]:
        names = sorted(self._keys, key=lambda n: self._keys[n][:3])
        return [(n, sort_column(n, self._keys[n][3])) for n in names]

    def order(self) -> list[Column]:
        """The depth-first order of rows()."""
        return [c for _, c in self._sorted()]

    def rows(self) -> DataFrame:
        """BASE columns and the order's."""
        parts = self._parts
        if not parts:
            return self.graph.spark.createDataFrame([], "type string, id long, parent_type string, parent_id long, edge string, depth int")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        for name in self._keys:
            if name not in out.columns:
                out = out.withColumn(name, F.lit(None).cast("long"))
        if self._repeats:
            first = Window.partitionBy("type", "id").orderBy(*self.order())
            out = out.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__first")
        return out

    def total(self) -> int:
        return self.rows().count()

    def flat(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        """BASE columns and has_children in depth-first order, a window of it."""
        out = self.rows().orderBy(*self.order())
        if offset:
            out = out.offset(offset)
        if limit:
            out = out.limit(limit)
        return self._finish(out)

    def window(self, offset: int, height: int) -> DataFrame:
        """flat() with pos, the place in the whole view: at most height rows."""
        top = self.rows().orderBy(*self.order()).offset(offset).limit(height)
        placed = top.withColumn("pos", (F.row_number().over(Window.orderBy(*self.order())) - 1 + offset).cast("long"))
        return self._finish(placed, "pos")

    def positions(self) -> DataFrame:
        """flat() with pos for every row, without a single task.  Rows are written
        first: dealing them out by ranges reads them twice."""
        return self._finish(numbered(materialize(self.rows()), self.order()), "pos")

    def _finish(self, df: DataFrame, *more: str) -> DataFrame:
        return df.select(*BASE, self.has_children().alias("has_children"), *more)

    def has_children(self) -> Column:
        """Whether the row's type declares an edge at all."""
        with_edges = [t.name for t in self.graph.schema.types.values() if t.edges]
        return F.col("type").isin(with_edges) if with_edges else F.lit(False)

    def _before(self, row: dict, kinds: dict) -> Column:
        """Whether a row sorts before the one of the given key values."""
        out = F.lit(False)
        for name in sorted(self._keys, key=lambda n: self._keys[n][:3], reverse=True):
            c, value, kind = F.col(name), row[name], kinds[name]
            if value is None:
                less = c.isNotNull() if self._keys[name][3] else F.lit(False)
                same = c.isNull()
            else:
                v = F.array(*(F.lit(x).cast("long") for x in value)) if isinstance(value, list) else F.lit(value).cast(kind)
                less = F.coalesce(c > v, F.lit(False)) if self._keys[name][3] else c.isNull() | (c < v)
                same = c.eqNullSafe(v)
            out = less | (same & out)
        return out

    def index_of(self, type_name: str, node_id: int) -> int | None:
        """The node's place: its key is looked up and what sorts before is counted."""
        rows = self.rows() if self._written is None else self._written
        kinds = {f.name: f.dataType for f in rows.schema}
        plain = lambda n: F.col(n) if kinds[n].typeName() == "array" else F.col(n).cast("string").alias(n)
        found = rows.where((F.col("type") == type_name) & (F.col("id") == node_id)).select(*map(plain, self._keys)).first()
        return None if found is None else rows.where(self._before(found.asDict(), kinds)).count()

    def id_at(self, root_id: int, steps: Sequence[tuple[str, int]]) -> tuple[str, int] | None:
        """(type, id) at a path: a shown root, then for each step the child of
        that number, from 0, under an edge; None where there is none.  Rows that
        were written for it serve what is asked for next."""
        if steps and self._written is None:
            self._written = materialize(self.rows())
        rows = self.rows() if self._written is None else self._written
        at = rows.where((F.col("type") == self.query.root) & (F.col("id") == root_id) & F.col("edge").isNull()).select("type", "id").first()
        for edge, index in steps:
            if at is None or index < 0:
                return None
            own = rows.where((F.col("parent_type") == at["type"]) & (F.col("parent_id") == at["id"]) & (F.col("edge") == edge))
            at = own.orderBy(*self.order()).offset(index).limit(1).select("type", "id").first()
        return None if at is None else (at["type"], at["id"])

    def with_properties(self, df: DataFrame) -> DataFrame:
        """df with `properties`: each row's declared properties and rollups as JSON."""
        parts = []
        for t in dict.fromkeys(self._types):
            fields = with_fields(self.graph, t)
            values = fields.select("id", F.to_json(F.struct(*(F.col(f"`{c}`") for c in fields.columns if c != "id")), {"ignoreNullFields": "false"}).alias("properties"))
            parts.append(df.where(F.col("type") == t).join(values, "id", "left"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


class View:
    """A query with its expansion and viewport, kept on the driver."""

    def __init__(self, graph: Graph, q: Query, limit: int = 0, strict_tags: bool = False):
        self.graph, self.query, self.strict = graph, analyze(graph.schema, q), strict_tags
        self.height, self.offset = limit, 0
        self.expansion = Expansion()

    # ------------------------------------------------------------ expansion

    def _selections_at(self, type_name: str) -> dict[str, Selection]:
        found: dict[str, Selection] = {}

        def visit(at: str, selections: Sequence[Selection]) -> None:
            for s in selections:
                if at == type_name:
                    found.setdefault(s.edge, s)
                target = self.graph.schema.edge(at, s.edge).target
                if s.recursive and target == type_name:
                    found.setdefault(s.edge, s)
                visit(target, s.selections)

        visit(self.query.root, self.query.selections)
        return found

    def _declared(self, type_name: str, edge: str) -> None:
        if edge not in self._selections_at(type_name):
            raise ValueError(f"the query doesn't select {type_name}.{edge}")

    def _forest(self) -> Forest:
        return Forest(self.graph, self.query, self._effective(), self.strict)

    def _effective(self) -> Expansion:
        return self.expansion

    def expand(self, type_name: str, node_id: int, edge: str) -> None:
        self._declared(type_name, edge)
        self.expansion = Expansion(self.expansion.triples | {(type_name, node_id, edge)}, self.expansion.all, self.expansion.depth)

    def collapse(self, type_name: str, node_id: int, edge: str) -> None:
        """Collapse an edge and forget what is expanded below it.  On a view
        that shows everything there is nothing to take out of."""
        if self.expansion.all:
            raise ValueError("collapse_all first: the view shows all edges")
        below = Forest(self.graph, self.query, self.expansion, self.strict).rows()
        gone = {(type_name, node_id, edge)}
        parents = {(type_name, node_id)}
        # expanded triples are a user's clicks: walk down those, not the data
        seen = {(r["type"], r["id"]): (r["parent_type"], r["parent_id"], r["edge"]) for r in self._expanded_rows(below)}
        changed = True
        while changed:
            changed = False
            for t, i, e in self.expansion.triples - gone:
                up = seen.get((t, i))
                if up and ((up[0], up[1]) in parents and (up in gone or (up[0], up[1]) != (type_name, node_id))):
                    gone.add((t, i, e))
                    parents.add((t, i))
                    changed = True
        self.expansion = Expansion(self.expansion.triples - gone, False, self.expansion.depth)

    def _expanded_rows(self, rows: DataFrame):
        wanted = _clicked(self.graph, ((t, i) for t, i, _ in self.expansion.triples), "type string, id long")
        return rows.join(wanted, ["type", "id"]).select("type", "id", "parent_type", "parent_id", "edge").collect()

    def toggle(self, type_name: str, node_id: int, edge: str) -> bool:
        """Whether it is expanded afterwards."""
        if self.is_expanded(type_name, node_id, edge):
            self.collapse(type_name, node_id, edge)
            return False
        self.expand(type_name, node_id, edge)
        return True

    def is_expanded(self, type_name: str, node_id: int, edge: str) -> bool:
        return self.expansion.all or (type_name, node_id, edge) in self.expansion.triples

    def expand_all(self, max_depth: int | None = None) -> None:
        self.expansion = Expansion(self.expansion.triples, True, max_depth)

    def collapse_all(self) -> None:
        self.expansion = Expansion()

    # -------------------------------------------------------------- viewport

    def total(self) -> int:
        return self._forest().total()

    def set_limit(self, height: int) -> None:
        self.height = height

    def scroll_to(self, position: int) -> int:
        """The offset, clamped to the last full page."""
        last = max(0, self.total() - self.height) if self.height else 0
        self.offset = min(max(0, position), last)
        return self.offset

    def scroll_by(self, delta: int) -> int:
        return self.scroll_to(self.offset + delta)

    def scroll_to_node(self, type_name: str, node_id: int) -> int | None:
        at = self._forest().index_of(type_name, node_id)
        return None if at is None else self.scroll_to(at)

    def contains_index(self, index: int) -> bool:
        return self.offset <= index and (not self.height or index < self.offset + self.height)

    def items(self) -> DataFrame:
        """The rows of the window with their pos."""
        forest = self._forest()
        return forest.window(self.offset, self.height) if self.height else forest.positions()

    def node_at(self, index: int):
        return self._forest().window(index, 1).first()

    def index_of(self, type_name: str, node_id: int) -> int | None:
        return self._forest().index_of(type_name, node_id)

    def node_at_path(self, root_id: int, *steps: tuple[str, int]) -> tuple[str, int] | None:
        """(type, id) of what stands at a root's id and (edge, number) steps."""
        return self._forest().id_at(root_id, steps)

    def path_to_index(self, root_id: int, *steps: tuple[str, int]) -> int | None:
        """The place in the view of what stands at a path."""
        forest = self._forest()
        found = forest.id_at(root_id, steps)
        return None if found is None else forest.index_of(*found)

    def visible_count(self) -> int:
        """How many rows the viewport shows."""
        left = max(0, self.total() - self.offset)
        return min(self.height, left) if self.height else left

    def stats(self) -> dict:
        return {"total": self.total(), "offset": self.offset, "limit": self.height, "expanded": len(self.expansion.triples), "all": self.expansion.all}


def clamp_offset(total: int, offset: int, height: int) -> int:
    return min(max(0, offset), max(0, total - height))
