"""A driver-side database over a graph: entities, signals and edge collections.

Writes go to a log; reads see the graph as of its end.  Meant for interactive
use on few nodes; bulk work uses frames."""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import functions as F

from .operators.mutations import as_of, check_values, log_frame, text_of
from .operators.rollups import with_fields
from .operators.select import edge_targets
from .operators.view import View
from .plans.query import Query, parse_query
from .sources.graph import Graph


class DeletedEntity(RuntimeError):
    pass


class Database:
    """get, find, insert, update, delete, link, unlink, query, on and off."""

    def __init__(self, graph: Graph, entities: dict[str, type] | None = None):
        self.base, self.schema, self.spark = graph, graph.schema, graph.spark
        self.entities = dict(entities or {})
        self._log: list[tuple] = []
        self._graph: Graph | None = graph
        self._next: int | None = None
        self._cache: weakref.WeakValueDictionary[tuple[str, int], Entity] = weakref.WeakValueDictionary()
        self._watch: dict[tuple[str, int, str], Callable] = {}
        self._deleted: set[tuple[str, int]] = set()

    # --------------------------------------------------------------- state

    @property
    def graph(self) -> Graph:
        if self._graph is None:
            self._graph = as_of(self.base, log_frame(self.spark, self._log))
        return self._graph

    def log(self):
        """The writes so far as a log frame."""
        return log_frame(self.spark, self._log)

    def _write(self, op: str, type_name: str, node_id: int, props: dict | None = None, edge: str | None = None, target: int | None = None) -> None:
        text = None if props is None else {k: text_of(v) for k, v in props.items()}
        self._log.append((len(self._log) + 1, op, type_name, node_id, text, edge, target))
        self._graph = None

    def _new_id(self) -> int:
        if self._next is None:
            tops = [self.base.nodes(t).agg(F.max("id")).first()[0] for t in self.schema.types]
            self._next = max([0, *(t for t in tops if t is not None)]) + 1
        self._next += 1
        return self._next - 1

    # -------------------------------------------------------------- writes

    def insert(self, type_name: str, props: dict | None = None) -> Entity:
        check_values(self.schema, type_name, props or {})
        node_id = self._new_id()
        self._write("insert", type_name, node_id, props or {})
        return self._entity(type_name, node_id)

    def update(self, type_name: str, node_id: int, props: dict) -> None:
        self._alive(type_name, node_id)
        check_values(self.schema, type_name, props)
        old = self.values(type_name, node_id)
        self._write("update", type_name, node_id, props)
        self._tell(type_name, node_id, "change", self.values(type_name, node_id), old)

    def delete(self, type_name: str, node_id: int) -> None:
        self._alive(type_name, node_id)
        for e in self.schema[type_name].edges.values():
            for other in self.targets(type_name, node_id, e.name):
                self._tell(e.target, other, "unlink", e.reverse, node_id)
        self._write("delete", type_name, node_id)
        self._deleted.add((type_name, node_id))
        self._tell(type_name, node_id, "delete")
        for key in [k for k in self._watch if k[:2] == (type_name, node_id)]:
            del self._watch[key]

    def link(self, type_name: str, src: int, edge: str, dst: int) -> None:
        self._change_link("link", type_name, src, edge, dst)

    def unlink(self, type_name: str, src: int, edge: str, dst: int) -> None:
        self._change_link("unlink", type_name, src, edge, dst)

    def _change_link(self, op: str, type_name: str, src: int, edge: str, dst: int) -> None:
        e = self.schema.edge(type_name, edge)
        self._alive(type_name, src)
        self._alive(e.target, dst)
        if self.graph.has_edge(type_name, src, edge, dst) == (op == "link"):
            return
        self._write(op, type_name, src, None, edge, dst)
        self._tell(type_name, src, op, edge, dst)
        if (e.target, dst, e.reverse) != (type_name, src, edge):
            self._tell(e.target, dst, op, e.reverse, src)

    # --------------------------------------------------------------- reads

    def _alive(self, type_name: str, node_id: int) -> None:
        if (type_name, node_id) in self._deleted:
            raise DeletedEntity(f"{type_name}:{node_id}")
        if self.graph.get(type_name, node_id).isEmpty():
            raise KeyError(f"NodeNotFound: {type_name}:{node_id}")

    def exists(self, type_name: str, node_id: int) -> bool:
        return not self.graph.get(type_name, node_id).isEmpty()

    def values(self, type_name: str, node_id: int) -> dict[str, Any] | None:
        """Properties and rollups of a node, with its type and id."""
        row = with_fields(self.graph, type_name).where(F.col("id") == node_id).first()
        return None if row is None else {"type": type_name, **row.asDict()}

    def get(self, type_name: str, node_id: int) -> Entity | None:
        return self._entity(type_name, node_id) if self.exists(type_name, node_id) else None

    find = get

    def evict(self, type_name: str, node_id: int) -> None:
        self._cache.pop((type_name, node_id), None)

    def _entity(self, type_name: str, node_id: int) -> Entity:
        found = self._cache.get((type_name, node_id))
        if found is None:
            found = self.entities.get(type_name, Entity)(self, type_name, node_id)
            self._cache[type_name, node_id] = found
        return found

    def targets(self, type_name: str, node_id: int, edge: str) -> list[int]:
        df, order = edge_targets(self.graph, type_name, edge, node_id)
        return [r["id"] for r in df.orderBy(*order).select("id").toLocalIterator()]

    def has_edge(self, type_name: str, src: int, edge: str, dst: int) -> bool:
        return self.graph.has_edge(type_name, src, edge, dst)

    def field_type(self, type_name: str, name: str) -> str | None:
        return self.schema[type_name].field_kind(name)

    def query(self, source: str | dict | Query, limit: int = 0) -> View:
        return View(self.graph, source if isinstance(source, Query) else parse_query(source), limit)

    # -------------------------------------------------------------- events

    def on(self, type_name: str, node_id: int, event: str, call: Callable) -> None:
        """Watch a node: change, delete, link or unlink; one callback each."""
        if event not in ("change", "delete", "link", "unlink"):
            raise ValueError(f"unknown event {event!r}")
        self._watch[type_name, node_id, event] = call

    def off(self, type_name: str, node_id: int, event: str) -> None:
        self._watch.pop((type_name, node_id, event), None)

    def _tell(self, type_name: str, node_id: int, event: str, *args) -> None:
        call = self._watch.get((type_name, node_id, event))
        if call:
            call(*args)
        entity = self._cache.get((type_name, node_id))
        if entity is not None:
            entity._notify(event, *args)


class Entity:
    """A node: attributes are Signals of its fields and collections of its edges."""

    def __init__(self, db: Database, type_name: str, node_id: int):
        self._db, self._type, self._id = db, type_name, node_id
        self._signals: dict[str, Signal] = {}
        self._collections: dict[str, EdgeCollection] = {}
        self._on_link: list[Callable] = []
        self._on_unlink: list[Callable] = []

    def id(self) -> int:
        return self._id

    def type(self) -> str:
        return self._type

    def is_deleted(self) -> bool:
        return (self._type, self._id) in self._db._deleted

    def update(self, **props) -> None:
        self._db.update(self._type, self._id, props)

    def delete(self) -> None:
        self._db.delete(self._type, self._id)

    def on_link(self, call: Callable) -> Callable[[], None]:
        self._on_link.append(call)
        return lambda: self._on_link.remove(call)

    def on_unlink(self, call: Callable) -> Callable[[], None]:
        self._on_unlink.append(call)
        return lambda: self._on_unlink.remove(call)

    def unwatch(self) -> None:
        for s in self._signals.values():
            s.close()
        for c in self._collections.values():
            c.close()
        self._on_link.clear()
        self._on_unlink.clear()

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        kind = self._db.field_type(self._type, name)
        if kind == "edge":
            return self._collections.setdefault(name, EdgeCollection(self, name))
        if kind in ("property", "rollup"):
            return self._signals.setdefault(name, Signal(self, name))
        raise AttributeError(f"{self._type} has no {name!r}")

    def _notify(self, event: str, *args) -> None:
        if event == "change":
            for s in list(self._signals.values()):
                s._changed(args[0])
        elif event in ("link", "unlink"):
            for call in list(self._on_link if event == "link" else self._on_unlink):
                call(*args)
            if args[0] in self._collections:
                self._collections[args[0]]._event(event, args[1])
            values = None
            for s in list(self._signals.values()):  # rollups follow links
                if self._db.field_type(self._type, s.name) == "rollup":
                    values = values or self._db.values(self._type, self._id)
                    s._changed(values)
        elif event == "delete":
            self.unwatch()


class Signal:
    """A field's value: get, on_change, and use(effect) whose return value
    cleans up before the next run."""

    def __init__(self, entity: Entity, name: str):
        self.entity, self.name = entity, name
        self._calls: list[Callable] = []
        self._effects: list[list] = []
        self._last: Any = None
        self._known = False

    def get(self) -> Any:
        if self.entity.is_deleted():
            raise DeletedEntity(f"{self.entity._type}:{self.entity._id}")
        self._last, self._known = self.entity._db.values(self.entity._type, self.entity._id)[self.name], True
        return self._last

    def on_change(self, call: Callable) -> Callable[[], None]:
        """call(new, old) after each change; returns what ends it."""
        if not self._known:
            self.get()
        self._calls.append(call)
        return lambda: self._calls.remove(call)

    def use(self, effect: Callable) -> Callable[[], None]:
        """effect(value) now and after each change; returns what ends it."""
        slot = [effect, effect(self.get())]
        self._effects.append(slot)

        def end() -> None:
            if slot in self._effects:
                self._effects.remove(slot)
                if slot[1]:
                    slot[1]()

        return end

    def _changed(self, values: dict) -> None:
        if values is None or not (self._calls or self._effects) or values[self.name] == self._last:
            return
        old, self._last = self._last, values[self.name]
        for call in list(self._calls):
            call(self._last, old)
        for slot in list(self._effects):
            if slot[1]:
                slot[1]()
            slot[1] = slot[0](self._last)

    def close(self) -> None:
        for slot in self._effects:
            if slot[1]:
                slot[1]()
        self._calls, self._effects = [], []


class EdgeCollection:
    """An edge's targets: iteration, link, unlink, on_enter, on_leave, each."""

    def __init__(self, entity: Entity, edge: str):
        self.entity, self.edge = entity, edge
        self._enter: list[Callable] = []
        self._leave: list[Callable] = []
        self._each: list[tuple[Callable, dict[int, Callable | None]]] = []

    @property
    def _target(self) -> str:
        return self.entity._db.schema.edge(self.entity._type, self.edge).target

    def __iter__(self) -> Iterator[Entity]:
        db = self.entity._db
        return iter([db._entity(self._target, i) for i in db.targets(self.entity._type, self.entity._id, self.edge)])

    def link(self, other: Entity | int) -> None:
        db = self.entity._db
        db.link(self.entity._type, self.entity._id, self.edge, other if isinstance(other, int) else other.id())

    def unlink(self, other: Entity | int) -> None:
        db = self.entity._db
        db.unlink(self.entity._type, self.entity._id, self.edge, other if isinstance(other, int) else other.id())

    def on_enter(self, call: Callable) -> Callable[[], None]:
        self._enter.append(call)
        return lambda: self._enter.remove(call)

    def on_leave(self, call: Callable) -> Callable[[], None]:
        self._leave.append(call)
        return lambda: self._leave.remove(call)

    def each(self, call: Callable) -> Callable[[], None]:
        """call(entity) for each target now and later; what it returns runs when
        the target leaves or the whole ends."""
        live = {e.id(): call(e) for e in self}
        slot = (call, live)
        self._each.append(slot)

        def end() -> None:
            if slot in self._each:
                self._each.remove(slot)
                for done in live.values():
                    if done:
                        done()

        return end

    def _event(self, event: str, other: int) -> None:
        entity = self.entity._db._entity(self._target, other)
        for call in list(self._enter if event == "link" else self._leave):
            call(entity)
        for call, live in self._each:
            if event == "link":
                live[other] = call(entity)
            elif done := live.pop(other, None):
                done()

    def close(self) -> None:
        self._enter, self._leave, self._each = [], [], []
