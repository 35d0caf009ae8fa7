"""Typed property-graph schema: JSON in, checked dataclasses out."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

#: fixed values: property type keywords and their Spark types
SPARK_TYPES: dict[str, T.DataType] = {"bool": T.BooleanType(), "int": T.LongType(), "number": T.DoubleType(), "string": T.StringType()}
DIRECTIONS = ("asc", "desc")


class SchemaError(ValueError):
    """code: InvalidJson, InvalidPropertyType, InvalidEdgeDefinition,
    MissingReverseEdge, InvalidRollupDefinition, InvalidIndexDefinition,
    DuplicateName, InvalidDirection, UnknownKey, CyclicRollup."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Sort:
    field: str
    direction: str = "asc"

    @property
    def descending(self) -> bool:
        return self.direction == "desc"

    def reversed(self) -> Sort:
        return Sort(self.field, "asc" if self.descending else "desc")


@dataclass(frozen=True)
class Edge:
    name: str
    target: str
    reverse: str
    sort: Sort | None = None


@dataclass(frozen=True)
class Rollup:
    """kind: count, traverse, first or last.  field and direction order the
    targets of first and last; property is what is taken (None: the target's id)."""

    name: str
    kind: str
    edge: str
    property: str | None = None
    field: str | None = None
    direction: str = "asc"


@dataclass(frozen=True)
class IndexField:
    field: str
    direction: str = "asc"
    kind: str = "property"


@dataclass(frozen=True)
class NodeType:
    name: str
    properties: dict[str, str] = field(default_factory=dict)
    edges: dict[str, Edge] = field(default_factory=dict)
    rollups: dict[str, Rollup] = field(default_factory=dict)
    indexes: tuple[tuple[IndexField, ...], ...] = ()

    def field_kind(self, name: str) -> str | None:
        """property, edge, rollup or None, looked up in this order."""
        for kind, names in (("property", self.properties), ("edge", self.edges), ("rollup", self.rollups)):
            if name in names:
                return kind
        return None

    def struct(self) -> T.StructType:
        fields = [T.StructField("id", T.LongType())]
        return T.StructType(fields + [T.StructField(n, SPARK_TYPES[t]) for n, t in self.properties.items()])


@dataclass(frozen=True)
class Schema:
    types: dict[str, NodeType]

    def __getitem__(self, name: str) -> NodeType:
        if name not in self.types:
            raise KeyError(f"TypeNotFound: {name}")
        return self.types[name]

    def edge(self, type_name: str, edge: str) -> Edge:
        found = self[type_name].edges.get(edge)
        if found is None:
            raise KeyError(f"UnknownEdge: {type_name}.{edge}")
        return found

    def reverse(self, type_name: str, edge: str) -> Edge:
        e = self.edge(type_name, edge)
        return self.types[e.target].edges[e.reverse]

    def is_symmetric(self, type_name: str, edge: str) -> bool:
        e = self.edge(type_name, edge)
        return e.target == type_name and e.reverse == edge

    def rollup_order(self, type_name: str) -> list[tuple[str, str]]:
        """(type, rollup) pairs so that each stands after what it takes from."""
        order: list[tuple[str, str]] = []
        for name in self[type_name].rollups:
            self._visit((type_name, name), order, ())
        return order

    def rollup_source(self, type_name: str, name: str) -> list[tuple[str, str]]:
        r = self[type_name].rollups[name]
        target = self.edge(type_name, r.edge).target
        return [(target, f) for f in (r.property, r.field) if f and f not in self[target].properties and f in self[target].rollups]

    def _visit(self, node: tuple[str, str], order: list, trail: tuple) -> None:
        if node in trail:
            raise SchemaError("CyclicRollup", " -> ".join(f"{t}.{r}" for t, r in (*trail, node)))
        if node not in order:
            for source in self.rollup_source(*node):
                self._visit(source, order, (*trail, node))
            order.append(node)


# -------------------------------------------------------------------- parsing


def _keys(where: str, value: Any, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict:
    if not isinstance(value, dict):
        raise SchemaError("InvalidJson", f"{where} is no object")
    if unknown := set(value) - set(required) - set(optional):
        raise SchemaError("UnknownKey", f"{where} has {sorted(unknown)}")
    if missing := set(required) - set(value):
        raise SchemaError("InvalidJson", f"{where} lacks {sorted(missing)}")
    return value


def _direction(where: str, value: str) -> str:
    if value not in DIRECTIONS:
        raise SchemaError("InvalidDirection", f"{where}: {value!r}")
    return value


def parse_sort(where: str, value: Any, key: str = "field") -> Sort:
    d = _keys(where, value, (key,), ("direction",))
    return Sort(d[key], _direction(where, d.get("direction", "asc")))


def _rollup(where: str, value: Any) -> Rollup:
    d = _keys(where, value, ("name",), ("count", "traverse", "first", "last"))
    name = d["name"]
    # several kinds: count, then traverse, first, last
    if d.get("count") is not None:
        return Rollup(name, "count", d["count"])
    if d.get("traverse") is not None:
        t = _keys(where, d["traverse"], ("edge", "property"))
        return Rollup(name, "traverse", t["edge"], t["property"])
    for kind in ("first", "last"):
        if d.get(kind) is not None:
            t = _keys(where, d[kind], ("edge", "field"), ("direction", "property"))
            return Rollup(name, kind, t["edge"], t.get("property"), t["field"], _direction(where, t.get("direction", "asc")))
    raise SchemaError("InvalidRollupDefinition", f"{where}: no kind")


def _node_type(value: Any) -> NodeType:
    d = _keys("type", value, ("name",), ("properties", "edges", "indexes", "rollups"))
    name = d["name"]
    names: list[str] = ["id"]
    properties, edges, rollups, indexes = {}, {}, {}, []
    for p in d.get("properties", []):
        p = _keys(f"{name} property", p, ("name", "type"))
        if p["type"] not in SPARK_TYPES:
            raise SchemaError("InvalidPropertyType", f"{name}.{p['name']}: {p['type']!r}")
        names.append(p["name"])
        properties[p["name"]] = p["type"]
    for e in d.get("edges", []):
        e = _keys(f"{name} edge", e, ("name", "target", "reverse"), ("sort",))
        names.append(e["name"])
        sort = parse_sort(f"{name}.{e['name']} sort", e["sort"], "property") if e.get("sort") else None
        edges[e["name"]] = Edge(e["name"], e["target"], e["reverse"], sort)
    for r in d.get("rollups", []):
        rollup = _rollup(f"{name} rollup", r)
        names.append(rollup.name)
        rollups[rollup.name] = rollup
    for i in d.get("indexes", []):
        fields = []
        for f in _keys(f"{name} index", i, ("fields",))["fields"]:
            f = _keys(f"{name} index field", f, ("field",), ("direction", "kind"))
            if f.get("kind", "property") not in ("property", "edge"):
                raise SchemaError("InvalidIndexDefinition", f"{name}: kind {f['kind']!r}")
            fields.append(IndexField(f["field"], _direction(name, f.get("direction", "asc")), f.get("kind", "property")))
        indexes.append(tuple(fields))
    if len(set(names)) < len(names):
        raise SchemaError("DuplicateName", f"{name}: {sorted({n for n in names if names.count(n) > 1})}")
    return NodeType(name, properties, edges, rollups, tuple(indexes))


def _check(schema: Schema) -> None:
    for t in schema.types.values():
        for e in t.edges.values():
            back = schema.types[e.target].edges.get(e.reverse) if e.target in schema.types else None
            if back is None or back.target != t.name or back.reverse != e.name:
                raise SchemaError("MissingReverseEdge", f"{t.name}.{e.name} -> {e.target}.{e.reverse}")
            if e.sort and e.sort.field != "id" and e.sort.field not in schema.types[e.target].properties:
                raise SchemaError("InvalidEdgeDefinition", f"{t.name}.{e.name} sorts by {e.sort.field!r}")
        for r in t.rollups.values():
            if r.edge not in t.edges:
                raise SchemaError("InvalidRollupDefinition", f"{t.name}.{r.name}: no edge {r.edge!r}")
            target = schema.types[t.edges[r.edge].target]
            for f in (r.property, r.field):
                if f and f != "id" and target.field_kind(f) not in ("property", "rollup"):
                    raise SchemaError("InvalidRollupDefinition", f"{t.name}.{r.name}: {target.name} has no {f!r}")
        for fields in t.indexes:
            for f in fields:
                have = t.edges if f.kind == "edge" else {**t.properties, **t.rollups}
                if f.field not in have:
                    raise SchemaError("InvalidIndexDefinition", f"{t.name}: no {f.kind} {f.field!r}")
    for t in schema.types:
        schema.rollup_order(t)


def parse_schema(source: str | dict) -> Schema:
    """A checked Schema from JSON text or the parsed object."""
    if isinstance(source, str):
        try:
            source = json.loads(source)
        except ValueError as e:
            raise SchemaError("InvalidJson", str(e)) from e
    types = [_node_type(t) for t in _keys("schema", source, ("types",))["types"]]
    if len({t.name for t in types}) < len(types):
        raise SchemaError("DuplicateName", "types")
    schema = Schema({t.name: t for t in types})
    _check(schema)
    return schema
