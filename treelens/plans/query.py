"""Query declarations: a filtered, sorted root type and a tree of selections."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from ..functions.predicates import OPS, tag_of_literal
from ..schema import Schema, Sort, parse_sort


class QueryError(ValueError):
    """code: InvalidJson, UnknownKey, TypeNotFound, UnknownEdge, UnknownField,
    InvalidQuery."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Filter:
    """field may be a path of edges and a property, joined by dots: each edge
    leads to its first target."""

    field: str
    op: str = "eq"
    value: Any = None


@dataclass(frozen=True)
class Selection:
    edge: str
    filters: tuple[Filter, ...] = ()
    sorts: tuple[Sort, ...] = ()
    selections: tuple[Selection, ...] = ()
    recursive: bool = False
    virtual: bool = False


@dataclass(frozen=True)
class Query:
    root: str
    id: int | None = None
    virtual: bool = False
    filters: tuple[Filter, ...] = ()
    sorts: tuple[Sort, ...] = ()
    selections: tuple[Selection, ...] = ()


def children_of(selection: Selection) -> tuple[Selection, ...]:
    """What is selected below a node of the selection: a recursive one again."""
    return (*selection.selections, selection) if selection.recursive else selection.selections


def in_edge_order(selections: Sequence[Selection]) -> list[Selection]:
    """Siblings in alphabetical order of their edges."""
    return sorted(selections, key=lambda s: s.edge)


# -------------------------------------------------------------------- parsing


def _object(where: str, value: Any, required: tuple[str, ...], optional: tuple[str, ...]) -> dict:
    if not isinstance(value, dict):
        raise QueryError("InvalidJson", f"{where} is no object")
    if unknown := set(value) - set(required) - set(optional):
        raise QueryError("UnknownKey", f"{where} has {sorted(unknown)}")
    if missing := set(required) - set(value):
        raise QueryError("InvalidJson", f"{where} lacks {sorted(missing)}")
    return value


def _filter(value: Any) -> Filter:
    d = _object("filter", value, ("field",), ("op", "value"))
    op = d.get("op", "eq")
    if op not in OPS:
        raise QueryError("InvalidQuery", f"unknown operator {op!r}")
    literal = d.get("value")
    return Filter(d["field"], op, tuple(literal) if isinstance(literal, list) else literal)


def _selection(value: Any) -> Selection:
    d = _object("selection", value, ("name",), ("recursive", "virtual", "sort", "filter", "edges"))
    return Selection(
        d["name"], tuple(map(_filter, d.get("filter", []))), tuple(parse_sort("sort", s) for s in d.get("sort", [])),
        tuple(map(_selection, d.get("edges", []))), bool(d.get("recursive", False)), bool(d.get("virtual", False)),
    )


def parse_query(source: str | dict) -> Query:
    """A Query from JSON text or the parsed object; not yet checked."""
    if isinstance(source, str):
        try:
            source = json.loads(source)
        except ValueError as e:
            raise QueryError("InvalidJson", str(e)) from e
    d = _object("query", source, ("root",), ("id", "virtual", "sort", "filter", "edges"))
    return Query(
        d["root"], d.get("id"), bool(d.get("virtual", False)), tuple(map(_filter, d.get("filter", []))),
        tuple(parse_sort("sort", s) for s in d.get("sort", [])), tuple(map(_selection, d.get("edges", []))),
    )


def query(root: str, *selections: Selection, where: Sequence[tuple] = (), sort: Sequence[str] = (), id: int | None = None, virtual: bool = False) -> Query:
    """Builder: where takes (field, op, value); sort takes "field" or "-field"."""
    return Query(root, id, virtual, tuple(Filter(*w) for w in where), shorthand(sort), tuple(selections))


def select(edge: str, *selections: Selection, where: Sequence[tuple] = (), sort: Sequence[str] = (), recursive: bool = False, virtual: bool = False) -> Selection:
    return Selection(edge, tuple(Filter(*w) for w in where), shorthand(sort), tuple(selections), recursive, virtual)


def shorthand(sorts: Sequence[str]) -> tuple[Sort, ...]:
    return tuple(Sort(s.lstrip("-"), "desc" if s.startswith("-") else "asc") for s in sorts)


# ------------------------------------------------------------------- analysis


def _check_fields(schema: Schema, type_name: str, filters: Sequence[Filter], sorts: Sequence[Sort]) -> None:
    for f in filters:
        *hops, last = f.field.split(".")
        at = type_name
        for hop in hops:
            if hop not in schema[at].edges:
                raise QueryError("UnknownEdge", f"{at}.{hop}")
            at = schema[at].edges[hop].target
        if last != "id" and schema[at].field_kind(last) not in ("property", "rollup"):
            raise QueryError("UnknownField", f"{at}.{last}")
        if f.op == "in":
            if not isinstance(f.value, (tuple, list, type(None))):
                raise QueryError("InvalidQuery", f"{f.field}: `in` takes a list")
            values = f.value or ()
        else:
            values = (f.value,)
        for v in values:
            try:
                tag_of_literal(v)
            except TypeError as e:
                raise QueryError("InvalidQuery", str(e)) from e
    for s in sorts:
        if s.field != "id" and schema[type_name].field_kind(s.field) not in ("property", "rollup"):
            raise QueryError("UnknownField", f"sort by {type_name}.{s.field}")


def _check_selections(schema: Schema, type_name: str, selections: Sequence[Selection]) -> None:
    seen = set()
    for s in selections:
        if s.edge in seen:
            raise QueryError("InvalidQuery", f"{type_name}.{s.edge} is selected twice")
        seen.add(s.edge)
        edge = schema[type_name].edges.get(s.edge)
        if edge is None:
            raise QueryError("UnknownEdge", f"{type_name}.{s.edge}")
        if s.recursive and edge.target != type_name and s.edge not in schema[edge.target].edges:
            raise QueryError("InvalidQuery", f"{type_name}.{s.edge} can't recur on {edge.target}")
        _check_fields(schema, edge.target, s.filters, s.sorts)
        _check_selections(schema, edge.target, s.selections)


def analyze(schema: Schema, q: Query) -> Query:
    """q checked against the schema; raises QueryError."""
    if q.root not in schema.types:
        raise QueryError("TypeNotFound", q.root)
    _check_fields(schema, q.root, q.filters, q.sorts)
    _check_selections(schema, q.root, q.selections)
    return q


def fields_of(filters: Sequence[Filter], sorts: Sequence[Sort]) -> set[str]:
    """Names of the type's own fields that filters and sorts read."""
    return {f.field for f in filters if "." not in f.field} | {s.field for s in sorts}
