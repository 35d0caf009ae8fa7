"""Filters as Columns, with two-valued logic: a missing value compares as the
smallest value of all and equals only a missing value."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "in")
#: fixed values: order of the value kinds under strict tags
TAGS = {"null": 0, "bool": 1, "int": 2, "number": 3, "string": 4}


def tag_of_literal(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "number"
    if isinstance(value, str):
        return "string"
    raise TypeError(f"no literal of the graph's types: {value!r}")


def tag_of_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, T.FractionalType):
        return "number"
    return "string"


def _comparable(kind: str, literal: str) -> bool:
    return kind == literal or {kind, literal} <= {"int", "number"}


def _by_tag(c: Column, op: str, column_tag: str, literal_tag: str) -> Column:
    """Values of another kind: only the kinds decide, and missing is least."""
    if op in ("eq", "in"):
        return F.lit(False)
    if op == "neq":
        return F.lit(True)
    above = TAGS[column_tag] > TAGS[literal_tag]
    if op in ("gt", "gte"):
        return c.isNotNull() if above else F.lit(False)
    return c.isNull() if above else F.lit(True)


def compare(c: Column, op: str, value: Any, kind: T.DataType | None = None, strict_tags: bool = False) -> Column:
    """c op value, never null.  kind: the column's type, needed for literals of
    another kind; int and number compare by value unless strict_tags."""
    if op not in OPS:
        raise ValueError(f"unknown operator {op!r}")
    if op == "in":
        out = F.lit(False)
        for v in value or []:
            out = out | compare(c, "eq", v, kind, strict_tags)
        return out
    tag = tag_of_literal(value)
    if tag == "null":
        return {"eq": c.isNull(), "neq": c.isNotNull(), "gt": c.isNotNull(), "gte": F.lit(True), "lt": F.lit(False), "lte": c.isNull()}[op]
    if kind is not None:
        own = tag_of_type(kind)
        stamp = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and tag == "string"
        if not stamp and (own != tag if strict_tags else not _comparable(own, tag)):
            return _by_tag(c, op, own, tag)
        lit = F.lit(value).cast(kind) if stamp else F.lit(value)
    else:
        lit = F.lit(value)
    if op == "eq":
        return c.eqNullSafe(lit)
    if op == "neq":
        return ~c.eqNullSafe(lit)
    if op in ("gt", "gte"):
        return c.isNotNull() & ((c > lit) if op == "gt" else (c >= lit))
    return c.isNull() | ((c < lit) if op == "lt" else (c <= lit))
