import copy
import json

import pytest
from graphs import BLOG, edge, prop

from treelens import TreePath, explain_query, parse_query, parse_schema, query
from treelens.paths import PathError
from treelens.plans.access import explain_access, lint_rollups
from treelens.plans.query import QueryError, analyze
from treelens.schema import SchemaError, Sort


def code(source):
    with pytest.raises(SchemaError) as e:
        parse_schema(source)
    return e.value.code


def changed(f):
    out = copy.deepcopy(BLOG)
    f({t["name"]: t for t in out["types"]})
    return out


def test_parses_and_looks_fields_up_in_order():
    s = parse_schema(json.dumps(BLOG))
    assert [s["Post"].field_kind(n) for n in ("title", "author", "author_name", "none")] == ["property", "edge", "rollup", None]
    assert s.is_symmetric("User", "friends") and not s.is_symmetric("User", "posts")
    assert s.rollup_order("Comment") == [("Post", "author_name"), ("Comment", "post_author")]
    assert s["Post"].edges["comments"].sort == Sort("text", "desc")


@pytest.mark.parametrize("name, source", [
    ("InvalidJson", "{"), ("InvalidJson", {"types": [{}]}), ("UnknownKey", {"types": [], "more": 1}),
    ("InvalidPropertyType", {"types": [{"name": "A", "properties": prop("a:i64")}]}),
    ("MissingReverseEdge", {"types": [{"name": "A", "edges": [edge("b", "B", "a")]}]}),
    ("MissingReverseEdge", {"types": [{"name": "A", "edges": [edge("b", "A", "c")]}]}),
    ("DuplicateName", {"types": [{"name": "A"}, {"name": "A"}]}),
    ("DuplicateName", {"types": [{"name": "A", "properties": prop("a:int a:bool")}]}),
    ("InvalidDirection", changed(lambda t: t["Post"]["edges"][1]["sort"].update(direction="down"))),
    ("InvalidEdgeDefinition", changed(lambda t: t["Post"]["edges"][1]["sort"].update(property="nope"))),
    ("InvalidRollupDefinition", changed(lambda t: t["Post"]["rollups"].append({"name": "r"}))),
    ("InvalidRollupDefinition", changed(lambda t: t["Post"]["rollups"].append({"name": "r", "count": "nope"}))),
    ("InvalidIndexDefinition", changed(lambda t: t["Post"]["indexes"].append({"fields": [{"field": "nope"}]}))),
])
def test_rejects(name, source):
    assert code(source) == name


def test_rejects_cyclic_rollups():
    a = {"name": "A", "edges": [edge("next", "A", "prev"), edge("prev", "A", "next")], "rollups": [{"name": "r", "traverse": {"edge": "next", "property": "r"}}]}
    assert code({"types": [a]}) == "CyclicRollup"


def test_first_rollup_kind_wins():
    t = changed(lambda t: t["Post"]["rollups"].append({"name": "r", "traverse": {"edge": "author", "property": "name"}, "count": "comments"}))
    assert parse_schema(t)["Post"].rollups["r"].kind == "count"


def test_query_errors():
    s = parse_schema(BLOG)
    for name, source in {
        "TypeNotFound": {"root": "Nope"}, "UnknownEdge": {"root": "User", "edges": [{"name": "comments"}]},
        "UnknownField": {"root": "User", "filter": [{"field": "nope"}]}, "UnknownKey": {"root": "User", "filters": []},
        "InvalidQuery": {"root": "User", "filter": [{"field": "name", "op": "like"}]},
    }.items():
        with pytest.raises(QueryError) as e:
            analyze(s, parse_query(source))
        assert e.value.code == name
    with pytest.raises(QueryError):
        analyze(s, query("Post", sort=["nope"]))


def test_index_coverage():
    s = parse_schema(BLOG)
    c = explain_query(s, query("Post", where=[("published", "eq", True), ("title", "neq", "x")], sort=["-views"]))
    assert (c.index, c.equality, c.sort, c.score, [f.field for f in c.post_filters]) == (1, 1, 1, 110, ["title"])
    assert explain_query(s, query("Post", where=[("views", "gt", 3)])).score == 50
    assert explain_query(s, query("Post", sort=["views"])) is None
    with pytest.raises(QueryError):
        explain_query(s, query("Post"), require_index=True)
    assert explain_access(s, "Post", (), (), parent_edge="author") is None
    assert lint_rollups(s) == []


def test_paths():
    p = TreePath.parse("user:123/posts:456/comments")
    assert (p.target(), p.depth, str(p.parent()), p.is_node) == (("edge", 456, "comments"), 1, "user:123/posts:456", False)
    assert TreePath.parse("user:1").target() == ("node", 1) and TreePath.parse("user:1").parent() is None
    for bad, name in {"": "EmptyPath", "user": "MissingRootId", "user:x": "InvalidNodeId", "user:1//a": "InvalidFormat", "user:1/a/b": "InvalidFormat", ":1": "InvalidFormat", "a:1:2": "InvalidFormat"}.items():
        with pytest.raises(PathError) as e:
            TreePath.parse(bad)
        assert e.value.code == name
