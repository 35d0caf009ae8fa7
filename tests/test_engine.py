import pytest
from graphs import BLOG, blog, frame, levels, prop
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treelens import ALL, Expansion, Forest, Graph, View, as_of, diff, log_frame, parse_schema, query, select, watch, window_state, with_fields
from treelens.functions.ordering import numbered, reversed_keys, sort_keys
from treelens.functions.predicates import compare, tag_of_type
from treelens.operators.events import in_order, replay
from treelens.operators.mutations import dangling_links, delete_nodes
from treelens.operators.select import edge_targets, filtered, linked, roots
from treelens.plans.query import Filter
from treelens.schema import Sort
from treelens.sdk import Database, DeletedEntity
from treelens.streaming.live import Handlers, LiveView


def ids(df):
    return [r["id"] for r in df.collect()]


def found(g, *filters, type_name="User", **k):
    return sorted(ids(filtered(g, type_name, [Filter(*f) for f in filters], **k)))


# ------------------------------------------------------------------- filters


@pytest.mark.parametrize("op, value, expected", [
    ("eq", 30, [1, 4]), ("neq", 30, [2, 3]), ("gt", 18, [1, 4]), ("gte", 18, [1, 3, 4]), ("lt", 30, [2, 3]), ("lte", 18, [2, 3]),
    ("in", (18, None), [2, 3]), ("in", (), []), ("eq", None, [2]), ("neq", None, [1, 3, 4]), ("gt", None, [1, 3, 4]),
    ("gte", None, [1, 2, 3, 4]), ("lt", None, []), ("lte", None, [2]), ("gt", 18.5, [1, 4]), ("eq", 30.0, [1, 4]), ("eq", "30", []),
    ("lt", "x", [1, 2, 3, 4]), ("gt", True, [1, 3, 4]),
])
def test_filters_on_int(spark, op, value, expected):
    assert found(blog(spark), ("age", op, value)) == expected


def test_strict_tags(spark):
    g = blog(spark)
    assert found(g, ("age", "gt", 18.5), strict_tags=True) == []
    assert found(g, ("age", "lt", 18.5), strict_tags=True) == [1, 2, 3, 4]
    assert found(g, ("score", "gt", 3), strict_tags=True) == [1, 3, 4]
    assert found(g, ("score", "eq", float("nan"))) == [4]


_ORDER = {"null": 0, "bool": 1, "int": 2, "number": 3, "string": 4}


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=1, max_size=6), st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.sampled_from([-1.0, 0.5]), st.sampled_from(["", "a"])), st.sampled_from(["eq", "neq", "gt", "gte", "lt", "lte"]))
def test_compare_is_the_tagged_order(spark, values, literal, op):
    def key(v, strict):
        tag = "null" if v is None else {bool: "bool", int: "int", float: "number", str: "string"}[type(v)]
        return (_ORDER[tag if strict or tag not in ("int", "number") else "int"], 0 if v is None else v)

    df = frame(spark, "v long", [(v,) for v in values])
    for strict in (False, True):
        got = [r[0] for r in df.select(compare(F.col("v"), op, literal, df.schema["v"].dataType, strict)).collect()]
        a, b = [key(v, strict) for v in values], key(literal, strict)
        want = [{"eq": x == b, "neq": x != b, "gt": x > b, "gte": x >= b, "lt": x < b, "lte": x <= b}[op] for x in a]
        assert got == want, (values, literal, op, strict)
    assert tag_of_type(df.schema["v"].dataType) == "int"


def test_dotted_and_id_filters(spark):
    g = blog(spark)
    assert found(g, ("author.name", "eq", "Alice"), type_name="Post") == [10, 11]
    assert found(g, ("author.name", "eq", None), type_name="Post") == [13]
    assert found(g, ("post.author.age", "gte", 30), type_name="Comment") == [20, 21, 22, 23]
    assert found(g, ("id", "gt", 2), ("active", "eq", True)) == [4]


# -------------------------------------------------------------- sorts, rollups


def test_sort_puts_missing_first_then_last_and_ties_by_id(spark):
    g = blog(spark)
    assert ids(roots(g, "User").orderBy(*sort_keys([Sort("age")]))) == [2, 3, 1, 4]
    assert ids(roots(g, "User").orderBy(*sort_keys([Sort("age", "desc")]))) == [1, 4, 3, 2]
    assert ids(roots(g, "User").orderBy(*reversed_keys([Sort("age", "desc")]))) == [2, 3, 4, 1]
    assert ids(roots(g, "User").orderBy(*sort_keys([Sort("name")]))) == [3, 1, 2, 4]
    long = frame(spark, "id long, s string", [(1, "x" * 300 + "b"), (2, "x" * 300 + "a")])
    assert ids(long.orderBy(*sort_keys([Sort("s")]))) == [2, 1]


def test_numbered(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 7919 % 500).alias("k"))
    got = numbered(df, [F.col("k").asc()]).collect()
    assert {r["id"]: r["pos"] for r in got} == {i: i * 7919 % 500 for i in range(500)}
    assert numbered(df.limit(0), [F.col("k").asc()]).count() == 0


def test_rollups(spark):
    g = blog(spark)
    posts = {r["id"]: r for r in with_fields(g, "Post").collect()}
    assert {i: r["comment_count"] for i, r in posts.items()} == {10: 3, 11: 1, 12: 0, 13: 0}
    assert {i: r["author_name"] for i, r in posts.items()} == {10: "Alice", 11: "Alice", 12: "Bob", 13: None}
    assert posts[10]["top_comment"] == "z"
    assert {r["id"]: r["post_author"] for r in with_fields(g, "Comment").collect()} == dict.fromkeys((20, 21, 22, 23), "Alice")


THREADS = {
    "types": [
        {"name": "Thread", "properties": prop("name:string"), "edges": [{"name": "stacks", "target": "Stack", "reverse": "thread"}], "rollups": [
            {"name": "latest", "first": {"edge": "stacks", "field": "ts", "direction": "desc", "property": "ts"}},
            {"name": "oldest", "last": {"edge": "stacks", "field": "ts", "direction": "desc", "property": "ts"}},
            {"name": "first_id", "first": {"edge": "stacks", "field": "ts"}}, {"name": "last_id", "last": {"edge": "stacks", "field": "ts"}},
            {"name": "n", "count": "stacks"}]},
        {"name": "Stack", "properties": prop("ts:int"), "edges": [{"name": "thread", "target": "Thread", "reverse": "stacks"}]},
    ]
}


def test_first_and_last_with_ties_missing_and_two_parents(spark):
    g = Graph(spark, parse_schema(THREADS))
    g.bind_nodes("Thread", frame(spark, "id long, name string", [(1, "a"), (2, "b"), (3, "c")]))
    g.bind_nodes("Stack", frame(spark, "id long, ts long", [(10, 100), (11, 300), (12, 300), (13, None)]))
    g.bind_edges("Thread", "stacks", frame(spark, "src long, dst long", [(1, 10), (1, 11), (1, 12), (1, 13), (2, 12), (2, 10)]))
    rows = {r["id"]: r.asDict() for r in with_fields(g, "Thread").collect()}
    assert (rows[1]["latest"], rows[1]["oldest"], rows[1]["first_id"], rows[1]["last_id"], rows[1]["n"]) == (300, None, 13, 12, 4)
    assert (rows[2]["latest"], rows[2]["oldest"], rows[2]["first_id"], rows[2]["last_id"]) == (300, 100, 10, 12)
    assert (rows[3]["latest"], rows[3]["first_id"], rows[3]["n"]) == (None, None, 0)


def test_edges(spark):
    g = blog(spark)
    df, order = edge_targets(g, "Post", "comments", 10)
    assert ids(df.orderBy(*order)) == [21, 22, 20]
    assert g.has_edge("User", 1, "posts", 10) and not g.has_edge("User", 1, "posts", 12) and g.has_edge("Post", 12, "author", 4)
    assert sorted((r["src"], r["dst"]) for r in g.edges("User", "friends").pairs.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
    assert linked(g, "User", "posts", frame(spark, "src long, dst long", [(1, 10), (2, 10)])).count() == 1
    assert {r["id"]: r["n"] for r in g.source_counts("User", "posts").collect()} == {10: 1, 11: 1, 12: 2}
    assert {r["type"]: r["n"] for r in g.node_count().collect()} == {"User": 4, "Post": 4, "Comment": 4}
    assert sorted(ids(g.sources("User", "posts", 12))) == [2, 4]


# ----------------------------------------------------------------------- views


def walk(g, q, expansion=ALL):
    return [(r["type"], r["id"], r["depth"]) for r in Forest(g, q, expansion).flat().collect()]


def test_depth_first_order_with_siblings(spark):
    q = query("Root", select("level1", select("level2", sort=["name"]), select("extra", sort=["-name"]), sort=["name"]), sort=["name"])
    got = walk(levels(spark), q)
    assert got == [("Root", 2, 0), ("L1", 13, 1), ("L2", 23, 2), ("L2", 24, 2), ("Root", 1, 0), ("L1", 12, 1), ("L1", 11, 1), ("L2", 22, 2), ("L2", 21, 2)]


def test_expansion_is_per_node_and_edge(spark):
    q = query("Root", select("level1", select("level2", sort=["name"]), sort=["name"]), sort=["name"])
    g = levels(spark)
    assert walk(g, q, Expansion()) == [("Root", 2, 0), ("Root", 1, 0)]
    opened = Expansion(frozenset({("Root", 1, "level1"), ("L1", 11, "level2")}))
    assert walk(g, q, opened) == [("Root", 2, 0), ("Root", 1, 0), ("L1", 12, 1), ("L1", 11, 1), ("L2", 22, 2), ("L2", 21, 2)]
    assert walk(g, q, Expansion(all=True, depth=1)) == [("Root", 2, 0), ("L1", 13, 1), ("Root", 1, 0), ("L1", 12, 1), ("L1", 11, 1)]


def test_virtual_edges_and_roots(spark):
    g = levels(spark)
    q = query("Root", select("level1", select("level2", sort=["name"]), sort=["name"], virtual=True), sort=["name"])
    rows = Forest(g, q).flat().collect()
    assert [(r["type"], r["id"], r["depth"], r["parent_id"], r["edge"]) for r in rows] == [("Root", 2, 0, None, None), ("Root", 1, 0, None, None), ("L2", 23, 1, 1, "level1"), ("L2", 22, 1, 1, "level1"), ("L2", 21, 1, 1, "level1")]
    q = query("Root", select("level1", sort=["name"]), sort=["name"], virtual=True)
    assert walk(g, q) == [("L1", 13, 0), ("L1", 12, 0), ("L1", 11, 0)]


def test_recursion_stops_at_cycles_and_shows_a_node_once(spark):
    g = levels(spark)
    q = query("L2", select("children", sort=["name"], recursive=True), where=[("id", "eq", 21)])
    assert walk(g, q) == [("L2", 21, 0), ("L2", 22, 1), ("L2", 23, 2), ("L2", 24, 3)]
    q = query("L2", select("children", sort=["name"], recursive=True), sort=["name"], where=[("id", "in", (21, 24))])
    assert walk(g, q) == [("L2", 24, 0), ("L2", 21, 0), ("L2", 22, 1), ("L2", 23, 2)]


def test_view_window_and_clicks(spark):
    g = levels(spark)
    v = View(g, query("Root", select("level1", select("level2", sort=["name"]), sort=["name"]), sort=["name"]), limit=3)
    assert v.total() == 2 and [r["pos"] for r in v.items().collect()] == [0, 1]
    v.expand("Root", 1, "level1")
    v.expand("L1", 11, "level2")
    assert v.total() == 6 and v.is_expanded("Root", 1, "level1")
    assert v.scroll_to(99) == 3 and v.scroll_by(-1) == 2 and v.scroll_by(-9) == 0
    assert [r["id"] for r in v.items().collect()] == [2, 1, 12]
    assert v.index_of("L2", 22) == 4 and v.index_of("L2", 24) is None and v.node_at(3)["id"] == 11
    assert v.scroll_to_node("L2", 21) == 3 and v.contains_index(4) and not v.contains_index(6)
    assert v.toggle("Root", 1, "level1") is False and v.total() == 2
    assert v.expansion.triples == frozenset()
    v.expand_all()
    assert v.total() == 8
    v.collapse_all()
    assert v.total() == 2 and v.stats()["expanded"] == 0
    with pytest.raises(ValueError):
        v.expand("Root", 1, "extra")
    text = Forest(g, v.query, ALL).with_properties(Forest(g, v.query, ALL).flat(0, 1)).first()
    assert text["properties"] == '{"name":"r1"}' and text["has_children"]


def test_places_and_paths(spark):
    g = levels(spark)
    q = query("Root", select("level1", select("level2", sort=["-name"]), select("extra", sort=["name"]), sort=["name"]), sort=["-name"])
    v = View(g, q, limit=4)
    v.expand_all()
    rows = Forest(g, q).flat().collect()
    assert [v.index_of(rows[k]["type"], rows[k]["id"]) for k in (0, 3, 8)] == [0, 3, 8] and len(rows) == 9
    assert v.node_at_path(1) == ("Root", 1) and v.node_at_path(1, ("level1", 1)) == ("L1", 11) and v.node_at_path(1, ("level1", 1), ("level2", 0)) == ("L2", 21)
    assert v.path_to_index(1, ("level1", 1), ("level2", 0)) == [r["id"] for r in rows].index(21) and v.path_to_index(2) == len(rows) - 3
    assert v.node_at_path(9) is None and v.node_at_path(1, ("level1", 2)) is None and v.path_to_index(1, ("level1", -1)) is None
    assert v.visible_count() == 4
    v.scroll_to(10**6)
    assert v.visible_count() == 4 and v.offset == len(rows) - 4
    deep = Forest(g, query("L2", select("children", sort=["name"], recursive=True), where=[("id", "eq", 21)]))
    assert deep.index_of("L2", 23) == 2 and deep.id_at(21, [("children", 0), ("children", 0), ("children", 0)]) == ("L2", 24)


def walk_once(roots, children):
    """Depth first, each node once: (node, depth, parent)."""
    out, seen = [], set()

    def visit(n, depth, parent):
        if n not in seen:
            seen.add(n)
            out.append((n, depth, parent))
            for c in children.get(n, ()):
                visit(c, depth + 1, n)

    for r in roots:
        visit(r, 0, None)
    return out


NET = {"types": [{"name": "N", "properties": prop("v:int top:bool"), "edges": [{"name": "down", "target": "N", "reverse": "up"}, {"name": "up", "target": "N", "reverse": "down"}]}]}


@pytest.mark.parametrize(("seed", "tree"), [(s, t) for s in range(2) for t in (False, True)])
def test_recursion_is_a_walk_that_shows_each_node_once(spark, seed, tree):
    import random

    rnd = random.Random(seed)
    n = 14
    value, top = [rnd.choice([None, 1, 2, 3]) for _ in range(n)], [rnd.random() < 0.3 for _ in range(n)]
    pairs = {(rnd.randrange(n), d) for d in range(n) if rnd.random() < 0.9} if tree else {(rnd.randrange(n), rnd.randrange(n)) for _ in range(26)}
    g = Graph(spark, parse_schema(NET)).bind_nodes("N", frame(spark, "id long, v long, top boolean", [(i, value[i], top[i]) for i in range(n)]))
    g.bind_edges("N", "down", frame(spark, "src long, dst long", sorted(pairs)), one_source=tree)
    order = lambda i: (value[i] is None, -(value[i] or 0), i)
    children = {s: sorted((d for x, d in pairs if x == s), key=order) for s in range(n)}
    got = [(r["id"], r["depth"], r["parent_id"]) for r in Forest(g, query("N", select("down", sort=["-v"], recursive=True), where=[("top", "eq", True)], sort=["-v"])).flat().collect()]
    assert got == walk_once(sorted((i for i in range(n) if top[i]), key=order), children)
    few = Forest(g, query("N", select("down", sort=["-v"], recursive=True), where=[("top", "eq", True)], sort=["-v"]), Expansion(all=True, depth=1)).flat().collect()
    assert max((r["depth"] for r in few), default=0) <= 1


def test_recursion_with_selections_below_it_and_virtual_edges(spark):
    g = levels(spark)
    q = query("L1", select("level2", select("children", recursive=True, sort=["name"]), sort=["name"], virtual=True), where=[("id", "eq", 12)])
    rows = Forest(g, q).flat().collect()
    assert [(r["type"], r["id"], r["depth"], r["parent_id"], r["edge"]) for r in rows] == [("L1", 12, 0, None, None), ("L2", 24, 1, 12, "level2"), ("L2", 21, 1, 12, "level2"), ("L2", 22, 2, 21, "children")]  # the hidden 23 is on the way already
    q = query("L2", select("children", select("up", sort=["name"]), sort=["name"], recursive=True), where=[("id", "eq", 22)])
    rows = Forest(g, q).flat().collect()
    assert [(r["type"], r["id"], r["depth"]) for r in rows] == [("L2", 22, 0), ("L2", 23, 1), ("L2", 24, 2), ("L2", 21, 2), ("L1", 11, 3), ("L1", 12, 2)]
    hidden = query("L2", select("children", sort=["name"], recursive=True), where=[("id", "eq", 21)], virtual=True)
    assert [(r["id"], r["depth"], r["parent_id"]) for r in Forest(g, hidden).flat().collect()] == [(22, 0, None), (23, 1, 22), (24, 2, 23)]
    opened = Expansion(frozenset({("L2", 21, "children"), ("L2", 23, "children")}))
    q = query("L2", select("children", sort=["name"], recursive=True), where=[("id", "in", (21, 23))], sort=["name"])
    assert [(r["id"], r["depth"]) for r in Forest(g, q, opened).flat().collect()] == [(23, 0), (24, 1), (21, 1), (22, 2)]


def test_a_complete_graph_and_a_deep_chain_end(spark):
    n = 12
    every = [(a, b) for a in range(n) for b in range(a + 1)]
    g = Graph(spark, parse_schema(BLOG)).bind_nodes("User", frame(spark, "id long, name string, age long, score double, active boolean", [(i, None, i, None, None) for i in range(n)]))
    g.bind_edges("User", "friends", frame(spark, "src long, dst long", every))
    rows = Forest(g, query("User", select("friends", sort=["age"], recursive=True), where=[("id", "eq", 0)])).flat().collect()
    assert [(r["id"], r["depth"]) for r in rows] == [(i, i) for i in range(n)]


def test_empty_graph(spark):
    g = Graph(spark, parse_schema(THREADS))
    assert Forest(g, query("Thread", select("stacks"))).flat().collect() == []
    assert with_fields(g, "Thread").count() == 0


# ---------------------------------------------------------- mutations and events


def test_log_makes_snapshots(spark):
    g = blog(spark)
    log = log_frame(spark, [
        (1, "insert", "User", 9, {"name": "Zoe", "age": "7"}, None, None), (2, "update", "User", 1, {"age": None, "score": "9.5"}, None, None),
        (3, "update", "User", 1, {"age": "31"}, None, None), (4, "link", "Post", 13, None, "author", 9), (5, "unlink", "User", 1, None, "posts", 11),
        (6, "delete", "User", 2, None, None, None), (7, "link", "User", 1, None, "posts", 11),
    ])
    early, late = as_of(g, log, 2), as_of(g, log)
    rows = {r["id"]: r for r in late.nodes("User").collect()}
    assert sorted(rows) == [1, 3, 4, 9] and (rows[1]["age"], rows[1]["score"], rows[1]["name"]) == (31, 9.5, "Alice") and rows[9]["age"] == 7
    assert {r["id"]: r["age"] for r in early.nodes("User").collect()}[1] is None
    assert sorted((r["src"], r["dst"]) for r in late.edges("User", "posts").pairs.collect()) == [(1, 10), (1, 11), (4, 12), (9, 13)]
    assert sorted((r["src"], r["dst"]) for r in late.edges("User", "friends").pairs.collect()) == [(1, 1), (1, 3), (3, 1)]
    seen = [(r["seq"], r["event"], r["type"], r["id"], r["other_id"]) for r in watch(g.schema, log).orderBy("seq", "type").collect()]
    assert seen == [(2, "change", "User", 1, None), (3, "change", "User", 1, None), (4, "link", "Post", 13, 9), (4, "link", "User", 9, 13), (5, "unlink", "Post", 11, 1), (5, "unlink", "User", 1, 11), (6, "delete", "User", 2, None), (7, "link", "Post", 11, 1), (7, "link", "User", 1, 11)]
    assert watch(g.schema, log, "User", 9).count() == 1
    gone = delete_nodes(g, "User", frame(spark, "id long", [(1,)]))
    assert gone.edges("User", "posts").pairs.count() == 2


def test_events_between_snapshots(spark):
    g = blog(spark)
    q = query("Post", where=[("published", "eq", True)], sort=["-views"])
    log = log_frame(spark, [(1, "update", "Post", 10, {"views": "2000"}, None, None), (2, "update", "Post", 11, {"title": "B"}, None, None), (3, "update", "Post", 12, {"published": "true"}, None, None)])
    old, new = window_state(g, q, 0, 2), window_state(as_of(g, log), q, 0, 2)
    got = [(r["event"], r["id"], r["from_index"], r["to_index"]) for r in in_order(diff(old, new)).collect()]
    assert got == [("change", 10, 1, 0), ("move", 10, 1, 0), ("change", 11, 0, 1)]
    whole_old, whole_new = window_state(g, q), window_state(as_of(g, log), q)
    ev = diff(whole_old, whole_new)
    assert [(r["event"], r["id"]) for r in in_order(ev).collect()][-1] == ("enter", 12)
    assert sorted(map(tuple, replay(whole_old, whole_new, ev).collect())) == sorted((r["type"], r["id"]) for r in whole_new.collect())


def test_rollups_change_a_node_only_on_request(spark):
    g, q = blog(spark), query("Post", sort=["title"])
    after = as_of(g, log_frame(spark, [(1, "unlink", "Post", 10, None, "comments", 20)]))
    assert diff(window_state(g, q), window_state(after, q)).count() == 0
    assert [r["event"] for r in diff(window_state(g, q, include_rollups=True), window_state(after, q, include_rollups=True)).collect()] == ["change"]


def test_live_view_follows_a_stream(spark, tmp_path):
    from treelens.operators.mutations import LOG

    seen = []
    live = LiveView(blog(spark), query("Post", where=[("published", "eq", True)], sort=["-views"]), lambda e, b: seen.append([(r["event"], r["id"]) for r in e.collect()]), height=2, path=f"file://{tmp_path}/live", immediate=True)
    source = f"{tmp_path}/log"
    log_frame(spark, [(1, "update", "Post", 10, {"views": "2000"}, None, None)]).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    running = live.activate(stream, availableNow=True)
    running.awaitTermination(120)
    assert seen[0] == [("enter", 11), ("enter", 10)] and seen[1] == [("change", 10), ("move", 10)]
    live.unsubscribe()
    calls = []
    h = Handlers()
    h.on("enter", lambda r: calls.append(0))
    h.on("enter", lambda r: calls.append(r["id"]))
    live.handler = h
    live.apply(log_frame(spark, [(2, "update", "Post", 12, {"published": "true", "views": "5000"}, None, None)]), 7)
    assert calls == [12]
    h.off("enter")
    with pytest.raises(ValueError):
        h.on("update", print)


def test_live_view_goes_on_after_a_restart(spark, tmp_path):
    """Stopped after every batch, and with batches run again: the events of a run without stops."""
    from treelens.sources.shared import folders

    q = query("Post", where=[("published", "eq", True)], sort=["-views"])
    batches = [
        [(1, "update", "Post", 10, {"views": "2000"}, None, None)],
        [(2, "insert", "Post", 40, {"title": "n", "views": "1500", "published": "true"}, None, None), (3, "link", "User", 1, None, "posts", 40)],
        [(4, "update", "User", 1, {"name": "Al"}, None, None), (5, "delete", "Post", 10, None, None, None)],
        [(6, "unlink", "Post", 40, None, "author", 1), (7, "update", "Post", 12, {"published": "true"}, None, None)],
    ]

    def run(path, make):
        seen = []
        live = None
        for k, rows in enumerate(batches):
            live = make(live, k, lambda e, b: seen.append((b, [(r["event"], r["id"], r["from_index"], r["to_index"]) for r in e.collect()])))
            live.apply(log_frame(spark, rows), k)
            assert live.versions() == [k - 1, k]
        return seen, live

    whole, one = run("a", lambda live, k, h: live or LiveView(blog(spark), q, h, height=2, path=f"file://{tmp_path}/a"))
    fresh = lambda live, k, h: LiveView(blog(spark), q, h, height=2, path=f"file://{tmp_path}/b")
    stopped, _ = run("b", fresh)
    assert stopped == whole and [b for b, _ in whole] == [0, 1, 2, 3] and whole[1][1][0][0] == "leave"
    again = []
    other = LiveView(blog(spark), q, lambda e, b: again.append((b, [(r["event"], r["id"], r["from_index"], r["to_index"]) for r in e.collect()])), height=2, path=f"file://{tmp_path}/b")
    other.apply(log_frame(spark, batches[3]), 3)
    assert again == [whole[3]]
    for t in ("Post", "User"):
        assert sorted(map(repr, one.graph.nodes(t).collect())) == sorted(map(repr, other.graph.nodes(t).collect()))
    assert sorted(map(tuple, other.graph.edges("User", "posts").pairs.collect())) == [(1, 11), (2, 12), (4, 12)]
    # only what the last two versions name is left: comments were never touched
    left = [n for v in folders(spark, f"file://{tmp_path}/b") if v.startswith("v") and v != "versions" for n in folders(spark, f"file://{tmp_path}/b/{v}")]
    assert not any("Comment" in n and n.startswith("nodes") for n in left) and sum(n.startswith("window") for n in left) == 2


def test_live_view_resumes_a_stream_from_its_checkpoint(spark, tmp_path):
    from treelens.operators.mutations import LOG

    seen, source = [], f"{tmp_path}/log"
    rows = [(1, "update", "Post", 10, {"views": "2000"}, None, None), (2, "update", "Post", 12, {"published": "true", "views": "5000"}, None, None)]
    for row in rows:
        log_frame(spark, [row]).coalesce(1).write.mode("append").parquet(source)
        live = LiveView(blog(spark), query("Post", where=[("published", "eq", True)], sort=["-views"]), lambda e, b: seen.append((b, [(r["event"], r["id"]) for r in e.collect()])), height=2, path=f"file://{tmp_path}/live")
        live.activate(spark.readStream.schema(LOG).parquet(source), availableNow=True).awaitTermination(120)
        live.unsubscribe()
    assert seen == [(0, [("change", 10), ("move", 10)]), (1, [("leave", 11), ("enter", 12)])]


def test_links_to_unknown_nodes_do_nothing(spark):
    g = blog(spark)
    log = log_frame(spark, [
        (1, "link", "User", 1, None, "posts", 77), (2, "link", "User", 78, None, "posts", 10), (3, "link", "User", 3, None, "posts", 50), (4, "insert", "Post", 50, {"title": "late"}, None, None),
        (5, "link", "User", 3, None, "posts", 50), (6, "delete", "Post", 12, None, None, None), (7, "link", "User", 1, None, "posts", 12), (8, "unlink", "User", 1, None, "posts", 999),
    ])
    assert sorted((r["seq"], r["src"], r["dst"]) for r in dangling_links(g, log).collect()) == [(1, 1, 77), (2, 78, 10), (3, 3, 50), (7, 1, 12)]
    assert sorted(map(tuple, as_of(g, log).edges("User", "posts").pairs.collect())) == [(1, 10), (1, 11), (3, 50)]


# ------------------------------------------------------------------------- sdk


def test_sdk(spark):
    db = Database(Graph(spark, parse_schema({"types": [
        {"name": "User", "properties": prop("name:string age:int"), "edges": [{"name": "posts", "target": "Post", "reverse": "author"}], "rollups": [{"name": "n", "count": "posts"}]},
        {"name": "Post", "properties": prop("title:string"), "edges": [{"name": "author", "target": "User", "reverse": "posts"}]},
    ]})))
    user, post = db.insert("User", {"name": "Alice"}), db.insert("Post", {"title": "Hi"})
    assert (user.id(), post.id(), user.type()) == (1, 2, "User")
    names, counts, entered, cleaned = [], [], [], []
    end = user.name.use(lambda v: names.append(v) or (lambda: cleaned.append(v)))
    user.n.on_change(lambda new, old: counts.append((old, new)))
    user.posts.on_enter(lambda e: entered.append(e.id()))
    each = []
    user.posts.each(lambda e: each.append(e.id()) or (lambda: each.append(-e.id())))
    user.posts.link(post)
    user.posts.link(post)
    user.update(name="Bob")
    assert names == ["Alice", "Bob"] and cleaned == ["Alice"] and counts == [(0, 1)] and entered == [2] and each == [2]
    assert [e.id() for e in user.posts] == [2] and db.has_edge("Post", 2, "author", 1) and db.field_type("User", "n") == "rollup"
    end()
    assert cleaned == ["Alice", "Bob"]
    with pytest.raises(ValueError):
        db.update("User", 1, {"age": "old"})
    told = []
    db.on("User", 1, "unlink", lambda *a: told.append(a))
    post.delete()
    assert post.is_deleted() and each == [2, -2] and told == [("posts", 2)] and db.get("Post", 2) is None and user.n.get() == 0
    with pytest.raises(DeletedEntity):
        post.update(title="x")
    assert db.query({"root": "User"}, 10).items().first()["id"] == 1
