"""Small graphs that several tests share."""

from treelens import Graph, parse_schema


def prop(text):
    return [dict(zip(("name", "type"), p.split(":"), strict=True)) for p in text.split()]


def edge(name, target, reverse, sort=None):
    return {"name": name, "target": target, "reverse": reverse} | ({"sort": sort} if sort else {})


def index(*fields):
    return {"fields": [{"field": f.lstrip("-"), "direction": "desc" if f[0] == "-" else "asc"} for f in fields]}


BLOG = {
    "types": [
        {"name": "User", "properties": prop("name:string age:int score:number active:bool"), "edges": [edge("posts", "Post", "author"), edge("friends", "User", "friends")], "indexes": [index("name"), index("active")]},
        {
            "name": "Post", "properties": prop("title:string views:int published:bool"),
            "edges": [edge("author", "User", "posts"), edge("comments", "Comment", "post", {"property": "text", "direction": "desc"})],
            "indexes": [index("-views"), index("published", "-views")],
            "rollups": [
                {"name": "author_name", "traverse": {"edge": "author", "property": "name"}}, {"name": "comment_count", "count": "comments"},
                {"name": "top_comment", "traverse": {"edge": "comments", "property": "text"}},
            ],
        },
        {"name": "Comment", "properties": prop("text:string approved:bool"), "edges": [edge("post", "Post", "comments")], "rollups": [{"name": "post_author", "traverse": {"edge": "post", "property": "author_name"}}]},
    ]
}


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def blog(spark):
    g = Graph(spark, parse_schema(BLOG))
    users = [(1, "Alice", 30, 1.5, True), (2, "Bob", None, None, False), (3, None, 18, 2.5, None), (4, "alice", 30, float("nan"), True)]
    g.bind_nodes("User", frame(spark, "id long, name string, age long, score double, active boolean", users))
    posts = [(10, "a", 10, True), (11, "b", 1000, True), (12, "c", 100, False), (13, "d", None, None)]
    g.bind_nodes("Post", frame(spark, "id long, title string, views long, published boolean", posts))
    comments = [(20, "x", True), (21, "z", False), (22, "z", None), (23, None, None)]
    g.bind_nodes("Comment", frame(spark, "id long, text string, approved boolean", comments))
    g.bind_edges("User", "posts", frame(spark, "src long, dst long", [(1, 10), (1, 11), (2, 12), (1, 10), (4, 12)]))
    g.bind_edges("User", "friends", frame(spark, "src long, dst long", [(1, 2), (2, 3), (3, 1), (1, 1)]))
    g.bind_edges("Post", "comments", frame(spark, "src long, dst long", [(10, 20), (10, 22), (10, 21), (11, 23)]))
    return g


NODES = {
    "types": [
        {"name": "Root", "properties": prop("name:string"), "edges": [edge("level1", "L1", "root")]},
        {"name": "L1", "properties": prop("name:string"), "edges": [edge("root", "Root", "level1"), edge("level2", "L2", "up"), edge("extra", "L2", "also")]},
        {"name": "L2", "properties": prop("name:string"), "edges": [edge("up", "L1", "level2"), edge("also", "L1", "extra"), edge("children", "L2", "parents"), edge("parents", "L2", "children")]},
    ]
}


def levels(spark):
    g = Graph(spark, parse_schema(NODES))
    names = lambda rows: frame(spark, "id long, name string", rows)
    pairs = lambda rows: frame(spark, "src long, dst long", rows)
    g.bind_nodes("Root", names([(1, "r2"), (2, "r1")])).bind_nodes("L1", names([(11, "c"), (12, "a"), (13, "b")]))
    g.bind_nodes("L2", names([(21, "z"), (22, "y"), (23, "x"), (24, "w")]))
    g.bind_edges("Root", "level1", pairs([(1, 11), (1, 12), (2, 13)]))
    g.bind_edges("L1", "level2", pairs([(11, 21), (11, 22), (12, 23)])).bind_edges("L1", "extra", pairs([(13, 24), (13, 23)]))
    g.bind_edges("L2", "children", pairs([(21, 22), (22, 23), (23, 21), (23, 24)]))
    return g
