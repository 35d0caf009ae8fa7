"""Live views over a mutation log, by Structured Streaming.

Each micro-batch of log rows is applied to the last snapshot; the window is
computed anew and compared with the one before; the events go to a handler.  A
ranked window is a property of the whole graph, so state is the snapshot, not
per key.

A version of the snapshot is the tables that its batch touched (node types and
edges that the log names) and those of earlier versions for the rest; a small
record under `versions` names them and is written last.  A view that is made on
the path of an earlier one goes on from its last version, whatever process wrote
it.  A batch that is run again starts from the version before it and gives the
same events, so a handler gets every event at least once.  The last two versions
are kept; what only older ones name is deleted."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import diff, in_order, window_state
from ..operators.mutations import EDGE_OPS, as_of
from ..operators.view import Expansion
from ..plans.query import Query, analyze
from ..sources.graph import EdgePairs, Graph
from ..sources.shared import delete_path, folders, keep_until_exit, materialize, shared_dir

START = -1


class LiveView:
    """A query kept up to date.  handler(events, batch_id) gets each batch's
    events; events go nowhere else.  path: a shared folder that outlives the
    process; without it the view ends with the process."""

    def __init__(self, graph: Graph, q: Query, handler: Callable[[DataFrame, int], None], height: int = 0, offset: int = 0, expansion: Expansion | None = None, path: str | None = None, immediate: bool = False):
        self.base, self.query = graph, analyze(graph.schema, q)
        self.handler, self.height, self.offset, self.expansion = handler, height, offset, expansion
        self.path = (path or f"{shared_dir(graph.spark)}/live-{uuid.uuid4().hex}").rstrip("/")
        if path is None:
            keep_until_exit(graph.spark, self.path)
        self.immediate = immediate
        self.stream = None
        known = self.versions()
        if known:
            self._open(known[-1])
        else:
            self._commit(START, {}, {}, self._window(graph, START))

    # ------------------------------------------------------------- versions

    def versions(self) -> list[int]:
        """The batches whose version is complete, in order."""
        return sorted(int(name) for name in folders(self.base.spark, f"{self.path}/versions", done=True))

    def _window(self, graph: Graph, batch_id: int) -> str:
        """The name of the written window of a graph."""
        name = f"v{batch_id}/window-{uuid.uuid4().hex}"
        materialize(window_state(graph, self.query, self.offset, self.height, self.expansion), f"{self.path}/{name}")
        return name

    def _commit(self, batch_id: int, nodes: dict[str, str], edges: dict[str, str], window: str) -> None:
        record = json.dumps({"nodes": nodes, "edges": edges, "window": window})
        self.base.spark.createDataFrame([(record,)], "record string").coalesce(1).write.mode("overwrite").text(f"{self.path}/versions/{batch_id}")
        self._open(batch_id)

    def _record(self, batch_id: int) -> dict:
        return json.loads(self.base.spark.read.text(f"{self.path}/versions/{batch_id}").first()[0])

    def _open(self, batch_id: int) -> None:
        self.version, self.record = batch_id, self._record(batch_id)
        self.graph, self.state = self._graph(self.record["nodes"], self.record["edges"]), self._read(self.record["window"])

    def _read(self, name: str) -> DataFrame:
        return self.base.spark.read.parquet(f"{self.path}/{name}")

    def _graph(self, nodes: dict[str, str], edges: dict[str, str]) -> Graph:
        """The base graph with the tables that a version names."""

        def nodes_of(t: str) -> DataFrame:
            return self._read(nodes[t]) if t in nodes else self.base.nodes(t)

        def pairs_of(key: tuple[str, str]) -> EdgePairs:
            name = "/".join(key)
            return EdgePairs(self._read(edges[name])) if name in edges else self.base.edges(*key)

        return self.base.replaced({t: (lambda t=t: nodes_of(t)) for t in self.base.schema.types}, {k: (lambda k=k: pairs_of(k)) for k in self.base.edge_names()})

    def _clean(self) -> None:
        """Delete what the last two versions don't name."""
        spark, known = self.base.spark, self.versions()
        kept = [self._record(v) for v in known[-2:]]
        named = {n for r in kept for n in (r["window"], *r["nodes"].values(), *r["edges"].values())}
        for version in folders(spark, self.path):
            if version.startswith("v") and version != "versions":
                for name in folders(spark, f"{self.path}/{version}"):
                    if f"{version}/{name}" not in named:
                        delete_path(spark, f"{self.path}/{version}/{name}")
        for v in known[:-2]:
            delete_path(spark, f"{self.path}/versions/{v}")

    def _touched(self, log: DataFrame) -> tuple[set[str], set[tuple[str, str]]]:
        """Node types and edge pairs that the log changes (as many as the schema has)."""
        schema, types, pairs = self.base.schema, set(), set()
        for op, type_name, edge in log.select("op", "type", "edge").distinct().collect():
            for key in self.base.edge_names():
                e = schema.edge(*key)
                if op in EDGE_OPS and (type_name, edge) in (key, (e.target, e.reverse)):
                    pairs.add(key)
                if op == "delete" and type_name in (key[0], e.target):
                    pairs.add(key)
            if op not in EDGE_OPS:
                types.add(type_name)
        return types, pairs

    # --------------------------------------------------------------- batches

    def apply(self, log: DataFrame, batch_id: int) -> DataFrame:
        """Take in log rows; returns the events in order and hands them on."""
        if batch_id <= self.version:  # run again: its version doesn't count
            earlier = [v for v in self.versions() if v < batch_id]
            if not earlier:
                raise ValueError(f"the version before batch {batch_id} is gone")
            self._open(earlier[-1])
        new, before, run = as_of(self.graph, log), self.state, uuid.uuid4().hex
        types, pairs = self._touched(log)
        nodes, edges = dict(self.record["nodes"]), dict(self.record["edges"])
        for t in sorted(types & set(self.base.schema.types)):
            nodes[t] = f"v{batch_id}/nodes-{t}-{run}"
            materialize(new.nodes(t), f"{self.path}/{nodes[t]}")
        for key in sorted(pairs):
            name = "/".join(key)
            edges[name] = f"v{batch_id}/edges-{'-'.join(key)}-{run}"
            materialize(new.edges(*key).pairs, f"{self.path}/{edges[name]}")
        window = self._window(self._graph(nodes, edges), batch_id)
        events = in_order(diff(before, self._read(window)))
        self.handler(events, batch_id)
        self._commit(batch_id, nodes, edges, window)
        self._clean()
        return events  # read from the windows of the last two versions

    def activate(self, stream: DataFrame, checkpoint: str | None = None, **trigger):
        """Follow a streaming frame of log rows; returns the StreamingQuery."""
        if self.immediate:
            nothing = self.state.limit(0)
            self.handler(in_order(diff(nothing, self.state)), START)

        def batch(rows: DataFrame, batch_id: int) -> None:
            self.apply(rows, batch_id)

        writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or f"{self.path}/checkpoint")
        self.stream = (writer.trigger(**trigger) if trigger else writer).start()
        return self.stream

    def unsubscribe(self) -> None:
        if self.stream is not None:
            self.stream.stop()
            self.stream = None


class Handlers:
    """One callback an event: a later `on` replaces the earlier."""

    def __init__(self):
        self.calls: dict[str, Callable] = {}

    def on(self, event: str, call: Callable) -> None:
        if event not in ("enter", "leave", "change", "move"):
            raise ValueError(f"unknown event {event!r}")
        self.calls[event] = call

    def off(self, event: str) -> None:
        self.calls.pop(event, None)

    def __call__(self, events: DataFrame, batch_id: int) -> None:
        """Calls run on the driver; events are as many as the viewport allows."""
        if self.calls:
            for row in events.where(F.col("event").isin(*self.calls)).toLocalIterator():
                self.calls[row["event"]](row)
