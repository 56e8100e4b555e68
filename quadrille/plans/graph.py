"""Operator graphs: JSON documents of nodes and edges, expanded to plans and pulled lazily."""

from __future__ import annotations

import copy
import hashlib
import json
import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from ..core import Refusal

OPERATORS: dict[str, Callable] = {}


def operator(key: str):
    """Registers a function as an operator; its first arguments are the wired inputs, the rest parameters."""

    def put(f: Callable) -> Callable:
        OPERATORS[key] = f
        return f

    return put


class Graph:
    """nodes: {id, op_key, params, modes}; edges: {src, dst, src_socket, dst_socket, kind}."""

    def __init__(self, nodes: list[dict] | None = None, edges: list[dict] | None = None):
        self.nodes = {n["id"]: {"params": {}, "modes": {}, **n} for n in nodes or []}
        self.edges = [{"src_socket": "out", "dst_socket": "data", "kind": "forward", **e} for e in edges or []]

    @classmethod
    def from_json(cls, text: str) -> Graph:
        d = json.loads(text)
        return cls(d.get("nodes"), d.get("edges"))

    def to_json(self) -> str:
        return json.dumps({"format": "2.0", "nodes": list(self.nodes.values()), "edges": self.edges}, indent=1)

    def add(self, id: str, op_key: str, after: str | list[str] | None = None, **params) -> Graph:
        self.nodes[id] = {"id": id, "op_key": op_key, "params": params, "modes": {}}
        for i, s in enumerate([after] if isinstance(after, str) else after or []):
            self.edges.append({"src": s, "dst": id, "src_socket": "out", "dst_socket": "data" if i == 0 else f"data_{i}", "kind": "forward"})
        return self

    def inputs(self, id: str) -> list[dict]:
        own = [e for e in self.edges if e["dst"] == id and e["kind"] == "forward"]
        seen: set[str] = set()
        for e in own:
            if e["dst_socket"] in seen:
                raise Refusal(f"two wires in the socket {e['dst_socket']} of {id}")
            seen.add(e["dst_socket"])
        return sorted(own, key=lambda e: (e["dst_socket"] != "data", e["dst_socket"]))

    def order(self, target: str) -> list[str]:
        """The nodes that a target needs, inputs first; a circle is refused."""
        out: list[str] = []
        state: dict[str, int] = {}

        def visit(n: str) -> None:
            if state.get(n) == 2:
                return
            if state.get(n) == 1:
                raise Refusal(f"the graph goes round in a circle at {n}")
            if n not in self.nodes:
                raise Refusal(f"no node {n}")
            state[n] = 1
            for e in self.inputs(n):
                visit(e["src"])
            state[n] = 2
            out.append(n)

        visit(target)
        return out

    def expand(self) -> Graph:
        """Groups and reroutes replaced by what they stand for.

        A node of op_key group.instance has a nested graph in params["graph"] with group.input and
        group.output nodes; its members get the instance's id as a prefix.
        """
        g = copy.deepcopy(self)
        while any(n["op_key"] == "group.instance" for n in g.nodes.values()):
            for id, node in list(g.nodes.items()):
                if node["op_key"] != "group.instance":
                    continue
                inner = Graph(node["params"]["graph"]["nodes"], node["params"]["graph"]["edges"])
                name = lambda x, id=id: f"{id}/{x}"
                for m in inner.nodes.values():
                    g.nodes[name(m["id"])] = {**m, "id": name(m["id"]), "op_key": "rr.reroute" if m["op_key"] in ("group.input", "group.output") else m["op_key"]}
                g.edges += [{**e, "src": name(e["src"]), "dst": name(e["dst"])} for e in inner.edges]
                start = next((n for n, m in inner.nodes.items() if m["op_key"] == "group.input"), None)
                end = next(n for n, m in inner.nodes.items() if m["op_key"] == "group.output")
                for e in g.edges:
                    if e["dst"] == id:
                        if start is None:
                            raise Refusal(f"the group {id} has no input")
                        e["dst"] = name(start)
                    if e["src"] == id:
                        e["src"] = name(end)
                del g.nodes[id]
        for id, node in list(g.nodes.items()):
            if node["op_key"] == "rr.reroute" or node.get("muted"):
                source = next((e["src"] for e in g.edges if e["dst"] == id and e["dst_socket"] == "data"), None)
                for e in g.edges:
                    if e["src"] == id:
                        if source is None:
                            raise Refusal(f"{id} has no input to pass on")
                        e["src"] = source
                g.edges = [e for e in g.edges if e["dst"] != id]
                del g.nodes[id]
        return g


#: Parameters that change a picture, not a result, and so don't count in a recipe.
PRESENTATION = frozenset({"title", "colormap", "opacity", "style", "color_range"})


class Engine:
    """Pulls nodes: builds only the cone a target needs, and keeps each recipe's lazy result.

    A recipe is the hash of operator, parameters and inputs' recipes, so that after a change only what
    depends on it is built again; a result that several nodes use may be persisted.
    """

    def __init__(self, graph: Graph, operators: dict[str, Callable] | None = None, persist_shared: bool = False):
        self.graph, self.operators, self.persist_shared = graph.expand(), operators or OPERATORS, persist_shared
        self.memo: dict[str, Any] = {}
        self.built = 0

    def recipe(self, id: str, cache: dict[str, str]) -> str:
        if id not in cache:
            n = self.graph.nodes[id]
            what = {k: v for k, v in {**n["params"], **n["modes"]}.items() if k not in PRESENTATION}
            up = [[e["dst_socket"], e["src_socket"], self.recipe(e["src"], cache)] for e in self.graph.inputs(id)]
            cache[id] = hashlib.sha256(json.dumps([n["op_key"], what, up], sort_keys=True, default=repr).encode()).hexdigest()
        return cache[id]

    def pull(self, id: str):
        cache: dict[str, str] = {}
        for n in self.graph.order(id):
            key = self.recipe(n, cache)
            if key in self.memo:
                continue
            node = self.graph.nodes[n]
            if node["op_key"] not in self.operators:
                raise Refusal(f"no operator {node['op_key']}")
            args = []
            for e in self.graph.inputs(n):
                v = self.memo[cache[e["src"]]]
                args.append(v[e["src_socket"]] if isinstance(v, dict) and e["src_socket"] in v else v)
            out = self.operators[node["op_key"]](*args, **node["params"], **node["modes"])
            users = sum(e["src"] == n for e in self.graph.edges)
            if self.persist_shared and users > 1 and isinstance(out, DataFrame):
                out = out.persist()
            self.memo[key] = out
            self.built += 1
        return self.memo[cache[id]]


def repeat(segment: Callable[[Any, int], Any], start: Any, times: int, checkpoint_every: int = 0):
    """Repeat zone: the segment applied `times` times; long chains cut by a checkpoint in the shared folder."""
    at = start
    for i in range(times):
        at = segment(at, i)
        if checkpoint_every and (i + 1) % checkpoint_every == 0 and isinstance(at, DataFrame):
            at = at.checkpoint()
    return at


def sweep(build: Callable[..., Any], combine: str = "grid", metric: Callable[[Any], float] | None = None, preserve: str = "best", direction: str = "max", **variables):
    """Runs a segment for parameter values (their grid, or zipped) and keeps the picked, first, last or best result."""
    import itertools

    names = list(variables)
    runs = list(itertools.product(*variables.values()) if combine == "grid" else zip(*variables.values()))
    if not runs:
        raise Refusal("nothing to run")
    results = [(dict(zip(names, r)), build(**dict(zip(names, r)))) for r in runs]
    if preserve == "first":
        return results[0]
    if preserve == "last":
        return results[-1]
    if metric is None:
        raise Refusal("the best result needs a metric")
    scored = [(metric(v), p, v) for p, v in results]
    scored = [s for s in scored if not math.isnan(s[0])]
    best = (max if direction == "max" else min)(scored, key=lambda s: s[0])
    return best[1], best[2]


def advance(history: list[tuple[float, float]], low: float, high: float, method: str = "golden", target: float = 0.0) -> float:
    """The next parameter to try, from what has been tried: golden section for a minimum, secant for a root."""
    ratio = (math.sqrt(5) - 1) / 2
    if method == "golden":
        a, b = low, high
        known = dict(history)
        for _ in range(200):
            x1, x2 = b - ratio * (b - a), a + ratio * (b - a)
            f1, f2 = (next((v for k, v in known.items() if abs(k - x) <= 1e-12 * max(1, abs(x))), None) for x in (x1, x2))
            if f1 is None:
                return x1
            if f2 is None:
                return x2
            a, b = (a, x2) if f1 < f2 else (x1, b)
        return (a + b) / 2
    if len(history) < 2:
        return [low, high][len(history)]
    (x0, f0), (x1, f1) = history[-2:]
    if f1 == f0:
        return (x0 + x1) / 2
    return min(max(x1 - (f1 - target) * (x1 - x0) / (f1 - f0), low), high)
