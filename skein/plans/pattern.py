"""Pattern compiler: a small directed pattern becomes a chain of equi-joins over the host's edge table.

The order of the pattern's edges is chosen here, with what the pattern's shape or the host's attribute frequencies tell; each
join binds at most one new vertex, so every step is an equi-join with filters for injectivity, or a semi-join for
an edge whose ends are bound. Induced matching adds anti-joins for the pattern's missing edges as soon as both ends are bound.
A pattern without attributes in which three vertices are joined starts from the host's list of such threes instead, so that no
path of two edges becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.graph.core import DiGraph
from skein.graph.property import PropGraph

#: A pattern is a query, not data; more edges than these are refused.
MAX_EDGES = 256


@dataclass
class Pattern:
    """A pattern's edges and attribute values, read from a graph object."""

    edges: list[tuple[int, int]]
    vertex_values: dict[int, dict] = field(default_factory=dict)
    edge_values: dict[tuple[int, int], dict] = field(default_factory=dict)
    vertex_types: dict[str, object] = field(default_factory=dict)
    edge_types: dict[str, object] = field(default_factory=dict)

    @classmethod
    def of(cls, graph: DiGraph) -> Pattern:
        rows = graph.edges().select("src", "dst").where("src <> dst").limit(MAX_EDGES + 1).collect()
        if len(rows) > MAX_EDGES:
            raise ValueError(f"a pattern has at most {MAX_EDGES} edges")
        if not rows:
            raise ValueError("the pattern has no edges")
        out = cls(sorted((r["src"], r["dst"]) for r in rows))
        if isinstance(graph, PropGraph):
            nodes, table = graph.get_node_attributes(), graph.get_edge_attributes()
            out.vertex_types = {f.name: f.dataType for f in nodes.schema if f.name != "id"}
            out.edge_types = {f.name: f.dataType for f in table.schema if f.name not in ("src", "dst")}
            if out.vertex_types:
                out.vertex_values = {r["id"]: r.asDict() for r in nodes.collect()}
            if out.edge_types:
                out.edge_values = {(r["src"], r["dst"]): r.asDict() for r in table.collect()}
        return out

    @property
    def vertices(self) -> list[int]:
        return sorted({v for e in self.edges for v in e})


def _comparable(own: dict[str, object], host: dict[str, object]) -> list[str] | None:
    """The attributes to compare; [] if none has to be, None if nothing can match."""
    if not own:
        return []
    both = [n for n, t in own.items() if host.get(n) == t]
    return both or None


def _equal(values: dict, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out &= F.col(n).eqNullSafe(F.lit(values.get(n)))
    return out


def join_order(edges: list[tuple[int, int]], cost: dict[int, float], bound: Iterable[int] = ()) -> list[tuple[int, int]]:
    """Edges in join order: from ``bound`` or the cheapest vertex on, edges that close a cycle first, then those to the cheapest vertex."""
    left = set(edges)
    bound = set(bound)
    out: list[tuple[int, int]] = []
    while left:
        closing = [e for e in left if e[0] in bound and e[1] in bound]
        touching = [e for e in left if e[0] in bound or e[1] in bound]
        if bound and not touching:
            raise ValueError("the pattern must be connected")
        key = lambda e: (min(cost[e[0]], cost[e[1]]) if not bound else sum(cost[v] for v in e if v not in bound), e)
        pick = min(closing or touching or left, key=key)
        left.discard(pick)
        out.append(pick)
        bound |= set(pick)
    return out


def _three(edges: list[tuple[int, int]], cost: dict[int, float]) -> tuple[int, ...] | None:
    """Three vertices that are joined each with each, those with the most edges first, then the cheapest."""
    joined = {frozenset(e) for e in edges}
    vertices = sorted({v for e in edges for v in e})
    found = [t for t in combinations(vertices, 3) if all(frozenset(p) in joined for p in combinations(t, 2))]
    return min(found, key=lambda t: (-sum(e[0] in t and e[1] in t for e in edges), sum(cost[v] for v in t), t), default=None)


def _placed(corners: DataFrame, three: tuple[int, ...], known: set[tuple[int, int]], induced: bool) -> DataFrame:
    """(v<id>…): every way to put the pattern's vertices ``three`` on three joined vertices of the host."""

    def there(a: str, b: str) -> Column:
        return F.col("".join(sorted((a, b)))).bitwiseAND(F.when(F.col(a) < F.col(b), 1).otherwise(2)) != 0

    ways = []
    for places in permutations("xyz"):
        at, fits = dict(zip(three, places, strict=True)), F.lit(True)
        for a, b in permutations(three, 2):
            if (a, b) in known:
                fits &= there(at[a], at[b])
            elif induced:
                fits &= ~there(at[a], at[b])
        ways.append(F.struct(fits.alias("fits"), *(F.col(at[v]).alias(f"v{v}") for v in three)))
    return corners.select(F.explode(F.filter(F.array(*ways), lambda w: w["fits"])).alias("w")).select(*(f"w.v{v}" for v in three))


def compile_pattern(host: DiGraph, pattern: Pattern, induced: bool, reorder_type: str = "structural") -> DataFrame:
    """One row per match; column ``v<id>`` is the host vertex of the pattern's vertex <id>."""
    if not host.directed:
        raise ValueError("the host must be a directed graph")
    if reorder_type not in ("structural", "probability", "None", None):
        raise ValueError(f"unknown reorder type {reorder_type!r}")
    own = isinstance(host, PropGraph)
    table = (host.get_edge_attributes() if own else host.edges().select("src", "dst")).where("src <> dst")
    nodes = host.get_node_attributes() if own else host.nodes()
    edge_names = _comparable(pattern.edge_types, {f.name: f.dataType for f in table.schema if f.name not in ("src", "dst")})
    vertex_names = _comparable(pattern.vertex_types, {f.name: f.dataType for f in nodes.schema if f.name != "id"})
    possible = edge_names is not None and vertex_names is not None
    edge_names, vertex_names = edge_names or [], vertex_names or []
    degree = {v: sum(v in e for e in pattern.edges) for v in pattern.vertices}
    cost: dict[int, float] = {v: -degree[v] for v in degree}
    if reorder_type == "probability" and vertex_names:
        # one aggregate over the nodes: how many could stand for each pattern vertex
        counts = nodes.agg(*(F.count_if(_equal(pattern.vertex_values.get(v, {}), vertex_names)).alias(f"n{v}") for v in degree)).first()
        cost = {v: counts[f"n{v}"] - degree[v] / (1 + len(degree)) for v in degree}
    elif reorder_type in ("None", None):
        cost = {v: float(v) for v in degree}
    plain = table.select("src", "dst")

    def candidates(e: tuple[int, int]) -> DataFrame:
        rows = table.where(_equal(pattern.edge_values.get(e, {}), edge_names)).select("src", "dst") if edge_names else plain
        for end, v in zip(("src", "dst"), e, strict=True):
            if vertex_names:
                fit = nodes.where(_equal(pattern.vertex_values.get(v, {}), vertex_names)).select(F.col("id").alias("_id"))
                rows = rows.join(fit, F.col(end) == F.col("_id"), "left_semi")
        return rows

    name = lambda v: f"v{v}"
    known = set(pattern.edges)
    bound: list[int] = []
    found: DataFrame | None = None

    def induce(rows: DataFrame, new: int) -> DataFrame:
        for old in bound:
            for a, b in ((new, old), (old, new)):
                if (a, b) not in known:
                    rows = rows.join(plain, (F.col(name(a)) == F.col("src")) & (F.col(name(b)) == F.col("dst")), "left_anti")
        return rows

    three = None if edge_names or vertex_names or not possible else _three(pattern.edges, cost)
    if three:
        found = _placed(host.corners, three, known, induced)
        bound += three
    for a, b in join_order([e for e in pattern.edges if not set(e) <= set(bound)], cost, bound):
        rows = candidates((a, b))
        if found is None:
            found = rows.select(F.col("src").alias(name(a)), F.col("dst").alias(name(b)))
            bound.append(a)
            found = induce(found, b) if induced else found
            bound.append(b)
            continue
        if a in bound and b in bound:
            found = found.join(rows, (F.col(name(a)) == F.col("src")) & (F.col(name(b)) == F.col("dst")), "left_semi")
            continue
        at, new, near, far = (a, b, "src", "dst") if a in bound else (b, a, "dst", "src")
        apart = F.col(near) == F.col(name(at))
        for v in bound:
            if v != at:
                apart &= F.col(far) != F.col(name(v))
        found = found.join(rows, apart).select(*(name(v) for v in bound), F.col(far).alias(name(new)))
        found = induce(found, new) if induced else found
        bound.append(new)
    return found.select(*(name(v) for v in pattern.vertices)) if possible else found.select(*(name(v) for v in pattern.vertices)).where(F.lit(False))
