"""Well-connected components: clusters cut until every part's minimum cut is above a criterion."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.graph.core import Graph, undirected_only
from skein.plans.ranking import dense_ids
from skein.session import materialize
from skein.sources.files import write_clusters

Adjacency = dict[int, set[int]]
#: Parts of more vertices are first reduced to what a result may hold, then cut by any smallest cut; up to this, equal cuts are told apart.
_EXACT = 300


def criterion(name: str, n: int, factor: float | None = None) -> int:
    """The cut that a cluster of n vertices has to exceed."""
    if name == "log10":
        return math.floor(math.log10(n))
    if name == "log2":
        return math.floor(math.log2(n))
    if name == "sqrt":
        return math.floor(math.sqrt(n) / 5)
    if name == "mult":
        return math.floor((factor or 0.0) * n)
    raise ValueError(f"unknown criterion {name!r}")


def min_cut(adjacency: Adjacency) -> tuple[int, set[int]]:
    """A global minimum cut of a connected graph by maximum-adjacency phases: its size and one side.

    Of equal cuts the most balanced one that the phases meet is taken, then the first.
    """
    weights: dict[int, dict[int, int]] = {v: dict.fromkeys(ns, 1) for v, ns in adjacency.items()}
    merged = {v: {v} for v in adjacency}
    best: tuple[int, int, set[int]] | None = None
    n = len(adjacency)
    while len(weights) > 1:
        start = min(weights)
        keys = dict.fromkeys(weights, 0)
        heap = [(0, start)]
        order: list[int] = []
        done: set[int] = set()
        last = 0
        rest = sorted(weights)
        while len(order) < len(weights):
            while heap and (heap[0][1] in done or -heap[0][0] != keys[heap[0][1]]):
                heapq.heappop(heap)
            v = heapq.heappop(heap)[1] if heap else next(x for x in rest if x not in done)
            done.add(v)
            order.append(v)
            last = keys[v]
            for u, w in weights[v].items():
                if u not in done:
                    keys[u] += w
                    heapq.heappush(heap, (-keys[u], u))
        t, s = order[-1], order[-2]
        side = merged[t]
        found = (last, abs(n - 2 * len(side)), side)
        if best is None or found[:2] < best[:2]:
            best = (*found[:2], set(side))
        merged[s] = merged[s] | merged.pop(t)
        for u, w in weights.pop(t).items():
            del weights[u][t]
            if u != s:
                weights[s][u] = weights[s].get(u, 0) + w
                weights[u][s] = weights[u].get(s, 0) + w
    return best[0], best[2]


def _low_cut(adjacency: Adjacency, k: int) -> set[int] | None:
    """One side of a cut of fewer than ``k`` edges, or None if there is none, of a connected graph.

    An edge that a scan by largest adjacency meets with label k or more has ends that no such cut parts, so its ends are merged; a merged
    vertex of fewer than ``k`` edges is a side. Each scan merges something or finds a side.
    """
    weights: dict[int, dict[int, int]] = {v: dict.fromkeys(ns, 1) for v, ns in adjacency.items()}
    merged = {v: [v] for v in adjacency}
    while len(weights) > 1:
        for v, w in weights.items():
            if sum(w.values()) < k:
                return set(merged[v])
        start = min(weights)
        keys, done, heap = {start: 0}, set(), [(0, start)]
        root = {v: v for v in weights}

        def find(v: int) -> int:
            while root[v] != v:  # noqa: B023
                root[v] = root[root[v]]  # noqa: B023
                v = root[v]
            return v

        while heap:
            key, v = heapq.heappop(heap)
            if v in done or -key != keys[v]:
                continue
            done.add(v)
            for u, w in weights[v].items():
                if u not in done:
                    keys[u] = keys.get(u, 0) + w
                    if keys[u] >= k:
                        root[find(u)] = find(v)
                    heapq.heappush(heap, (-keys[u], u))
        after: dict[int, dict[int, int]] = {}
        into: dict[int, list[int]] = {}
        for v, w in weights.items():
            a = find(v)
            own = after.setdefault(a, {})
            into.setdefault(a, []).extend(merged[v])
            for u, x in w.items():
                if (b := find(u)) != a:
                    own[b] = own.get(b, 0) + x
        weights, merged = after, into
    return None


def _core(adjacency: Adjacency, k: int) -> Adjacency:
    """What is left when vertices with fewer than ``k`` neighbours are taken away, one after the other."""
    left = {v: set(ns) for v, ns in adjacency.items()}
    todo = [v for v, ns in left.items() if len(ns) < k]
    while todo:
        v = todo.pop()
        for u in left.pop(v, ()):
            left[u].discard(v)
            if len(left[u]) == k - 1:
                todo.append(u)
    return left


def _joined(adjacency: Adjacency, k: int, least: int) -> list[set[int]]:
    """The largest parts, of ``least`` vertices or more, that no cut of fewer than ``k`` edges parts; they don't depend on the order of cuts."""
    out, todo = [], _components(_core(adjacency, k))
    while todo:
        part = todo.pop()
        if len(part) < least:
            continue
        own = _within(adjacency, part)
        side = _low_cut(own, k)
        if side is None:
            out.append(part)
        else:
            for half in (side, part - side):
                todo += _components(_core(_within(own, half), k))
    return out


def _possible(adjacency: Adjacency, name: str, factor: float | None, least: int) -> set[int]:
    """The vertices that a well-connected part of ``least`` vertices or more may have; every such part lies among them.

    A part of n vertices, its cut above the criterion c(n), has more than c(n) neighbours at each vertex. Sizes are taken in ranges of one
    c. In a range up to m, the vertices within two steps of v are m at most, so v has as many repeats among the ends of its paths of two
    edges as make up for the excess: 1 + k + k (k - 1) - m, with k = c + 1. Vertices with fewer are taken away, one round after the other.
    """
    out: set[int] = set()
    size, n = least, len(adjacency)
    while size <= n:
        c = criterion(name, size, factor)
        low, high = size, n  # the largest size with this c
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if criterion(name, middle, factor) == c else (low, middle - 1)
        k = c + 1
        left = _core(adjacency, k)
        if not left:
            break  # nor has any larger k a core
        excess = 1 + k * k - low
        while left and excess > 0:
            weak = [v for v in left if _repeats(left, v, excess) < excess]
            if not weak:
                break
            for v in weak:
                for u in left.pop(v):
                    if u in left:
                        left[u].discard(v)
            left = _core(left, k)
        out.update(*(p for p in _components(left) if len(p) >= size))
        size = low + 1
    return out


def _repeats(adjacency: Adjacency, v: int, enough: int) -> int:
    """How many ends of paths of two edges from v, itself left out, are its neighbours or ends of other such paths; counted up to ``enough``."""
    seen, n = {v} | adjacency[v], 0
    for u in adjacency[v]:
        for w in adjacency[u]:
            if w != v:
                if w in seen:
                    n += 1
                    if n >= enough:
                        return n
                seen.add(w)
    return n


def _components(adjacency: Adjacency) -> list[set[int]]:
    seen: set[int] = set()
    out = []
    for v in sorted(adjacency):
        if v not in seen:
            part, todo = set(), [v]
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += adjacency[x] - part
            seen |= part
            out.append(part)
    return out


def _within(adjacency: Adjacency, part: set[int]) -> Adjacency:
    return {v: adjacency[v] & part for v in part}


def split(adjacency: Adjacency, name: str, factor: float | None, pre: int, post: int) -> list[set[int]]:
    """The well-connected parts of one cluster's induced graph.

    Parts that can't hold a result are dropped before they are cut: cutting them to the end yields nothing.
    """
    done: list[set[int]] = []
    least = min(pre, post) + 1
    # cuts below this part every cluster, whatever its size and the order of cuts
    sure = criterion(name, least, factor) + 1
    todo = []
    for p in _components(adjacency):
        if len(p) > pre:
            own = _within(adjacency, p)
            todo += [p if len(q) == len(p) else q for q in _joined(own, sure, least) if len(q) == len(p) or len(q) > post]
    while todo:
        part = todo.pop()
        own = _within(adjacency, part)
        bound = criterion(name, len(part), factor)
        if len(part) == 1 or not any(own.values()):
            continue
        if _low_cut(own, bound + 1) is None:
            done.append(part)
            continue
        kept = _possible(own, name, factor, least)
        if not kept:
            continue
        if len(part) > _EXACT:
            # only what can be in a result is cut, and by any smallest cut
            halves = _components(_within(own, kept))
            if len(halves) == 1 and len(kept) == len(part):
                side = next(s for k in range(sure, bound + 2) if (s := _low_cut(own, k)) is not None)
                halves = [side, part - side]
        else:
            lone = min((v for v in part if len(own[v]) == 1), default=None)
            side = {lone} if lone is not None else min_cut(own)[1]
            halves = [side, part - side]
        for half in halves:
            inner = _within(own, half)
            if len(half) > post and any(inner.values()):
                todo.append(half)
    return done


def well_connected_clusters(graph: Graph, clusters: DataFrame, connectedness_criterion: str = "log10", connectedness_criterion_mult_value: float | None = None, pre_filter_min_size: int = 10, post_filter_min_size: int = 10) -> DataFrame:
    """(id, cluster): the parts of ``clusters`` (id, cluster) whose minimum cut exceeds the criterion, numbered from 0.

    Clusters are cut side by side, each in one task: a minimum cut needs its cluster's whole graph, a few dozen bytes
    an edge. Vertices that the graph lacks and clusters without inner edges are left out.
    """
    undirected_only(graph, "well-connected components")
    criterion(connectedness_criterion, 10, connectedness_criterion_mult_value)
    member = materialize(clusters.select(F.col("id").cast("long").alias("id"), "cluster").distinct().join(graph.nodes(), "id", "left_semi"), "members")
    s, d = member.toDF("_s", "cluster"), member.toDF("_d", "_c")
    inner = graph.oriented.join(s, F.col("src") == F.col("_s")).join(d, (F.col("dst") == F.col("_d")) & (F.col("cluster") == F.col("_c"))).select("cluster", "src", "dst")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        adjacency: Adjacency = defaultdict(set)
        for a, b in zip(rows["src"].tolist(), rows["dst"].tolist(), strict=True):
            adjacency[a].add(b)
            adjacency[b].add(a)
        parts = split(dict(adjacency), connectedness_criterion, connectedness_criterion_mult_value, pre_filter_min_size, post_filter_min_size)
        return pd.DataFrame([(v, min(p), str(key[0])) for p in parts for v in p], columns=["id", "least", "of"])

    cut = materialize(inner.groupBy("cluster").applyInPandas(run, "id long, least long, of string"), "parts")
    names = dense_ids(cut.select("of", "least").distinct(), "of", "least", name="cluster")
    return cut.join(names, ["of", "least"]).select("id", "cluster")


def well_connected_components(graph: Graph, clusters: DataFrame | str, output_folder_path: str | None = None, output_filename: str | None = None, connectedness_criterion: str = "log10", connectedness_criterion_mult_value: float | None = None, pre_filter_min_size: int = 10, post_filter_min_size: int = 10) -> int:
    """Cut the clusters (a table or a file of "vertex cluster" lines), write "vertex cluster" lines, return how many."""
    from skein.sources.files import read_clusters

    given = read_clusters(graph.spark, clusters) if isinstance(clusters, str) else clusters
    found = materialize(well_connected_clusters(graph, given, connectedness_criterion, connectedness_criterion_mult_value, pre_filter_min_size, post_filter_min_size), "wcc")
    if output_folder_path:
        write_clusters(found, f"{output_folder_path.rstrip('/')}/{output_filename or f'wcc_{connectedness_criterion}'}")
    return found.select("cluster").distinct().count()
