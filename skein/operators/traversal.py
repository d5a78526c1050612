"""Breadth-first layers, components and diameter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.graph.core import Graph, undirected_only
from skein.plans.components import star_components
from skein.plans.ranking import dense_ids
from skein.session import discard, materialize

#: Levels that are kept as tables of their own before they are written together.
_COMPACT = 8
#: Vertices that a round of bounding searches from at either end, at least; rows of distances that a round writes, about, unless so few searches make more.
_BATCH, _REACHED = 4, 20_000_000
#: Components up to this size are searched as rows. Rounds of bounding, and the largest distance that these may have found, before the vertices
#: that are left are searched as bits, if a task can hold the edges (both ways, 4 bytes each) of all large components.
_TINY, _ROUNDS, _SHALLOW, _HELD = 64, 2, 64, 150_000_000
#: 64-bit words of roots that are searched at once; words that a step gathers at once.
_WORDS, _GATHERED = 16, 1 << 24


def _levels(edges: DataFrame, seeds: DataFrame, keys: list[str], symmetric: bool) -> DataFrame:
    """(keys…, v, depth) reached from ``seeds`` (keys…, v) along ``edges`` (src, dst); each key is a search of its own.

    A round joins the frontier with the edges, drops what earlier rounds have reached and writes the rest. If every edge
    is there both ways, only the last two levels can be reached again, so a round's work follows its frontier.
    """
    edges = materialize(edges.select("src", "dst"), "bfs-edges")
    parts = [materialize(seeds.distinct().withColumn("depth", F.lit(0)), "level")]
    depth = 0
    while not parts[-1].isEmpty():
        depth += 1
        step = parts[-1].drop("depth").join(edges, F.col("v") == F.col("src")).select(*keys, F.col("dst").alias("v")).distinct()
        seen = _union(parts[-2:] if symmetric else parts)
        parts.append(materialize(step.join(seen.select(*keys, "v"), [*keys, "v"], "left_anti").withColumn("depth", F.lit(depth)), "level"))
        if len(parts) > _COMPACT + 2:
            old, parts = parts[:-2], [materialize(_union(parts[:-2]), "levels"), *parts[-2:]]
            discard(*old)
    discard(edges)
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def bfs_layers(graph: Graph, source: int) -> DataFrame:
    """(id, depth): hops from ``source`` along the edges' direction; -1 if it can't be reached."""
    seeds = graph.nodes().where(F.col("id") == source).select(F.col("id").alias("v"))
    if seeds.isEmpty():
        raise ValueError("Source vertex not found in graph.")
    reached = _levels(graph.edges(), seeds, [], not graph.directed)
    return graph.nodes().join(reached, F.col("id") == F.col("v"), "left").select("id", F.coalesce("depth", F.lit(-1)).alias("depth"))


def component_ids(graph: Graph) -> DataFrame:
    """(id, component_id): the smallest id that can be reached, itself included."""
    undirected_only(graph, "components")
    found = star_components(graph.oriented, "src", "dst")
    return graph.nodes().join(found.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("id", F.coalesce("component", "id").alias("component_id"))


def connected_components(graph: Graph) -> DataFrame:
    """(id, component_id, label): label is the dense rank of the component's smallest id."""
    ranks = graph.ranked_nodes().select(F.col("id").alias("_root"), F.col("vid").alias("label"))
    return component_ids(graph).join(ranks, F.col("component_id") == F.col("_root")).select("id", "component_id", "label")


def count_components(graph: Graph) -> int:
    return component_ids(graph).where("id = component_id").count()


@dataclass(frozen=True)
class Diameter:
    value: int
    exact: bool


def farthest(starts: np.ndarray, near: np.ndarray, part: np.ndarray, roots: np.ndarray) -> int:
    """The largest distance from any of ``roots``, in a graph whose vertex v has the neighbours near[starts[v]:starts[v + 1]].

    Bit b of a vertex says that root b has reached it. A round takes each vertex's neighbours' bits; a vertex that all roots of
    its component (``part``, a number from 0) have reached is done, so a search ends with the last vertex that is reached.
    """
    most, sizes = 0, np.diff(starts)
    for at in range(0, len(roots), 64 * _WORDS):
        block = roots[at : at + 64 * _WORDS]
        bits = np.zeros((len(sizes), -(-len(block) // 64)), dtype=np.uint64)
        word, bit = np.divmod(np.arange(len(block)), 64)
        bits[block, word] = np.uint64(1) << bit.astype(np.uint64)
        every = np.zeros((int(part.max()) + 1, bits.shape[1]), dtype=np.uint64)
        np.bitwise_or.at(every, (part[block], word), np.uint64(1) << bit.astype(np.uint64))
        depth = 0
        while len(todo := np.flatnonzero((bits != every[part]).any(axis=1) & (sizes > 0))):
            # as many vertices at a time as make _GATHERED words of neighbours, one at least
            ends = np.cumsum(sizes[todo])
            cuts = np.searchsorted(ends, np.arange(1, 1 + -(-ends[-1] * bits.shape[1] // _GATHERED)) * (_GATHERED // bits.shape[1]))
            new = bits[todo]
            for own in np.split(np.arange(len(todo)), np.unique(cuts[(cuts > 0) & (cuts < len(todo))])):
                n = sizes[todo[own]]
                first = np.cumsum(n) - n
                places = np.repeat(starts[todo[own]] - first, n) + np.arange(n.sum())
                new[own] |= np.bitwise_or.reduceat(bits[near[places]], first, axis=0)
            if np.array_equal(new, bits[todo]):
                break
            bits[todo] = new
            depth += 1
        most = max(most, depth)
    return most


def _within_components(edges: DataFrame, vertices: DataFrame) -> int:
    """The largest distance within the components of ``vertices`` (component_id, n, id), each in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, src = np.unique(rows["src"].to_numpy(), return_inverse=True)
        order = np.argsort(src, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(ids)))])
        near = np.searchsorted(ids, rows["dst"].to_numpy()[order])
        return pd.DataFrame({"ecc": [farthest(starts, near, np.zeros(len(ids), dtype=int), np.arange(len(ids)))]})

    own = vertices.select("component_id", F.col("id").alias("src")).join(edges, "src")
    return own.groupBy("component_id").applyInPandas(run, "ecc long").agg(F.max("ecc")).first()[0] or 0


def _searched(edges: DataFrame, vertices: DataFrame, roots: DataFrame) -> int:
    """The largest distance from any of ``roots`` (w), in the components of ``vertices`` (component_id, id).

    The roots are dealt out to the tasks; each holds all neighbour lists, 4 bytes an end of an edge.
    """
    ids = dense_ids(vertices.select("component_id", "id"), "component_id", "id", name="v").withColumn("v", F.col("v").cast("int"))
    ids = materialize(ids, "numbered")
    own, other = ids.select(F.col("id").alias("src"), F.col("v").alias("s")), ids.select(F.col("id").alias("dst"), F.col("v").alias("d"))
    near = edges.join(own, "src").join(other, "dst").groupBy("s").agg(F.collect_list("d").alias("near"))
    rows = ids.join(near, F.col("v") == F.col("s")).join(roots.select("w", F.lit(True).alias("root")), F.col("id") == F.col("w"), "left")
    rows = materialize(rows.select("component_id", "v", F.coalesce("root", F.lit(False)).alias("root"), "near"), "near")
    tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-roots.count() // (64 * _WORDS))))
    # rows of one number go to one task; its number goes along
    dealt = rows.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for b in batches:
            for task in pa.compute.unique(b["task"]).to_pylist():
                x = b.filter(pa.compute.equal(b["task"], task))
                lists = x["near"]
                held.setdefault(task, []).append((x["v"].to_numpy(), x["component_id"].to_numpy(), x["root"].to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(), lists.flatten().to_numpy()))
        for task, parts in held.items():
            v, component, root, sizes, near = (np.concatenate(c) for c in zip(*parts, strict=True))
            parts.clear()
            row = np.empty(len(v), dtype=np.int32)  # the numbers are dense: where each vertex's list is
            row[v] = np.arange(len(v), dtype=np.int32)
            starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            chosen = np.flatnonzero(root)
            chosen = chosen[np.argsort(v[chosen])]  # by component, so that a block has few of them
            yield pa.RecordBatch.from_pydict({"ecc": pa.array([farthest(starts, row[near], np.unique(component, return_inverse=True)[1], chosen[task::tasks])], pa.int64())})

    found = dealt.mapInArrow(run, "ecc long").agg(F.max("ecc")).first()[0] or 0
    discard(ids, rows)
    return found


def _bounded(edges: DataFrame, vertices: DataFrame, least: int) -> int:
    """The largest eccentricity of ``vertices`` (component_id, n, id), whole components, or ``least`` if that is larger.

    A search from x bounds the eccentricity of every v at distance d between max(d, ecc(x) - d) and ecc(x) + d. Vertices
    whose upper bound is not above the largest distance found are done. Of the others, those with the largest upper and
    those with the smallest lower bound are searched next, twice as many each round, until none is left. Where distances are short
    and much alike, bounds leave most vertices; these are then searched as bits.
    """
    size = vertices.count()
    held, rounds = None, 0
    left = materialize(vertices.select("component_id", F.col("id").alias("w"), F.lit(0).alias("low"), (F.col("n") - 1).cast("int").alias("high")), "bounds")
    roots = vertices.where("id = component_id").select(F.col("id").alias("v"))
    batch = _BATCH
    while True:
        reached = materialize(_levels(edges, materialize(roots.select(F.col("v").alias("root"), "v"), "roots"), ["root"], True), "reached")
        far = materialize(reached.groupBy(F.col("root").alias("x")).agg(F.max("depth").alias("ecc")), "far")
        least = max(least, far.agg(F.max("ecc")).first()[0] or 0)
        low, high = F.max(F.greatest(F.col("depth"), F.col("ecc") - F.col("depth"))), F.min(F.col("ecc") + F.col("depth"))
        told = reached.join(far, F.col("root") == F.col("x")).groupBy("v").agg(low.alias("l"), high.alias("h"))
        # vertices that were searched have equal bounds, so they are never left
        new = left.join(told, F.col("w") == F.col("v"), "left").select("component_id", "w", F.greatest("low", "l").alias("low"), F.least("high", "h").alias("high"))
        new = materialize(new.where(F.col("high") > least), "bounds")
        discard(left, reached, far)
        left = new
        if left.isEmpty():
            return least
        rounds += 1
        if rounds >= _ROUNDS and least <= _SHALLOW:
            held = edges.join(vertices.select(F.col("id").alias("src")), "src", "left_semi").count() if held is None else held
            if held <= _HELD:
                return max(least, _searched(edges, vertices, left.select("w")))
        outer, inner = left.orderBy(F.desc("high"), "w").limit(batch), left.orderBy("low", "w").limit(batch)
        roots = outer.unionAll(inner).select(F.col("w").alias("v")).distinct()
        batch = max(_BATCH, min(2 * batch, _REACHED // size))


def diameter_of(graph: Graph, exact_limit: int = 2500) -> Diameter:
    """The largest distance within any component, exactly.

    Components of up to ``exact_limit`` vertices are searched from every vertex, all at once. Larger ones are searched
    from chosen vertices until no other can be farther from any, or else from all that are left.
    """
    undirected_only(graph, "the diameter")
    found = materialize(component_ids(graph), "components")
    sizes = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"))
    sized = materialize(found.join(sizes, "component_id"), "sized")
    tiny, large = F.col("n") <= min(_TINY, exact_limit), F.col("n") > exact_limit
    edges, value = graph.symmetric, 0
    small, middle, big = sized.where(tiny).select(F.col("id").alias("root"), F.col("id").alias("v")), sized.where(~tiny & ~large), sized.where(large)
    if not small.isEmpty():
        value = _levels(edges, small, ["root"], True).agg(F.max("depth")).first()[0] or 0
    if not middle.isEmpty():
        value = max(value, _within_components(edges, middle))
    return Diameter(value if big.isEmpty() else _bounded(edges, big, value), True)


def diameter(graph: Graph, exact_limit: int = 2500, reference_compatible: bool = False) -> int:
    """The diameter; with ``reference_compatible`` one less, and 0 if it is at most 2."""
    value = diameter_of(graph, exact_limit).value
    return (value - 1 if value > 2 else 0) if reference_compatible else value
