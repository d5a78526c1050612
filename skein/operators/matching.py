"""Subgraph isomorphism (induced) and monomorphism."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from itertools import combinations, permutations
from threading import Timer
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.graph.core import DiGraph
from skein.plans.pattern import Pattern, compile_pattern
from skein.session import materialize

T = TypeVar("T")


def _within(spark: SparkSession, minutes: float | None, work: Callable[[], T]) -> T:
    """Run ``work``; its jobs are cancelled, and so fail, after ``minutes``."""
    if minutes is None:
        return work()
    tag, context = f"skein-{uuid.uuid4().hex}", spark.sparkContext
    context.addJobTag(tag)
    timer = Timer(minutes * 60, lambda: context.cancelJobsWithTag(tag))
    timer.start()
    try:
        return work()
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def _search(graph, subgraph, induced, size_limit, time_limit, return_isos_as, algorithm_type, reorder_type):
    if algorithm_type not in ("si", "ps"):
        raise ValueError(f"unknown algorithm type {algorithm_type!r}")
    if return_isos_as not in ("vertices", "edges", "complete", "count"):
        raise ValueError(f"unknown return shape {return_isos_as!r}")
    pattern = Pattern.of(subgraph)
    wide = compile_pattern(graph, pattern, induced, reorder_type)
    if size_limit is not None:
        wide = wide.limit(int(size_limit))
    spark = wide.sparkSession
    if return_isos_as == "count":
        return _within(spark, time_limit, wide.count)
    found = _within(spark, time_limit, lambda: materialize(wide.withColumn("match_id", F.monotonically_increasing_id()), "matches"))
    entry = lambda **k: F.struct(*(v.alias(n) for n, v in k.items()))
    per_vertex = F.explode(F.array(*(entry(h_vertex=F.lit(v).cast("long"), g_vertex=F.col(f"v{v}")) for v in pattern.vertices)))
    per_edge = F.explode(F.array(*(entry(h_src=F.lit(a).cast("long"), h_dst=F.lit(b).cast("long"), src=F.col(f"v{a}"), dst=F.col(f"v{b}")) for a, b in pattern.edges)))
    vertices = found.select("match_id", per_vertex.alias("m")).select("match_id", "m.*")
    edges = found.select("match_id", per_edge.alias("m")).select("match_id", "m.*")
    return {"vertices": vertices, "edges": edges, "complete": (vertices, edges)}[return_isos_as]


def subgraph_isomorphism(graph: DiGraph, subgraph: DiGraph, size_limit: int | None = None, time_limit: float | None = None, print_progress_interval: int | None = None, return_isos_as: str = "vertices", algorithm_type: str = "si", reorder_type: str = "structural"):
    """All injective maps of the pattern's vertices that keep its edges, its missing edges and its attributes.

    ``vertices``: (match_id, h_vertex, g_vertex); ``edges``: (match_id, h_src, h_dst, src, dst); ``complete``: both;
    ``count``: a number. Every automorphic image counts. Attributes that both graphs have with the same type must be equal;
    a pattern with attributes of which the host has none matches nothing. ``size_limit`` stops after exactly that many,
    ``time_limit`` is in minutes. Both algorithm types give the same matches; the reorder type only changes the join order.
    """
    return _search(graph, subgraph, True, size_limit, time_limit, return_isos_as, algorithm_type, reorder_type)


def subgraph_monomorphism(graph: DiGraph, subgraph: DiGraph, size_limit: int | None = None, time_limit: float | None = None, print_progress_interval: int | None = None, return_isos_as: str = "vertices", algorithm_type: str = "si", reorder_type: str = "structural"):
    """As ``subgraph_isomorphism``, but the host may have edges that the pattern lacks."""
    return _search(graph, subgraph, False, size_limit, time_limit, return_isos_as, algorithm_type, reorder_type)


def match_table(graph: DiGraph, subgraph: DiGraph, induced: bool = True, reorder_type: str = "structural") -> DataFrame:
    """The lazy wide form: one row per match, column ``v<id>`` per pattern vertex."""
    return compile_pattern(graph, Pattern.of(subgraph), induced, reorder_type)


def with_multiplicities(edge_matches: DataFrame, edges: DataFrame, attribute: str, multiplicities: Sequence[int]) -> DataFrame:
    """(match_id) of the matches whose edges, grouped by an attribute's value, have exactly these group sizes."""
    known = edge_matches.join(edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col(attribute).alias("_a")), (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")))
    sizes = known.groupBy("match_id", "_a").agg(F.count(F.lit(1)).cast("int").alias("n")).groupBy("match_id").agg(F.array_sort(F.collect_list("n")).alias("sizes"))
    return sizes.where(F.col("sizes") == F.array(*(F.lit(int(m)) for m in sorted(multiplicities)))).select("match_id")


def triads() -> dict[int, list[tuple[int, int]]]:
    """The thirteen directed patterns that join three vertices, each once up to renaming.

    A pattern's code has a bit for each ordered pair of its vertices, in the order of the pairs; of all renamings the one with the
    smallest code stands for the pattern.
    """
    pairs = list(permutations(range(3), 2))
    code = lambda edges: sum(1 << pairs.index(e) for e in edges)
    out = {}
    for k in range(2, 7):
        for edges in combinations(pairs, k):
            least = min(code([(p[a], p[b]) for a, b in edges]) for p in permutations(range(3)))
            if code(edges) == least and len({frozenset(e) for e in edges}) > 1:
                out[least] = list(edges)
    return out
