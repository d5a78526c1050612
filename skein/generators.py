"""Graph generators. ``create_using`` is a graph class; random ones repeat for the same seed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.graph.core import Graph

# Zachary's karate club (1977): each member's friends with a higher number. Fixed values.
_KARATE = {
    0: (1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31), 1: (2, 3, 7, 13, 17, 19, 21, 30), 2: (3, 7, 8, 9, 13, 27, 28, 32),
    3: (7, 12, 13), 4: (6, 10), 5: (6, 10, 16), 6: (16,), 8: (30, 32, 33), 9: (33,), 13: (33,), 14: (32, 33), 15: (32, 33), 18: (32, 33),
    19: (33,), 20: (32, 33), 22: (32, 33), 23: (25, 27, 29, 32, 33), 24: (25, 27, 31), 25: (31,), 26: (29, 33), 27: (33,), 28: (31, 33),
    29: (32, 33), 30: (32, 33), 31: (32, 33), 32: (33,),
}


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _built(create_using: type[Graph], rows: DataFrame) -> Graph:
    return empty_graph(create_using).add_edges_from(rows)


def _seed(seed: int | None) -> int:
    return int(np.random.default_rng().integers(1 << 31)) if seed is None else seed


def empty_graph(create_using: type[Graph]) -> Graph:
    if not (isinstance(create_using, type) and issubclass(create_using, Graph)):
        raise ValueError("create_using must be a graph class")
    return create_using()


def complete_graph(n: int, create_using: type[Graph]) -> Graph:
    ids = _session().range(n)
    pairs = ids.select(F.col("id").alias("src")).crossJoin(ids.select(F.col("id").alias("dst")))
    return _built(create_using, pairs.where("src <> dst"))


def karate_club_graph(create_using: type[Graph]) -> Graph:
    rows = [(u, v) for u, vs in _KARATE.items() for v in vs]
    return _built(create_using, _session().createDataFrame(rows + [(v, u) for u, v in rows], "src long, dst long"))


def random_tree(n: int, create_using: type[Graph], seed: int | None = None) -> Graph:
    """Every vertex but 0 has a parent with a smaller id."""
    rows = _session().range(1, n)
    return _built(create_using, rows.select(F.col("id").alias("src"), F.floor(F.rand(_seed(seed)) * F.col("id")).cast("long").alias("dst")))


def path_graph(n: int, create_using: type[Graph]) -> Graph:
    return _built(create_using, _session().range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def _shuffled(x: Column, bits: int, seed: int) -> Column:
    """A seeded permutation of 0 … 2^bits - 1: odd multiplications and xor-shifts, each of which is one to one."""
    rng = np.random.default_rng(seed)
    mask = F.lit((1 << bits) - 1).cast("long")
    for _ in range(3):
        factor, more = int(rng.integers(1 << min(bits, 30))) | 1, int(rng.integers(1 << min(bits, 30)))
        x = (x * F.lit(factor) + F.lit(more)).bitwiseAND(mask)
        if bits > 1:
            x = x.bitwiseXOR(F.shiftrightunsigned(x, (bits + 1) // 2))
    return x


def rmat_edges(scale: int, edge_factor: int = 16, p: tuple[float, float, float, float] = (0.57, 0.19, 0.19, 0.05), seed: int | None = None) -> DataFrame:
    if len(p) != 4 or not math.isclose(sum(p), 1):
        raise ValueError("p must be four probabilities that sum to 1")
    if scale < 1 or scale > 31:
        raise ValueError("scale must be from 1 to 31")
    a, b, c, _ = p
    seed = _seed(seed)
    src = dst = F.lit(0).cast("long")
    rows = _session().range(edge_factor << scale)
    for bit in range(scale):
        # in one projection a column named once is one draw; both uses below must see the same number
        rows = rows.withColumn(f"_r{bit}", F.rand(seed + 2 * bit)).withColumn(f"_q{bit}", F.rand(seed + 2 * bit + 1))
        down = F.col(f"_r{bit}") > a + b
        right = F.col(f"_q{bit}") > F.when(down, c / (1 - (a + b)) if a + b < 1 else 1.0).otherwise(a / (a + b) if a + b else 1.0)
        src, dst = src + (down.cast("long") * (1 << bit)), dst + (right.cast("long") * (1 << bit))
    return rows.select(_shuffled(src, scale, seed).alias("src"), _shuffled(dst, scale, seed).alias("dst"))


def rmat_graph(scale: int, create_using: type[Graph], edge_factor: int = 16, p: tuple[float, float, float, float] = (0.57, 0.19, 0.19, 0.05), seed: int | None = None) -> Graph:
    """Recursive-matrix graph over 2^scale vertices, from edge_factor draws a vertex; ids are permuted by the seed."""
    return _built(create_using, rmat_edges(scale, edge_factor, p, seed))


def rmat_gen(lg_vertices: int, edges_per_vertex: int, p: float = 0.4, create_using: type[Graph] = Graph, seed: int | None = None) -> Graph:
    """One-parameter form: probability p for the first quadrant, the rest shared equally."""
    rest = (1 - p) / 3
    return rmat_graph(lg_vertices, create_using, edges_per_vertex, (p, rest, rest, 1 - p - 2 * rest), seed)


def gnp_random_graph(n: int, p: float, create_using: type[Graph], seed: int | None = None, each_pair_once: bool = False) -> Graph:
    """Each ordered pair is drawn with probability p, so an undirected edge is there with 1 - (1 - p)^2.

    With ``each_pair_once`` only pairs u < v are drawn: the usual G(n, p) for undirected graphs.
    """
    if not 0 < p < 1:
        raise ValueError("p must be between 0 and 1")
    seed = _seed(seed)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The targets of each vertex, by geometric gaps from one to the next: work in proportion to the edges."""
        for batch in it:
            for src in batch.column(0).to_pylist():
                rng, at = np.random.default_rng((seed, src)), src if each_pair_once else -1
                while at < n - 1:
                    found = at + np.cumsum(rng.geometric(p, min(int((n - at) * p) + 16, 1 << 20)))
                    at = int(found[-1])
                    found = found[(found < n) & (found != src)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), src)), pa.array(found)], ["src", "dst"])

    return _built(create_using, _session().range(n).mapInArrow(run, "src long, dst long"))


def gnm_edges(n: int, m: int, seed: int | None = None) -> DataFrame:
    """m random pairs."""
    seed = _seed(seed)
    draw = lambda s: F.floor(F.rand(s) * n).cast("long")
    return _session().range(m).select(draw(seed).alias("src"), draw(seed + 1).alias("dst"))


def watts_strogatz_graph(n: int, k: int, p: float, create_using: type[Graph], seed: int | None = None) -> Graph:
    """A ring where each vertex is joined to the next k // 2; each target is replaced by a random vertex with probability p."""
    if k > n:
        raise ValueError("k must not exceed n")
    seed = _seed(seed)
    ring = _session().range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(max(1, k // 2)))).alias("j"))
    ring = ring.where(F.col("j") <= k // 2)
    drawn = ring.select("src", ((F.col("src") + F.col("j")) % n).alias("near"), F.rand(seed).alias("u"), F.floor(F.rand(seed + 1) * n).cast("long").alias("far"))
    rows = drawn.select("src", F.when(F.col("u") < p, F.col("far")).otherwise(F.col("near")).alias("dst"))
    rows = rows.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")) if create_using.directed else rows
    return _built(create_using, rows.select("e.src", "e.dst") if create_using.directed else rows)


def barabasi_albert_graph(n: int, m: int, create_using: type[Graph], seed: int | None = None) -> Graph:
    """Preferential attachment: a star of m leaves, then m picks a vertex from the endpoints so far.

    The endpoints stand in one list, two an edge. A pick is a place in it, by a hash of the edge's number; the place of another pick
    is looked up by the same hash, so every edge is found on its own, and nothing is drawn in sequence.
    """
    if m < 1 or m >= n:
        raise ValueError("m must be at least 1 and below n")
    seed = _seed(seed)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            edge = batch.column(0).to_numpy()
            out = np.full(len(edge), -1)
            number = edge.copy()
            while (open_ := np.flatnonzero(out < 0)).size:
                i = number[open_]
                place = np.where(i < m, 0, _mixed(i, seed) % np.maximum(1, 2 * m * (i // m)).astype(np.uint64)).astype(np.int64)
                number[open_] = place // 2
                out[open_] = np.where(i < m, i, np.where(place % 2 == 0, m + place // 2 // m, -1))
            yield pa.RecordBatch.from_arrays([pa.array(m + edge // m), pa.array(out)], ["src", "dst"])

    return _built(create_using, _session().range(m * (n - m)).mapInArrow(run, "src long, dst long"))


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits for each number."""
    x = (x.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))
