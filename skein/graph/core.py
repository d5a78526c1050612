"""Undirected and directed graphs.

A graph is an edge table (src, dst and, if weighted, weight) and the vertices that occur in it. External ids are keys
everywhere; ``vid``, the dense rank of an id, is made only for results that expose it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType

from skein.plans.ranking import dense_ids
from skein.plans.triangles import triangle_rows
from skein.session import materialize

_IDS = (ByteType, ShortType, IntegerType, LongType)
_WEIGHTS = (*_IDS, FloatType, DoubleType)
Column_ = DataFrame | Sequence[int]


def edge_table(src: Column_, dst: Sequence[int] | str | None = None, weight: Sequence | str | None = None) -> tuple[DataFrame, bool]:
    """(src, dst[, weight]) rows from a table and column names, or from sequences; and whether there are weights."""
    if isinstance(src, DataFrame):
        names = src.columns
        d = dst if isinstance(dst, str) else "dst"
        s = "src" if "src" in names else names[0]
        w = weight if isinstance(weight, str) else None
        rows = src.select(F.col(s).alias("src"), F.col(d).alias("dst"), *([F.col(w).alias("weight")] if w else []))
    else:
        spark = SparkSession.getActiveSession()
        if len(src) != len(dst) or (weight is not None and len(weight) != len(src)):
            raise ValueError("src, dst and weight must be of equal length")
        kind = "double" if weight is not None and any(isinstance(x, float) for x in weight) else "long"
        columns = [[int(x) for x in src], [int(x) for x in dst]]
        if weight is not None:
            columns.append([float(x) if kind == "double" else int(x) for x in weight])
        rows = spark.createDataFrame(list(zip(*columns, strict=True)), "src long, dst long" + (f", weight {kind}" if weight is not None else ""))
    for f in rows.schema:
        whole = isinstance(f.dataType, DecimalType) and f.dataType.scale == 0  # unsigned 64-bit ids come as these
        if not (isinstance(f.dataType, _WEIGHTS if f.name == "weight" else _IDS) or whole):
            raise TypeError(f"{f.name} must be {'numeric' if f.name == 'weight' else 'an integer'}, not {f.dataType.simpleString()}")
    rows = rows.withColumns({"src": F.col("src").cast("long"), "dst": F.col("dst").cast("long")})
    return rows, "weight" in rows.columns


def _collapsed(rows: DataFrame, weighted: bool) -> DataFrame:
    """One row per (src, dst); weights are summed over the copies, so they stay with their edges."""
    known = rows.where("src is not null and dst is not null").groupBy("src", "dst")
    return known.agg(F.sum("weight").alias("weight")) if weighted else known.agg(F.count(F.lit(1)).alias("_n")).drop("_n")


class Graph:
    """Undirected: the edge table holds both orientations of every edge."""

    directed = False

    def __init__(self) -> None:
        self.weighted = False
        self._edges: DataFrame | None = None
        self.multied = False

    def add_edges_from(self, src: Column_, dst: Sequence[int] | str | None = None, weight: Sequence | str | None = None, no_self_loops: bool = True, generate_reversed_arrays: bool = False) -> Graph:
        """Build the graph from edges: a DataFrame (columns src and dst, or the first and the one named ``dst``) or sequences.

        Edges are mirrored, copies collapsed with their weights summed over all of them, the mirrored ones included, and
        loops dropped unless ``no_self_loops`` is false. A vertex with no other edge than a dropped loop disappears.
        ``generate_reversed_arrays`` is accepted; both orientations are always there.
        """
        rows, self.weighted = edge_table(src, dst, weight)
        more = [F.col("weight")] if self.weighted else []
        both = rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *more))
        return self._set(_collapsed(both, self.weighted), no_self_loops)

    def _set(self, edges: DataFrame, no_self_loops: bool) -> Graph:
        self._edges = (edges.where("src <> dst") if no_self_loops else edges).persist()
        for name in ("n_vertices", "n_edges", "_loops", "_vertices", "_ranked", "corners"):
            self.__dict__.pop(name, None)
        return self

    @property
    def spark(self) -> SparkSession:
        return self._edges.sparkSession

    @property
    def symmetric(self) -> DataFrame:
        """All (src, dst) with src <> dst, in both orientations."""
        return self._edges.select("src", "dst").where("src <> dst")

    @property
    def oriented(self) -> DataFrame:
        """Every undirected edge once, src < dst, without loops."""
        return self.symmetric.where("src < dst")

    @cached_property
    def _vertices(self) -> DataFrame:
        return self._edges.select(F.col("src").alias("id")).distinct()

    @cached_property
    def _ranked(self) -> DataFrame:
        return dense_ids(self._vertices, "id").select("id", "vid").persist()

    def nodes(self) -> DataFrame:
        return self._vertices

    def ranked_nodes(self) -> DataFrame:
        """(id, vid): vid is the place of the id among all ids in ascending order, from 0."""
        return self._ranked

    def edges(self) -> DataFrame:
        """(src, dst[, weight]) rows; an undirected graph has both orientations."""
        return self._edges

    def _internal_edges(self) -> DataFrame:
        """The edges in dense ranks."""
        s, d = self.ranked_nodes().toDF("_s", "_sv"), self.ranked_nodes().toDF("_d", "_dv")
        kept = ["weight"] if self.weighted else []
        return self._edges.join(s, F.col("src") == F.col("_s")).join(d, F.col("dst") == F.col("_d")).select(F.col("_sv").alias("src"), F.col("_dv").alias("dst"), *kept)

    def has_reversed_arrays(self) -> bool:
        return True

    @cached_property
    def _loops(self) -> int:
        return self._edges.where("src = dst").count()

    @cached_property
    def n_vertices(self) -> int:
        return self.nodes().count()

    @cached_property
    def n_edges(self) -> int:
        return (self._edges.count() - self._loops) // 2 + self._loops

    def __len__(self) -> int:
        return self.n_vertices

    def size(self) -> int:
        return self.n_edges

    def degree(self) -> DataFrame:
        """(id, degree); a loop counts twice."""
        return self._edges.groupBy(F.col("src").alias("id")).agg((F.count(F.lit(1)) + F.count_if(F.col("src") == F.col("dst"))).alias("degree"))

    def density(self) -> float:
        n = self.n_vertices
        return 2 * self.n_edges / (n * (n - 1)) if n > 1 else 0.0

    def graph_query(self, component: str) -> DataFrame:
        """One stored array by name, keyed by vertex or edge; all in dense ranks."""
        edges = self._internal_edges()
        flip = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(["weight"] if self.weighted else []))
        reverse = component.endswith("R")
        table, name = (flip, component[:-1]) if reverse else (edges, component)
        if name in ("src", "dst"):
            return table.select("src", "dst", F.col(name).alias(component))
        if name == "e_weight" and self.weighted:
            return table.select("src", "dst", F.col("weight").alias(component))
        if name in ("neighbour", "start_i"):
            degree = table.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("_n"))
            full = self.ranked_nodes().select("vid").join(degree, "vid", "left").select("vid", F.coalesce("_n", F.lit(0)).alias("neighbour"))
            if name == "neighbour":
                return full.withColumnRenamed("neighbour", component)
            below = dense_ids(table.select("src", "dst"), "src", "dst", name="_at").groupBy(F.col("src").alias("vid")).agg(F.min("_at").alias(component))
            return full.select("vid").join(below, "vid", "left")  # null: no edge begins there
        raise ValueError(f"no component {component!r}")


class DiGraph(Graph):
    """Directed; copies of an edge are collapsed."""

    directed = True

    def add_edges_from(self, src: Column_, dst: Sequence[int] | str | None = None, weight: Sequence | str | None = None, no_self_loops: bool = True, generate_reversed_arrays: bool = False) -> DiGraph:
        if generate_reversed_arrays:
            raise ValueError("reversed arrays are for undirected graphs")
        rows, self.weighted = edge_table(src, dst, weight)
        return self._set(_collapsed(rows, self.weighted), no_self_loops)

    @property
    def symmetric(self) -> DataFrame:
        own = self._edges.select("src", "dst").where("src <> dst")
        return own.unionAll(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()

    @cached_property
    def _vertices(self) -> DataFrame:
        return self._edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()

    @cached_property
    def corners(self) -> DataFrame:
        """(x, y, z, xy, xz, yz): every three vertices that are joined whatever the direction, once, and how each two of them are:
        1 for an edge from the smaller id to the larger one, 2 for one back, 3 for both."""
        bit = F.when(F.col("src") < F.col("dst"), 1).otherwise(2).cast("byte")
        pairs = self._edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), bit.alias("bits"))
        return materialize(triangle_rows(pairs.groupBy("src", "dst").agg(F.bit_or("bits").alias("bits"))), "corners")

    @cached_property
    def n_edges(self) -> int:
        return self._edges.count()

    def _degrees(self, end: str, name: str) -> DataFrame:
        counted = self._edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("_n"))
        return self.nodes().join(counted, "id", "left").select("id", F.coalesce("_n", F.lit(0)).alias(name))

    def out_degree(self) -> DataFrame:
        return self._degrees("src", "out_degree")

    def in_degree(self) -> DataFrame:
        return self._degrees("dst", "in_degree")

    def degree(self) -> DataFrame:
        """(id, degree): edges in and out; one pass over the edges."""
        ends = self._edges.select(F.explode(F.array("src", "dst")).alias("id"))
        return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))

    def density(self) -> float:
        n = self.n_vertices
        return self.n_edges / (n * (n - 1)) if n > 1 else 0.0


def undirected_only(graph: Graph, what: str) -> None:
    if graph.directed:
        raise ValueError(f"{what} is for undirected graphs")
