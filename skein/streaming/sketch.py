"""Triangle estimates from fixed-size sketches of a finite edge stream.

Line i of the stream goes to slot i mod (edges / factor); later lines overwrite earlier ones. Ids are taken modulo
(vertices / factor); an edge whose ends fall together goes to the next vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.graph.core import Graph
from skein.operators.cohesion import count_triangles
from skein.plans.ranking import dense_ids

# Weights of the three sorted counts by case; case 0 is the plain sum. Fixed values.
_CASES = {0: (1.0, 1.0, 1.0), 1: (-7.835, 6.887, 3.961), 2: (3.697, -2.236, -1.737)}


def read_stream(path: str) -> DataFrame:
    """(line, src, dst) of an edge file, lines numbered from 0."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    lines = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f"), F.monotonically_increasing_id().alias("at")).where(F.size("f") >= 2)
    numbered = dense_ids(lines.select("at", F.get("f", F.lit(0)).try_cast("long").alias("src"), F.get("f", F.lit(1)).try_cast("long").alias("dst")), "at", name="line")
    return numbered.select("line", "src", "dst")


def sketch(stream: DataFrame, slots: int, vertices: int) -> DataFrame:
    """(slot, src, dst): what a sketch of ``slots`` edges over ``vertices`` ids holds after the stream of (line, src, dst)."""
    if slots < 1 or vertices < 2:
        raise ValueError("a sketch needs at least one slot and two vertices")
    hashed = stream.select("line", (F.col("line") % slots).alias("slot"), (F.col("src") % vertices).alias("src"), (F.col("dst") % vertices).alias("dst"))
    kept = hashed.groupBy("slot").agg(F.max_by(F.struct("src", "dst"), "line").alias("e")).select("slot", "e.src", "e.dst")
    apart = F.when(F.col("src") == F.col("dst"), (F.col("src") + 1) % vertices).otherwise(F.col("src"))
    return kept.select("slot", apart.alias("src"), "dst")


def sketched_triangles(stream: DataFrame, slots: int, vertices: int) -> int:
    return count_triangles(Graph().add_edges_from(sketch(stream, slots, vertices)))


def stream_tri_cnt(stream: DataFrame, n_edges: int, n_vertices: int, factor: int) -> int:
    """Triangles in one sketch of 1 / factor of the stream."""
    return sketched_triangles(stream, n_edges // factor, n_vertices // factor)


def stream_pl_tri_cnt(stream: DataFrame, n_edges: int, n_vertices: int, factor: int, case: int = 0) -> int:
    """An estimate from three sketches, of the first, middle and last third of the stream."""
    if case not in _CASES:
        raise ValueError(f"unknown case {case}")
    slots, vertices = n_edges // (3 * factor), n_vertices // (3 * factor)
    line = F.col("line")
    first, last = line < n_edges // 3, line >= 2 * n_edges // 3
    counts = sorted(sketched_triangles(stream.where(part), slots, vertices) for part in (first, ~first & ~last, last))
    return int(sum(w * c for w, c in zip(_CASES[case], counts, strict=True)) * factor)
