"""Triangles by intersected neighbour lists: no row is made for a path of two edges.

A vertex's list holds its neighbours of higher degree (ties by id), in that order. Of each edge (x, y) the rest of x's list
after y goes to y, and what it shares with y's own list closes a triangle. So one row an edge moves, not one a path,
and a hub's list is short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import materialize


def directed_up(edges: DataFrame) -> DataFrame:
    """(u, v, du, dv, more…) once for every undirected edge of ``edges`` (src < dst, more…): (du, u) < (dv, v)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    s, d = ends.toDF("_s", "ds"), ends.toDF("_d", "dd")
    known = edges.join(s, F.col("src") == F.col("_s")).join(d, F.col("dst") == F.col("_d"))
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    pick = lambda a, b, name: F.when(up, F.col(a)).otherwise(F.col(b)).alias(name)
    more = [c for c in edges.columns if c not in ("src", "dst")]
    return known.select(pick("src", "dst", "u"), pick("dst", "src", "v"), pick("ds", "dd", "du"), pick("dd", "ds", "dv"), *more)


def triangle_rows(edges: DataFrame) -> DataFrame:
    """(x, y, z) for every triangle of ``edges`` (src < dst), once, by rising degree.

    If the edges have a column ``bits``, that of each side comes with it: xy, xz and yz.
    """
    own = ["bits"] if "bits" in edges.columns else []
    near = directed_up(edges).groupBy("u").agg(F.array_sort(F.collect_list(F.struct("dv", "v", *own))).alias("a"))
    near = materialize(near.select("u", F.col("a.v").alias("vs"), *(F.col(f"a.{c}").alias("bs") for c in own)), "lists")
    rest = lambda c: F.slice(c, F.col("p") + 2, F.size("vs"))
    steps = near.where(F.size("vs") > 1).select("*", F.posexplode("vs").alias("p", "y")).where(F.col("p") + 1 < F.size("vs"))
    steps = steps.select(F.col("u").alias("x"), "y", rest("vs").alias("zs"), *([F.get("bs", F.col("p")).alias("xy"), rest("bs").alias("zb")] if own else []))
    lists = near.select(F.col("u").alias("_u"), F.col("vs").alias("ws"), *([F.col("bs").alias("wb")] if own else []))
    met, shared = steps.join(lists, F.col("y") == F.col("_u")), F.array_intersect("zs", "ws")
    if not own:
        return met.select("x", "y", F.explode(shared).alias("z"))
    at = lambda bits, ids, z: F.get(F.col(bits), (F.array_position(F.col(ids), z) - 1).cast("int"))
    closed = F.transform(shared, lambda z: F.struct(z.alias("z"), at("zb", "zs", z).alias("xz"), at("wb", "ws", z).alias("yz")))
    return met.select("x", "y", "xy", F.explode(closed).alias("c")).select("x", "y", "c.z", "xy", "c.xz", "c.yz")
