"""Text formats of graphs: Matrix Market, edge lists, clusterings, node-degree-edge files, sketches and exports.

All are read with ``spark.read.text`` and parsed by column expressions, so splits, columns and filters are Spark's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.graph.core import DiGraph, Graph
from skein.graph.property import PropGraph


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _fields(path: str, comment: str | None = None) -> DataFrame:
    lines = _session().read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"))
    lines = lines.where("line <> ''")
    return lines.where(~F.col("line").startswith(comment)) if comment else lines


def _graph(rows: DataFrame, directed: bool, weighted: bool, only_edges: bool):
    if only_edges:
        return rows
    graph = DiGraph() if directed else Graph()
    return graph.add_edges_from(rows, weight="weight" if weighted else None)


def read_matrix_market_file(filepath: str, directed: bool = False, only_edges: bool = False, comment_header: str = "%"):
    """A graph, or its (src, dst[, weight]) rows, from a coordinate file; three columns mean real weights.

    The first line without comment is "rows columns entries". Ids stay 1-based; ``symmetric`` in the header isn't read, the
    caller decides on the direction.
    """
    raw = _session().read.text(filepath)
    places = raw.select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    lines = places.where((F.col("line") != "") & ~F.col("line").startswith(comment_header))
    # splits of one file are numbered in its order, and parts of one are named in it, so the first is the size line
    head = lines.agg(F.min_by(F.struct("line", "at"), F.struct("file", "at")).alias("h")).first()["h"]
    if head is None:
        raise ValueError("the file has no size line")
    entries = lines.where(F.col("at") != head["at"]).select(F.split("line", " ").alias("f"))
    first = entries.select(F.size("f").alias("n")).limit(1).collect()
    weighted = bool(first) and first[0]["n"] > 2
    columns = [F.get("f", F.lit(0)).try_cast("long").alias("src"), F.get("f", F.lit(1)).try_cast("long").alias("dst")]
    rows = entries.select(*columns, *([F.get("f", F.lit(2)).try_cast("double").alias("weight")] if weighted else []))
    return _graph(rows, directed, weighted, only_edges)


def read_edge_list(path: str, weighted: bool = False) -> DataFrame:
    """(src, dst[, weight]) from two or three whole numbers a line, with any white space between; ``#`` starts a comment."""
    parts = _fields(path, "#").select(F.split("line", " ").alias("f"))
    names = ["src", "dst", "weight"][: 3 if weighted else 2]
    return parts.select(*(F.get("f", F.lit(i)).try_cast("long").alias(c) for i, c in enumerate(names)))


def read_tsv_file(filepath: str, directed: bool = False, weighted: bool = False, only_edges: bool = False):
    """A graph, or its rows, from an edge list without header."""
    return _graph(read_edge_list(filepath, weighted), directed, weighted, only_edges)


def graph_file_read(filename: str, columns: int = 2, directed: bool = False, degree_sort: bool = False, rcm: bool = False) -> Graph:
    """The older reader: sizes are found, not given. The flags renumber vertices, which changes no answer."""
    rows = read_edge_list(filename, columns > 2)
    graph = _graph(rows, directed, columns > 2, False)
    return relabelled(graph, "rcm" if rcm else "degree") if degree_sort or rcm else graph


def graph_file_read_mtx(filename: str, directed: bool = False, degree_sort: bool = False, rcm: bool = False) -> Graph:
    graph = read_matrix_market_file(filename, directed)
    return relabelled(graph, "rcm" if rcm else "degree") if degree_sort or rcm else graph


def relabelling(graph: Graph, order: str = "rank") -> DataFrame:
    """(id, vid): new ids by rank, by ascending degree, or reverse Cuthill-McKee (layers from a vertex of least degree)."""
    from skein.operators.traversal import bfs_layers
    from skein.plans.ranking import dense_ids

    if order == "rank":
        return graph.ranked_nodes()
    degree = graph.degree()
    if order == "degree":
        return dense_ids(degree, "degree", "id").select("id", "vid")
    if order == "rcm":
        start = degree.agg(F.min(F.struct("degree", "id")).alias("m")).first()["m"]["id"]
        layered = bfs_layers(graph, start).join(degree, "id")
        ranked = dense_ids(layered.withColumn("_d", F.when(F.col("depth") < 0, F.lit(2**31 - 1)).otherwise(F.col("depth"))), "_d", "degree", "id")
        return ranked.select("id", (F.lit(graph.n_vertices - 1) - F.col("vid")).alias("vid"))
    raise ValueError(f"unknown order {order!r}")


def relabelled(graph: Graph, order: str) -> Graph:
    ids = relabelling(graph, order)
    weight = ["weight"] if graph.weighted else []
    rows = graph.edges() if graph.directed else graph.edges().where("src <= dst")
    rows = rows.join(ids.toDF("_s", "_sv"), F.col("src") == F.col("_s")).join(ids.toDF("_d", "_dv"), F.col("dst") == F.col("_d"))
    rows = rows.select(F.col("_sv").alias("src"), F.col("_dv").alias("dst"), *weight)
    out = (DiGraph() if graph.directed else Graph())
    kept = rows if graph.directed else rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *weight))
    out.weighted = graph.weighted
    return out._set(kept.distinct(), False)


def preprocess_edge_file(path: str, out: str | None = None, columns: int = 2, directed: bool = False, skip_lines: int = 0) -> DataFrame:
    """An edge list without copies and loops, with dense ids; written to ``out`` if that is given."""
    rows = read_edge_list(path, columns > 2)
    if skip_lines:
        lines = _session().read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
        parts = lines.where(F.col("at") >= skip_lines).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f"))
        rows = parts.select(*(F.get("f", F.lit(i)).try_cast("long").alias(c) for i, c in enumerate(["src", "dst", "weight"][:columns])))
    graph = _graph(rows, directed, columns > 2, False)
    edges = graph._internal_edges()
    edges = edges if directed else edges.where("src < dst")
    if out:
        write_edge_list(edges, out)
    return edges


def write_edge_list(edges: DataFrame, path: str) -> None:
    columns = [c for c in ("src", "dst", "weight") if c in edges.columns]
    edges.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns))).write.mode("errorifexists").text(path)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(id, cluster) from "vertex cluster" lines; lines with fewer than two fields are skipped, repeats are one."""
    lines = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f")).where(F.size("f") >= 2)
    return lines.select(F.get("f", F.lit(0)).try_cast("long").alias("id"), F.get("f", F.lit(1)).try_cast("long").alias("cluster")).where("id is not null and cluster is not null").distinct()


def write_clusters(clusters: DataFrame, path: str) -> None:
    """"vertex cluster" lines; an existing output is never overwritten."""
    clusters.select(F.concat_ws(" ", F.col("id").cast("string"), F.col("cluster").cast("string"))).write.mode("errorifexists").text(path)


def nde_lines(graph: Graph) -> DataFrame:
    """(part, a, b, line) of a node-degree-edge file: the vertex count, "i degree" lines, then the edges, in dense ids."""
    ids = graph.ranked_nodes()
    degree = graph.out_degree().withColumnRenamed("out_degree", "degree") if graph.directed else graph.degree()
    nodes = ids.join(degree, "id").select(F.lit(1).alias("part"), F.col("vid").alias("a"), F.col("degree").cast("long").alias("b"))
    edges = graph._internal_edges()
    edges = (edges if graph.directed else edges.where("src <= dst")).select(F.lit(2).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"))
    head = ids.agg(F.lit(0).alias("part"), F.count(F.lit(1)).alias("a"), F.lit(0).cast("long").alias("b"))
    rows = head.unionByName(nodes).unionByName(edges)
    return rows.withColumn("line", F.when(F.col("part") == 0, F.col("a").cast("string")).otherwise(F.concat_ws("    ", F.col("a").cast("string"), F.col("b").cast("string"))))


def write_nde(graph: Graph, path: str) -> None:
    """A node-degree-edge file in ordered parts."""
    write_lines(nde_lines(graph), path)


def write_jaccard(similarities: DataFrame, path: str) -> None:
    """"u=…,v=…,similarity" lines, compressed: a line has some 40 bytes, most of them the same as before."""
    line = F.concat(F.lit("u="), F.col("u").cast("string"), F.lit(",v="), F.col("v").cast("string"), F.lit(","), F.col("jaccard").cast("string"))
    similarities.select(line).write.mode("errorifexists").text(path, compression="gzip")


def _attributes(table: DataFrame, keys: tuple[str, ...]) -> list[str]:
    return [c for c in table.columns if c not in keys]


def glasgow_lines(graph: PropGraph) -> DataFrame:
    """(part, a, b, line) for a matcher's CSV: "s>d,attributes" lines, then "v,,attributes" lines, in dense ids."""
    ids = graph.ranked_nodes()
    table = graph.get_edge_attributes()
    own = _attributes(table, ("src", "dst"))
    e = table.join(ids.toDF("_s", "a"), F.col("src") == F.col("_s")).join(ids.toDF("_d", "b"), F.col("dst") == F.col("_d"))
    edge = F.concat_ws(",", F.concat(F.col("a").cast("string"), F.lit(">"), F.col("b").cast("string")), *(F.col(c).cast("string") for c in own))
    nodes = ids.join(graph.get_node_attributes(), "id", "left")
    names = _attributes(graph.get_node_attributes(), ("id",))
    node = F.concat_ws(",", F.col("vid").cast("string"), F.lit(""), *(F.col(c).cast("string") for c in names))
    return e.select(F.lit(0).alias("part"), "a", "b", edge.alias("line")).unionByName(nodes.select(F.lit(1).alias("part"), F.col("vid").alias("a"), F.lit(0).cast("long").alias("b"), node.alias("line")))


def vf3_lines(graph: PropGraph) -> DataFrame:
    """(part, a, b, line) for a matcher's text form: vertex count, "v attributes" lines, and per vertex its out-edges."""
    ids = graph.ranked_nodes()
    names = _attributes(graph.get_node_attributes(), ("id",))
    nodes = ids.join(graph.get_node_attributes(), "id", "left")
    text = F.concat_ws(" ", F.col("vid").cast("string"), *([F.col(c).cast("string") for c in names] or [F.lit("0")]))
    edges = graph._internal_edges()
    degree = ids.join(edges.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("n")), "vid", "left")
    none = F.lit(-1).cast("long")
    parts = [
        ids.agg(F.lit(0).alias("part"), F.lit(0).cast("long").alias("a"), none.alias("b"), F.concat(F.count(F.lit(1)).cast("string"), F.lit("\n")).alias("line")),
        nodes.select(F.lit(1).alias("part"), F.col("vid").alias("a"), none.alias("b"), text.alias("line")),
        degree.select(F.lit(2).alias("part"), F.col("vid").alias("a"), none.alias("b"), F.concat(F.lit("\n"), F.coalesce("n", F.lit(0)).cast("string")).alias("line")),
        edges.select(F.lit(2).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("line")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """(part, a, b, line) rows in order, as a folder of files that make one file in the order of their names; each task writes its range."""
    lines.orderBy("part", "a", "b").select("line").write.mode("errorifexists").text(path)
