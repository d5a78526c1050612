"""Every graph operator as a query over the provided tables, with its SQL for DuckDB.

Graphs of the tables, all of them over whole tables:

* follow: part -> the part on the order's next line
* supply: customer <-> supplier, from orders and their lines (supplier ids as -1 - id, so that the sides can't meet)
* region: order -> customer -> nation -> region and supplier -> nation, a forest of trees with hubs
* click: user -> the next user with the same event type
* market: a property graph over customers and suppliers, with the first line's flags as relationships
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import generators
from skein.functions.sequences import SArrays, lcp_array, lcs, suffix_array
from skein.graph import DiGraph, Graph, PropGraph
from skein.operators import cohesion, communities, matching, traversal
from skein.plans.pattern import Pattern, compile_pattern
from skein.session import shared_dir
from skein.sources import files
from skein.streaming import sketch as sketches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def note(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return note


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one(spark: SparkSession, **values) -> DataFrame:
    """One row of scalars."""
    kinds = {bool: "boolean", int: "long", float: "double"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


# --- graphs of the tables


def follow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): the window is per order, so it needs no more than one order in a place."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("src"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "src")
    return lines.withColumn("dst", F.lead("src").over(order)).where("dst is not null").select("src", "dst", F.lit(1).cast("long").alias("weight"))


FOLLOW = """steps AS (
  SELECT CAST(l_partkey AS BIGINT) AS src, CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS BIGINT) AS dst
  FROM lineitem),
di AS (SELECT src, dst, count(*) AS weight FROM steps WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst),
sy AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM di UNION ALL SELECT dst, src, weight FROM di) GROUP BY src, dst),
v AS (SELECT DISTINCT src AS id FROM sy),
deg AS (SELECT src AS id, count(*) AS d FROM sy GROUP BY src),
tri AS (
  SELECT a.src AS a, a.dst AS b, b.dst AS c FROM sy a JOIN sy b ON a.dst = b.src AND a.src < a.dst AND b.src < b.dst
  JOIN sy c ON c.src = a.src AND c.dst = b.dst),
tc AS (SELECT id, count(*) AS t FROM (SELECT a AS id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY id)"""


def follow(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph().add_edges_from(follow_rows(spark, sf_dir), weight="weight")


def follow_directed(spark: SparkSession, sf_dir: str) -> DiGraph:
    return DiGraph().add_edges_from(follow_rows(spark, sf_dir), weight="weight")


def supply_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").cast("long").alias("src"), (-1 - F.col("l_suppkey")).cast("long").alias("dst"))


SUPPLY = """raw AS (SELECT CAST(o_custkey AS BIGINT) AS src, CAST(-1 - l_suppkey AS BIGINT) AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
sy AS (SELECT src, dst FROM raw UNION SELECT dst, src FROM raw),
v AS (SELECT DISTINCT src AS id FROM sy)"""


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph().add_edges_from(supply_rows(spark, sf_dir))


def region_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the four kinds are told apart by their remainder modulo 5."""
    of = lambda name, s, i, d, j: table(spark, sf_dir, name).select((F.col(s).cast("long") * 5 + i).alias("src"), (F.col(d).cast("long") * 5 + j).alias("dst"))
    parts = of("orders", "o_orderkey", 0, "o_custkey", 1), of("customer", "c_custkey", 1, "c_nationkey", 2), of("supplier", "s_suppkey", 4, "s_nationkey", 2), of("nation", "n_nationkey", 2, "n_regionkey", 3)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


REGION = """raw AS (
  SELECT CAST(o_orderkey * 5 AS BIGINT) AS src, CAST(o_custkey * 5 + 1 AS BIGINT) AS dst FROM orders
  UNION ALL SELECT c_custkey * 5 + 1, c_nationkey * 5 + 2 FROM customer
  UNION ALL SELECT s_suppkey * 5 + 4, s_nationkey * 5 + 2 FROM supplier
  UNION ALL SELECT n_nationkey * 5 + 2, n_regionkey * 5 + 3 FROM nation),
sy AS (SELECT src, dst FROM raw UNION SELECT dst, src FROM raw),
v AS (SELECT DISTINCT src AS id FROM sy)"""


def region(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph().add_edges_from(region_rows(spark, sf_dir))


def click_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", F.col("user_id").cast("long").alias("src"))
    order = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    return events.withColumn("dst", F.lead("src").over(order)).where("dst is not null").select("src", "dst")


CLICK = """steps AS (
  SELECT CAST(user_id AS BIGINT) AS src, CAST(lead(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS BIGINT) AS dst FROM events),
di AS (SELECT DISTINCT src, dst FROM steps WHERE dst IS NOT NULL AND src <> dst),
sy AS (SELECT src, dst FROM di UNION SELECT dst, src FROM di),
v AS (SELECT DISTINCT src AS id FROM sy),
deg AS (SELECT src AS id, count(*) AS d FROM sy GROUP BY src)"""


def click(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph().add_edges_from(click_rows(spark, sf_dir))


def market(spark: SparkSession, sf_dir: str) -> PropGraph:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    edges = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").cast("long").alias("cust"), (-1 - F.col("l_suppkey")).cast("long").alias("supp"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.col("l_quantity").cast("double").alias("quantity"), F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"),
    )
    graph = PropGraph().load_edge_attributes(edges, "cust", "supp", ["flag", "status"], order_by=["okey", "line", "quantity", "flag", "status"])
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").cast("long").alias("nation"))
    firms = table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).cast("long").alias("id"), F.lit("SUPPLIER").alias("kind"), F.col("s_nationkey").cast("long").alias("nation"))
    return graph.load_node_attributes(people.unionAll(firms), "id", ["kind"], order_by=["id"])


MARKET = """ranked AS (
  SELECT CAST(o_custkey AS BIGINT) AS src, CAST(-1 - l_suppkey AS BIGINT) AS dst, l_returnflag AS flag, l_linestatus AS status, CAST(l_quantity AS DOUBLE) AS quantity, l_orderkey AS okey, l_linenumber AS line,
    row_number() OVER (PARTITION BY o_custkey, l_suppkey ORDER BY l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE), l_returnflag, l_linestatus) AS r
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
e AS (SELECT src, dst, flag, status, quantity, okey, line FROM ranked WHERE r = 1),
ends AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
n AS (
  SELECT * FROM (
    SELECT CAST(c_custkey AS BIGINT) AS id, c_mktsegment AS kind, CAST(c_nationkey AS BIGINT) AS nation FROM customer
    UNION ALL SELECT CAST(-1 - s_suppkey AS BIGINT), 'SUPPLIER', CAST(s_nationkey AS BIGINT) FROM supplier)
  WHERE id IN (SELECT id FROM ends))"""


# --- construction, accessors and degrees


@query("g_edges", f"WITH {FOLLOW} SELECT src, dst, CAST(weight AS BIGINT) AS weight FROM sy")
def g_edges(spark, d):
    return follow(spark, d).edges().select("src", "dst", F.col("weight").cast("long").alias("weight"))


@query("g_edges_directed", f"WITH {FOLLOW} SELECT src, dst, CAST(weight AS BIGINT) AS weight FROM di")
def g_edges_directed(spark, d):
    return follow_directed(spark, d).edges().select("src", "dst", F.col("weight").cast("long").alias("weight"))


@query("g_nodes", f"WITH {FOLLOW} SELECT id, row_number() OVER (ORDER BY id) - 1 AS vid FROM v")
def g_nodes(spark, d):
    return follow(spark, d).ranked_nodes()


@query("g_internal_edges", f"WITH {FOLLOW}, k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS vid FROM v) SELECT a.vid AS src, b.vid AS dst, CAST(weight AS BIGINT) AS weight FROM sy JOIN k a ON a.id = src JOIN k b ON b.id = dst")
def g_internal_edges(spark, d):
    return follow(spark, d)._internal_edges().select("src", "dst", F.col("weight").cast("long").alias("weight"))


@query("g_size", f"WITH {FOLLOW} SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) // 2 FROM sy) AS n_edges, (SELECT count(*) FROM sy) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1.0)) AS density")
def g_size(spark, d):
    g = follow(spark, d)
    return one(spark, n_vertices=g.n_vertices, n_edges=g.n_edges, density=g.density())


@query("g_size_directed", f"WITH {FOLLOW} SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM di) AS n_edges, (SELECT count(*) FROM di) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1.0)) AS density")
def g_size_directed(spark, d):
    g = follow_directed(spark, d)
    return one(spark, n_vertices=g.n_vertices, n_edges=g.n_edges, density=g.density())


@query("g_degree", f"WITH {SUPPLY} SELECT src AS id, count(*) AS degree FROM sy GROUP BY src")
def g_degree(spark, d):
    return supply(spark, d).degree()


@query("g_degree_directed", f"WITH {FOLLOW} SELECT id, (SELECT count(*) FROM di WHERE src = id) AS out_degree, (SELECT count(*) FROM di WHERE dst = id) AS in_degree FROM v")
def g_degree_directed(spark, d):
    g = follow_directed(spark, d)
    return g.out_degree().join(g.in_degree(), "id")


@query("g_components_arrays", f"WITH {FOLLOW}, k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS vid FROM v) SELECT vid, count(*) AS neighbour FROM sy JOIN k ON src = id GROUP BY vid")
def g_components_arrays(spark, d):
    return follow(spark, d).graph_query("neighbour")


# --- traversal


@query(
    "g_bfs_layers",
    f"WITH RECURSIVE {REGION}, walk AS (SELECT (SELECT min(id) FROM v) AS id, 0 AS depth UNION SELECT sy.dst, depth + 1 FROM walk JOIN sy ON sy.src = walk.id WHERE depth < 9) "
    "SELECT v.id, CAST(coalesce(min(depth), -1) AS INTEGER) AS depth FROM v LEFT JOIN walk ON v.id = walk.id GROUP BY v.id",
)
def g_bfs_layers(spark, d):
    g = region(spark, d)
    return traversal.bfs_layers(g, g.nodes().agg(F.min("id")).first()[0])


@query(
    "g_bfs_directed",
    f"WITH RECURSIVE {FOLLOW}, walk AS (SELECT (SELECT min(id) FROM v) AS id, 0 AS depth UNION SELECT di.dst, depth + 1 FROM walk JOIN di ON di.src = walk.id WHERE depth < 6) "
    "SELECT v.id, CAST(coalesce(min(depth), -1) AS INTEGER) AS depth FROM v LEFT JOIN walk ON v.id = walk.id GROUP BY v.id",
)
def g_bfs_directed(spark, d):
    g = follow_directed(spark, d)
    return traversal.bfs_layers(g, g.nodes().agg(F.min("id")).first()[0])


_TREE = """walk AS (SELECT id AS root, id FROM v WHERE id % 5 = 3 UNION SELECT root, sy.src FROM walk JOIN sy ON sy.dst = walk.id),
comp AS (SELECT id, min(id) OVER (PARTITION BY root) AS component_id FROM walk)"""


@query("g_connected_components", f"WITH RECURSIVE {REGION}, {_TREE}, k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS vid FROM v) SELECT comp.id, component_id, k.vid AS label FROM comp JOIN k ON k.id = component_id")
def g_connected_components(spark, d):
    return traversal.connected_components(region(spark, d))


@query("g_count_components", f"WITH RECURSIVE {REGION}, {_TREE} SELECT count(DISTINCT component_id) AS components FROM comp")
def g_count_components(spark, d):
    return one(spark, components=traversal.count_components(region(spark, d)))


@query("g_diameter", f"WITH RECURSIVE {CLICK}, walk AS (SELECT id AS root, id, 0 AS depth FROM v UNION SELECT root, dst, depth + 1 FROM walk JOIN sy ON src = walk.id WHERE depth < 4) SELECT max(m) AS diameter FROM (SELECT root, id, min(depth) AS m FROM walk GROUP BY root, id)")
def g_diameter(spark, d):
    return one(spark, diameter=traversal.diameter(click(spark, d)))


# --- cohesion


@query("g_triangles", f"WITH {FOLLOW} SELECT 3 * count(*) AS triangles FROM tri")
def g_triangles(spark, d):
    return one(spark, triangles=cohesion.triangles(follow(spark, d)))


@query("g_triangles_per_vertex", f"WITH {FOLLOW} SELECT v.id, coalesce(t, 0) AS triangles FROM v LEFT JOIN tc USING (id)")
def g_triangles_per_vertex(spark, d):
    g = follow(spark, d)
    return cohesion.triangles(g, g.nodes())


@query("g_squares", f"WITH {FOLLOW} SELECT CAST(coalesce(sum(c * (c - 1) // 2) // 2, 0) AS BIGINT) AS squares FROM (SELECT a.src, b.src AS other, count(*) AS c FROM sy a JOIN sy b ON a.dst = b.dst AND a.src < b.src GROUP BY a.src, b.src)")
def g_squares(spark, d):
    return one(spark, squares=int(cohesion.squares(follow(spark, d))))


@query(
    "g_triangle_centrality",
    f"""WITH {FOLLOW},
near AS (SELECT DISTINCT s, d FROM (SELECT a AS s, b AS d FROM tri UNION ALL SELECT b, a FROM tri UNION ALL SELECT a, c FROM tri UNION ALL SELECT c, a FROM tri UNION ALL SELECT b, c FROM tri UNION ALL SELECT c, b FROM tri)),
part AS (
  SELECT sy.src AS id, sum(CASE WHEN near.s IS NOT NULL THEN coalesce(tc.t, 0) ELSE 0 END) AS i, sum(CASE WHEN near.s IS NULL THEN coalesce(tc.t, 0) ELSE 0 END) AS o
  FROM sy LEFT JOIN near ON near.s = sy.src AND near.d = sy.dst LEFT JOIN tc ON tc.id = sy.dst GROUP BY sy.src)
SELECT v.id, round(((i + coalesce(t, 0)) / 3.0 + o) / (SELECT count(*) FROM tri), 9) AS centrality FROM v JOIN part USING (id) LEFT JOIN tc USING (id)""",
)
def g_triangle_centrality(spark, d):
    return cohesion.triangle_centrality(follow(spark, d)).select("id", F.round("centrality", 9).alias("centrality"))


@query("g_jaccard", f"WITH {CLICK} SELECT p.u, p.v, round(c / (a.d + b.d - c), 9) AS jaccard FROM (SELECT x.dst AS u, y.dst AS v, CAST(count(*) AS DOUBLE) AS c FROM sy x JOIN sy y ON x.src = y.src AND x.dst < y.dst GROUP BY x.dst, y.dst) p JOIN deg a ON a.id = p.u JOIN deg b ON b.id = p.v")
def g_jaccard(spark, d):
    return cohesion.jaccard(click(spark, d)).select("u", "v", F.round("jaccard", 9).alias("jaccard"))


def _peeled(k: int, rounds: int) -> str:
    """SQL that drops, ``rounds`` times, the edges (u < v) in fewer than k - 2 triangles."""
    out = ["p0 AS (SELECT src, dst FROM sy WHERE src < dst)"]
    for i in range(rounds):
        both = f"(SELECT src, dst FROM p{i} UNION ALL SELECT dst, src FROM p{i})"
        out.append(f"p{i + 1} AS (SELECT e.src, e.dst FROM p{i} e JOIN {both} x ON x.src = e.src JOIN {both} y ON y.src = e.dst AND y.dst = x.dst GROUP BY e.src, e.dst HAVING count(*) >= {k - 2})")
    return ", ".join(out)


@query("g_k_truss", f"WITH {FOLLOW}, {_peeled(4, 6)} SELECT e.src, e.dst, CAST(CASE WHEN p.src IS NULL THEN 3 ELSE -1 END AS INTEGER) AS value FROM p0 e LEFT JOIN p6 p ON p.src = e.src AND p.dst = e.dst")
def g_k_truss(spark, d):
    return cohesion.k_truss(follow(spark, d), 4)


# an edge stands in the table once for every k whose truss holds it; k rises when a round takes no edge away
_PEEL = """peel AS (
  SELECT src, dst, CAST(2 AS INTEGER) AS k FROM sy WHERE src < dst
  UNION ALL (
    WITH s AS (SELECT src, dst FROM peel UNION ALL SELECT dst, src FROM peel),
    kept AS (
      SELECT e.src, e.dst, e.k FROM peel e JOIN s x ON x.src = e.src JOIN s y ON y.src = e.dst AND y.dst = x.dst
      GROUP BY e.src, e.dst, e.k HAVING count(*) >= e.k - 1)
    SELECT src, dst, CAST(k + CASE WHEN (SELECT count(*) FROM kept) = (SELECT count(*) FROM peel) THEN 1 ELSE 0 END AS INTEGER) FROM kept))"""


@query("g_truss_decomposition", f"WITH RECURSIVE {FOLLOW}, {_PEEL} SELECT src, dst, max(k) AS truss FROM peel GROUP BY src, dst")
def g_truss_decomposition(spark, d):
    return cohesion.truss_decomposition(follow(spark, d))


@query("g_max_truss", f"WITH RECURSIVE {FOLLOW}, {_PEEL} SELECT CAST(max(k) AS BIGINT) AS max_truss FROM peel")
def g_max_truss(spark, d):
    return one(spark, max_truss=cohesion.max_truss(follow(spark, d)))


@query("g_well_connected")
def g_well_connected(spark, d):
    g = supply(spark, d)
    people = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("long").alias("cluster"))
    firms = table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).cast("long").alias("id"), F.col("s_nationkey").cast("long").alias("cluster"))
    return communities.well_connected_clusters(g, people.unionAll(firms), "log2", pre_filter_min_size=3, post_filter_min_size=3)


# --- patterns


def _loop_pattern() -> DiGraph:
    return DiGraph().add_edges_from([0, 1, 2], [1, 2, 0])


@query(
    "g_isomorphism",
    f"WITH {FOLLOW} SELECT a.src AS v0, a.dst AS v1, b.dst AS v2 FROM di a JOIN di b ON b.src = a.dst JOIN di c ON c.src = b.dst AND c.dst = a.src WHERE a.src <> b.dst "
    "AND NOT EXISTS (SELECT 1 FROM di x WHERE x.src = a.dst AND x.dst = a.src) AND NOT EXISTS (SELECT 1 FROM di x WHERE x.src = b.dst AND x.dst = b.src) AND NOT EXISTS (SELECT 1 FROM di x WHERE x.src = a.src AND x.dst = b.dst)",
)
def g_isomorphism(spark, d):
    return matching.match_table(follow_directed(spark, d), _loop_pattern())


@query("g_monomorphism", f"WITH {FOLLOW} SELECT a.src AS v0, a.dst AS v1, b.dst AS v2 FROM di a JOIN di b ON b.src = a.dst JOIN di c ON c.src = b.dst AND c.dst = a.src WHERE a.src <> b.dst")
def g_monomorphism(spark, d):
    return matching.match_table(follow_directed(spark, d), _loop_pattern(), induced=False)


@query("g_monomorphism_count", f"WITH {FOLLOW} SELECT count(*) AS matches FROM di a JOIN di b ON b.src = a.dst JOIN di c ON c.src = b.dst AND c.dst = a.src JOIN di t ON t.src = a.src WHERE a.src <> b.dst AND t.dst <> a.dst AND t.dst <> b.dst")
def g_monomorphism_count(spark, d):
    tailed = DiGraph().add_edges_from([0, 1, 2, 0], [1, 2, 0, 3])
    return one(spark, matches=matching.subgraph_monomorphism(follow_directed(spark, d), tailed, return_isos_as="count"))


def _return_pattern(spark: SparkSession) -> Pattern:
    """Two customers of the first segment with returned goods from one supplier."""
    edges = spark.createDataFrame([(0, 2, "R"), (1, 2, "R")], "src long, dst long, flag string")
    nodes = spark.createDataFrame([(0, "AUTOMOBILE"), (1, "AUTOMOBILE"), (2, "SUPPLIER")], "id long, kind string")
    return Pattern.of(PropGraph().load_edge_attributes(edges, "src", "dst", ["flag"]).load_node_attributes(nodes, "id", ["kind"]))


@query(
    "g_attributed_pattern",
    f"WITH {MARKET} SELECT a.src AS v0, b.src AS v1, a.dst AS v2 FROM e a JOIN e b ON a.dst = b.dst AND a.src <> b.src JOIN n x ON x.id = a.src JOIN n y ON y.id = b.src JOIN n z ON z.id = a.dst "
    "WHERE a.flag = 'R' AND b.flag = 'R' AND x.kind = 'AUTOMOBILE' AND y.kind = 'AUTOMOBILE' AND z.kind = 'SUPPLIER'",
)
def g_attributed_pattern(spark, d):
    return compile_pattern(market(spark, d), _return_pattern(spark), True, "probability")


_LOOPS = f"WITH {FOLLOW}, m AS (SELECT a.src AS v0, a.dst AS v1, b.dst AS v2, a.weight AS x, b.weight AS y, c.weight AS z FROM di a JOIN di b ON b.src = a.dst JOIN di c ON c.src = b.dst AND c.dst = a.src WHERE a.src <> b.dst)"


@query("g_match_vertices", f"{_LOOPS} SELECT h_vertex, g_vertex, count(*) AS matches FROM (SELECT 0 AS h_vertex, v0 AS g_vertex FROM m UNION ALL SELECT 1, v1 FROM m UNION ALL SELECT 2, v2 FROM m) GROUP BY h_vertex, g_vertex")
def g_match_vertices(spark, d):
    found = matching.subgraph_monomorphism(follow_directed(spark, d), _loop_pattern())
    return found.groupBy("h_vertex", "g_vertex").agg(F.count(F.lit(1)).alias("matches"))


@query("g_match_edges", f"{_LOOPS} SELECT h_src, h_dst, src, dst, count(*) AS matches FROM (SELECT 0 AS h_src, 1 AS h_dst, v0 AS src, v1 AS dst FROM m UNION ALL SELECT 1, 2, v1, v2 FROM m UNION ALL SELECT 2, 0, v2, v0 FROM m) GROUP BY ALL")
def g_match_edges(spark, d):
    found = matching.subgraph_monomorphism(follow_directed(spark, d), _loop_pattern(), return_isos_as="edges", algorithm_type="ps")
    return found.groupBy("h_src", "h_dst", "src", "dst").agg(F.count(F.lit(1)).alias("matches"))


@query("g_match_limit", f"{_LOOPS} SELECT least(25, count(*)) AS matches FROM m")
def g_match_limit(spark, d):
    return one(spark, matches=matching.subgraph_monomorphism(follow_directed(spark, d), _loop_pattern(), size_limit=25, return_isos_as="count"))


@query("g_motif_multiplicities", f"{_LOOPS} SELECT count(*) AS matches FROM m WHERE (x = y AND y <> z) OR (x = z AND x <> y) OR (y = z AND x <> y)")
def g_motif_multiplicities(spark, d):
    """Loops of three whose edges have one weight twice and another once."""
    graph = follow_directed(spark, d)
    found = matching.subgraph_monomorphism(graph, _loop_pattern(), return_isos_as="edges")
    return one(spark, matches=matching.with_multiplicities(found, graph.edges(), "weight", [1, 2]).count())


@query(
    "g_triads",
    f"""WITH {FOLLOW}, t AS (SELECT a AS x, b AS y, c AS z FROM tri UNION ALL SELECT a, c, b FROM tri UNION ALL SELECT b, a, c FROM tri UNION ALL SELECT b, c, a FROM tri UNION ALL SELECT c, a, b FROM tri UNION ALL SELECT c, b, a FROM tri),
    e AS (SELECT src, dst FROM di),
    code AS (
      SELECT (xy.src IS NOT NULL)::INT + 2 * (xz.src IS NOT NULL)::INT + 4 * (yx.src IS NOT NULL)::INT + 8 * (yz.src IS NOT NULL)::INT + 16 * (zx.src IS NOT NULL)::INT + 32 * (zy.src IS NOT NULL)::INT AS code
      FROM t LEFT JOIN e xy ON xy.src = x AND xy.dst = y LEFT JOIN e xz ON xz.src = x AND xz.dst = z LEFT JOIN e yx ON yx.src = y AND yx.dst = x
      LEFT JOIN e yz ON yz.src = y AND yz.dst = z LEFT JOIN e zx ON zx.src = z AND zx.dst = x LEFT JOIN e zy ON zy.src = z AND zy.dst = y)
    SELECT p.code AS pattern, count(c.code) AS matches FROM (VALUES (11), (15), (25), (27), (30), (31), (63)) p(code) LEFT JOIN code c ON c.code = p.code GROUP BY p.code""",
)
def g_triads(spark, d):
    """Induced matches of the triads whose three vertices are all joined, by the code of their edges."""
    graph, rows = follow_directed(spark, d), []
    for code, edges in matching.triads().items():
        if len({frozenset(e) for e in edges}) == 3:
            found = matching.subgraph_isomorphism(graph, DiGraph().add_edges_from(*map(list, zip(*edges, strict=True))), return_isos_as="count")
            rows.append((code, found))
    return spark.createDataFrame(rows, "pattern int, matches long")


# --- property graphs


@query("g_edge_attributes", f"WITH {MARKET} SELECT * FROM e")
def g_edge_attributes(spark, d):
    return market(spark, d).get_edge_attributes()


@query("g_node_attributes", f"WITH {MARKET} SELECT * FROM n")
def g_node_attributes(spark, d):
    return market(spark, d).get_node_attributes()


@query("g_node_labels", f"WITH {MARKET} SELECT id, kind FROM n")
def g_node_labels(spark, d):
    return market(spark, d).get_node_labels()


@query("g_edge_relationships", f"WITH {MARKET} SELECT src, dst, flag, status FROM e")
def g_edge_relationships(spark, d):
    return market(spark, d).get_edge_relationships()


@query("g_filter_edges", f"WITH {MARKET} SELECT src, dst FROM e WHERE flag IN ('R', 'A') AND src IN (SELECT id FROM n WHERE kind IN ('BUILDING', 'SUPPLIER')) AND dst IN (SELECT id FROM n WHERE kind IN ('BUILDING', 'SUPPLIER'))")
def g_filter_edges(spark, d):
    return market(spark, d).filter_edges({"kind": ["BUILDING", "SUPPLIER"]}, {"flag": ["R", "A"]})


@query("g_subgraph_view", f"WITH {MARKET} SELECT src, dst FROM e WHERE quantity > 25 AND src IN (SELECT id FROM n WHERE nation < 12) AND dst IN (SELECT id FROM n WHERE nation < 12)")
def g_subgraph_view(spark, d):
    return market(spark, d).subgraph_view(lambda n: F.col("nation") < 12, lambda e: F.col("quantity") > 25).edges()


@query("g_subgraph_view_nodes", f"WITH {MARKET} SELECT src, dst FROM e WHERE src IN (SELECT id FROM n WHERE nation < 3) OR dst IN (SELECT id FROM n WHERE nation < 3)")
def g_subgraph_view_nodes(spark, d):
    return market(spark, d).subgraph_view(lambda n: F.col("nation") < 3).edges()


@query("g_query_labels", f"WITH {MARKET} SELECT id FROM n WHERE kind IN ('BUILDING', 'MACHINERY')")
def g_query_labels(spark, d):
    return market(spark, d).query_labels(["BUILDING", "MACHINERY"], "or")


@query("g_query_relationships", f"WITH {MARKET} SELECT src, dst FROM e WHERE flag = 'N' AND status = 'O'")
def g_query_relationships(spark, d):
    return market(spark, d).query_relationships(["N", "O"], "and")


@query("g_query_node_properties", f"WITH {MARKET} SELECT id FROM n WHERE nation >= 20")
def g_query_node_properties(spark, d):
    return market(spark, d).query_node_properties("nation", 20, ">=")


@query("g_query_edge_properties", f"WITH {MARKET} SELECT src, dst FROM e WHERE quantity < 10")
def g_query_edge_properties(spark, d):
    return market(spark, d).query_edge_properties("quantity", 10.0, "<")


@query("g_query_contains", f"WITH {MARKET} SELECT id FROM n WHERE contains(kind, 'HOUSE')")
def g_query_contains(spark, d):
    return market(spark, d).query_node_properties("kind", "HOUSE", "contains")


@query("g_one_path", f"WITH {MARKET} SELECT src, dst FROM e WHERE flag IN ('R') AND src IN (SELECT id FROM n WHERE kind IN ('SUPPLIER', 'FURNITURE')) AND dst IN (SELECT id FROM n WHERE kind IN ('SUPPLIER', 'FURNITURE'))")
def g_one_path(spark, d):
    return market(spark, d).one_path(["SUPPLIER", "FURNITURE"], ["R"], "or", "or")


@query("g_added_labels", f"WITH {MARKET} SELECT n.id, n.kind, CASE WHEN nation < 12 THEN 'low' ELSE 'high' END AS band FROM n")
def g_added_labels(spark, d):
    g = market(spark, d)
    band = g.get_node_attributes().select("id", F.when(F.col("nation") < 12, "low").otherwise("high").alias("band"))
    return g.add_node_labels(band, "id").get_node_labels()


@query("g_added_relationships", f"WITH {MARKET} SELECT src, dst, flag, status, CASE WHEN quantity < 25 THEN 'few' ELSE 'many' END AS amount FROM e")
def g_added_relationships(spark, d):
    g = market(spark, d)
    amount = g.get_edge_attributes().select("src", "dst", F.when(F.col("quantity") < 25, "few").otherwise("many").alias("amount"))
    return g.add_edge_relationships(amount, "src", "dst").get_edge_relationships()


# --- files


@query("g_edge_file", f"WITH {FOLLOW} SELECT src, dst FROM di")
def g_edge_file(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    files.write_edge_list(follow_directed(spark, d).edges().select("src", "dst"), path)
    return files.read_tsv_file(path, directed=True).edges()


@query(
    "g_nde_lines",
    f"WITH {FOLLOW}, k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS vid FROM v) SELECT 0 AS part, count(*) AS a, 0 AS b, CAST(count(*) AS VARCHAR) AS line FROM v "
    "UNION ALL SELECT 1, vid, d, vid || '    ' || d FROM k JOIN deg USING (id) UNION ALL SELECT 2, x.vid, y.vid, x.vid || '    ' || y.vid FROM sy JOIN k x ON x.id = src JOIN k y ON y.id = dst WHERE x.vid <= y.vid",
)
def g_nde_lines(spark, d):
    return files.nde_lines(follow(spark, d))


@query("g_relabelled_by_degree", f"WITH {FOLLOW} SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS vid FROM deg")
def g_relabelled_by_degree(spark, d):
    return files.relabelling(follow(spark, d), "degree")


@query("g_clusters_file", "SELECT DISTINCT CAST(c_custkey AS BIGINT) AS id, CAST(c_nationkey AS BIGINT) AS cluster FROM customer")
def g_clusters_file(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/clusters-{uuid.uuid4().hex}"
    files.write_clusters(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cluster")), path)
    return files.read_clusters(spark, path)


@query("g_matrix_market_file", f"WITH {FOLLOW} SELECT src, dst, CAST(weight AS DOUBLE) AS weight FROM di")
def g_matrix_market_file(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/mtx-{uuid.uuid4().hex}"
    edges = follow_directed(spark, d).edges()
    entry = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("src", "dst", "weight")))
    head = edges.agg(F.concat_ws(" ", F.max("src").cast("string"), F.max("dst").cast("string"), F.count(F.lit(1)).cast("string")).alias("line"))
    title = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general")], "part int, line string")
    lines = title.unionByName(head.select(F.lit(1).alias("part"), "line")).select("part", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "line")
    files.write_lines(lines.unionByName(edges.select(F.lit(2).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), entry.alias("line"))), path)
    return files.read_matrix_market_file(path, directed=True).edges()


@query("g_preprocessed_file", f"WITH {FOLLOW}, k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS vid FROM v) SELECT x.vid AS src, y.vid AS dst FROM sy JOIN k x ON x.id = src JOIN k y ON y.id = dst WHERE x.vid < y.vid")
def g_preprocessed_file(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    files.write_edge_list(follow_rows(spark, d).select("src", "dst"), path)
    return files.preprocess_edge_file(path)


@query("g_jaccard_file", f"WITH {CLICK} SELECT p.u, p.v, round(c / (a.d + b.d - c), 9) AS jaccard FROM (SELECT x.dst AS u, y.dst AS v, CAST(count(*) AS DOUBLE) AS c FROM sy x JOIN sy y ON x.src = y.src AND x.dst < y.dst GROUP BY x.dst, y.dst) p JOIN deg a ON a.id = p.u JOIN deg b ON b.id = p.v")
def g_jaccard_file(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/jaccard-{uuid.uuid4().hex}"
    files.write_jaccard(cohesion.jaccard(click(spark, d)), path)
    part = lambda i, kind: F.regexp_extract("value", r"^u=(-?\d+),v=(-?\d+),(.*)$", i).cast(kind)
    return spark.read.text(path).select(part(1, "long").alias("u"), part(2, "long").alias("v"), F.round(part(3, "double"), 9).alias("jaccard"))


_RANKED = "k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS vid FROM ends)"


@query(
    "g_glasgow_lines",
    f"WITH {MARKET}, {_RANKED} SELECT 0 AS part, x.vid AS a, y.vid AS b, x.vid || '>' || y.vid || ',' || flag || ',' || status || ',' || quantity || ',' || okey || ',' || line AS line FROM e JOIN k x ON x.id = src JOIN k y ON y.id = dst "
    "UNION ALL SELECT 1, vid, 0, vid || ',,' || kind || ',' || nation FROM n JOIN k USING (id)",
)
def g_glasgow_lines(spark, d):
    return files.glasgow_lines(market(spark, d))


@query(
    "g_vf3_lines",
    f"WITH {MARKET}, {_RANKED} SELECT 0 AS part, 0 AS a, -1 AS b, count(*) || chr(10) AS line FROM k UNION ALL SELECT 1, vid, -1, vid || ' ' || kind || ' ' || nation FROM n JOIN k USING (id) "
    "UNION ALL SELECT 2, vid, -1, chr(10) || (SELECT count(*) FROM e WHERE src = k.id) FROM k UNION ALL SELECT 2, x.vid, y.vid, x.vid || ' ' || y.vid FROM e JOIN k x ON x.id = src JOIN k y ON y.id = dst",
)
def g_vf3_lines(spark, d):
    return files.vf3_lines(market(spark, d))


# --- generators


@query("g_complete", "SELECT a.range AS src, b.range AS dst FROM range(60) a, range(60) b WHERE a.range <> b.range")
def g_complete(spark, d):
    return generators.complete_graph(60, Graph).edges().select("src", "dst")


@query("g_path", "SELECT range AS src, range + 1 AS dst FROM range(4999)")
def g_path(spark, d):
    return generators.path_graph(5000, DiGraph).edges().select("src", "dst")


@query("g_karate", "SELECT 34::BIGINT AS n_vertices, 78::BIGINT AS n_edges, 45::BIGINT AS triangles, 154::BIGINT AS squares")
def g_karate(spark, d):
    graph = generators.karate_club_graph(Graph)
    return one(spark, n_vertices=len(graph), n_edges=graph.size(), triangles=cohesion.count_triangles(graph), squares=cohesion.squares(graph))


@query("g_random_tree", "SELECT 2000::BIGINT AS n_vertices, 1999::BIGINT AS n_edges, 1::BIGINT AS components")
def g_random_tree(spark, d):
    graph = generators.random_tree(2000, Graph, seed=3)
    return one(spark, n_vertices=len(graph), n_edges=graph.size(), components=traversal.count_components(graph))


@query("g_ring_lattice", "SELECT DISTINCT a.range AS src, (a.range + j.o + 1000) % 1000 AS dst FROM range(1000) a, (VALUES (-3), (-2), (-1), (1), (2), (3)) j(o)")
def g_ring_lattice(spark, d):
    return generators.watts_strogatz_graph(1000, 6, 0.0, Graph, seed=1).edges().select("src", "dst")


@query("g_attachment", "SELECT 3000::BIGINT AS n_vertices, 1::BIGINT AS components, TRUE AS edges_in_range")
def g_attachment(spark, d):
    graph = generators.barabasi_albert_graph(3000, 4, Graph, seed=5)
    return one(spark, n_vertices=len(graph), components=traversal.count_components(graph), edges_in_range=2996 * 3 < graph.size() <= 2996 * 4)


@query("g_rmat", "SELECT TRUE AS vertices_in_range, TRUE AS edges_in_range, TRUE AS repeats")
def g_rmat(spark, d):
    graph, again = (generators.rmat_graph(10, Graph, edge_factor=8, seed=2) for _ in range(2))
    ends = graph.nodes().agg(F.min("id"), F.max("id")).first()
    return one(spark, vertices_in_range=0 <= ends[0] and ends[1] < 1 << 10, edges_in_range=0 < graph.size() <= 8 << 10, repeats=graph.edges().exceptAll(again.edges()).isEmpty())


# --- sketches and sequences

_STREAM = "(SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS line, CAST(l_partkey AS BIGINT) AS src, CAST(l_suppkey AS BIGINT) AS dst FROM lineitem)"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    from skein.plans.ranking import dense_ids

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("src"), F.col("l_suppkey").cast("long").alias("dst"))
    return dense_ids(rows, "l_orderkey", "l_linenumber", "src", "dst", name="line").select("line", "src", "dst")


@query(
    "g_sketch",
    f"WITH h AS (SELECT line % 5000 AS slot, src % 300 AS src, dst % 300 AS dst, line FROM {_STREAM}), k AS (SELECT slot, arg_max(src, line) AS s, arg_max(dst, line) AS d FROM h GROUP BY slot) "
    "SELECT slot, CASE WHEN s = d THEN (s + 1) % 300 ELSE s END AS src, d AS dst FROM k",
)
def g_sketch(spark, d):
    return sketches.sketch(_stream(spark, d), 5000, 300)


# three sketches of the thirds of the stream, and the triangles in each
_SKETCHES = f"""h AS (
  SELECT CASE WHEN line < n // 3 THEN 0 WHEN line >= (2 * n) // 3 THEN 2 ELSE 1 END AS part, line % (n // 9) AS slot, src % 100 AS src, dst % 100 AS dst, line
  FROM {_STREAM}, (SELECT count(*) AS n FROM lineitem)),
held AS (SELECT part, slot, arg_max(src, line) AS s, arg_max(dst, line) AS d FROM h GROUP BY part, slot),
apart AS (SELECT part, CASE WHEN s = d THEN (s + 1) % 100 ELSE s END AS src, d AS dst FROM held),
sides AS (SELECT part, src, dst FROM apart WHERE src <> dst UNION SELECT part, dst, src FROM apart WHERE src <> dst)"""


@query(
    "g_stream_triangles",
    f"WITH {_SKETCHES} SELECT 3 * count(*) AS estimate FROM sides a JOIN sides b ON a.part = b.part AND a.dst = b.src AND a.src < a.dst AND b.src < b.dst JOIN sides c ON c.part = a.part AND c.src = a.src AND c.dst = b.dst",
)
def g_stream_triangles(spark, d):
    rows = _stream(spark, d)
    return one(spark, estimate=sketches.stream_pl_tri_cnt(rows, rows.count(), 900, 3))


@query("g_suffix_array", "SELECT n_name AS text, list_transform(list_sort(list_transform(range(0, len(n_name) + 1), lambda i: {'s': substr(n_name, CAST(i + 1 AS BIGINT)), 'i': i})), lambda x: CAST(x.i AS INTEGER)) AS suffixes FROM nation")
def g_suffix_array(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("text"), suffix_array("n_name").alias("suffixes"))


_SUFFIXES = "(SELECT n_name, list_sort(list_transform(range(1, len(n_name) + 2), lambda i: substr(n_name, i))) AS s FROM nation)"


@query(
    "g_lcp_array",
    "SELECT n_name AS text, list_transform(range(1, len(s) + 1), lambda i: CAST(CASE WHEN i = 1 THEN 0 ELSE len(list_filter(range(1, len(s[i - 1]) + 1), lambda k: left(s[i - 1], k) = left(s[i], k))) END AS INTEGER)) AS lcp "
    f"FROM {_SUFFIXES}",
)
def g_lcp_array(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("text"), lcp_array("n_name", suffix_array("n_name")).alias("lcp"))


@query(
    "g_lcs",
    # one row of the dynamic programme for each letter of the nation
    """WITH RECURSIVE both_ AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
    dp AS (
      SELECT n_name, r_name, CAST(0 AS BIGINT) AS i, list_transform(range(0, len(r_name) + 1), lambda j: CAST(0 AS BIGINT)) AS row FROM both_
      UNION ALL
      SELECT n_name, r_name, i + 1, list_transform(range(0, len(r_name) + 1), lambda j: CASE WHEN j = 0 THEN CAST(0 AS BIGINT) ELSE
        list_max(list_transform(range(1, j + 1), lambda q: greatest(row[q + 1], CASE WHEN substr(r_name, q, 1) = substr(n_name, i + 1, 1) THEN row[q] + 1 ELSE 0 END))) END)
      FROM dp WHERE i < len(n_name))
    SELECT n_name, r_name, row[len(r_name) + 1] AS length, TRUE AS in_nation, TRUE AS in_region FROM dp WHERE i = len(n_name)""",
)
def g_lcs(spark, d):
    nations, regions = table(spark, d, "nation"), table(spark, d, "region")
    rows = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("common", lcs("n_name", "r_name"))
    # the letters in order with anything between: there may be several longest ones
    within = F.array_join(F.split("common", ""), ".*")
    return rows.select("n_name", "r_name", F.length("common").cast("long").alias("length"), F.rlike("n_name", within).alias("in_nation"), F.rlike("r_name", within).alias("in_region"))


_SORTED = "s AS (SELECT CAST(n_nationkey AS BIGINT) AS row, list_transform(list_sort(list_transform(range(0, len(n_name) + 1), lambda i: {'s': substr(n_name, CAST(i + 1 AS BIGINT)), 'i': i})), lambda x: x.i) AS v FROM nation)"


@query("g_suffix_compared", f"WITH {_SORTED} SELECT a.row, a.v = b.v AS result FROM s a JOIN s b ON b.row = 24 - a.row")
def g_suffix_compared(spark, d):
    nations = table(spark, d, "nation")
    turned = nations.select((24 - F.col("n_nationkey")).alias("row"), "n_name")
    return SArrays.of_strings(nations, "n_nationkey", "n_name") == SArrays.of_strings(turned, "row", "n_name")


@query("g_suffix_members", f"WITH {_SORTED} SELECT a.row, EXISTS (SELECT 1 FROM s b WHERE b.row % 3 = 0 AND b.v = a.v) AS result FROM s a")
def g_suffix_members(spark, d):
    arrays = SArrays.of_strings(table(spark, d, "nation"), "n_nationkey", "n_name")
    return arrays.in1d(arrays[::3])


@query("g_suffix_lengths", "SELECT CAST(n_nationkey AS BIGINT) AS row, CAST(len(n_name) + 1 AS INTEGER) AS length FROM nation")
def g_suffix_lengths(spark, d):
    return SArrays.of_strings(table(spark, d, "nation"), "n_nationkey", "n_name").get_lengths()
