"""Property graphs, patterns, files, communities, sketches and sequences."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import skein
from skein import DiGraph, Graph, PropGraph
from skein.operators.communities import criterion, min_cut
from skein.plans.pattern import Pattern, compile_pattern
from skein.sources import files


def pairs(df):
    return sorted((r.src, r.dst) for r in df.collect())


# --- property graphs


@pytest.fixture(scope="module")
def shop(spark):
    edges = spark.createDataFrame(
        [(1, 2, "buys", "web", 5, 1.5, True), (1, 2, "late", "web", 9, 9.0, False), (2, 3, "buys", "shop", 7, 2.5, False), (3, 1, "sees", "web", 1, 0.5, True), (4, 4, "self", "x", 1, 1.0, True), (3, 4, "sees", "shop", 3, 3.5, True)],
        "a long, b long, rel string, via string, n int, amount double, ok boolean",
    )
    nodes = spark.createDataFrame([(1, "red", "big", 10), (2, "blue", "big", 20), (3, "red", "small", 30), (9, "red", "big", 40), (1, "green", "tiny", 11)], "v long, colour string, size string, age int")
    g = PropGraph().load_edge_attributes(edges.coalesce(1), "a", "b", ["rel", "via"], order_by=["n"])
    return g.load_node_attributes(nodes, "v", ["colour", "size"], order_by=["age"])


def test_first_rows_and_roles(shop):
    assert pairs(shop.edges()) == [(1, 2), (2, 3), (3, 1), (3, 4)]
    rel = {(r.src, r.dst): r.rel for r in shop.get_edge_relationships().collect()}
    assert rel[1, 2] == "buys"
    assert {r.id: r.colour for r in shop.get_node_labels().collect()} == {1: "red", 2: "blue", 3: "red"}
    assert set(shop.get_node_properties().columns) == {"id", "age"} and set(shop.get_edge_properties().columns) == {"src", "dst", "n", "amount", "ok"}


def test_queries(shop):
    assert pairs(shop.filter_edges({"colour": ["red", "blue"]}, {"via": ["web"]})) == [(1, 2), (3, 1)]
    assert sorted(r.id for r in shop.query_labels(["red", "big"], "and").collect()) == [1]
    assert sorted(r.id for r in shop.query_labels(["red", "big"], "or").collect()) == [1, 2, 3]
    assert pairs(shop.query_relationships(["sees", "web"], "and")) == [(3, 1)]
    assert sorted(r.id for r in shop.query_node_properties("age", 20, ">=").collect()) == [2, 3]
    assert sorted(r.id for r in shop.query_node_properties("colour", "lu", "contains").collect()) == [2]
    assert pairs(shop.query_edge_properties("ok", True, "==")) == [(1, 2), (3, 1), (3, 4)]
    assert pairs(shop.one_path(["red"], ["sees"], "or", "or")) == [(3, 1)]
    for bad in (("colour", "a", "<"), ("age", 1, "contains"), ("age", 1, "?")):
        with pytest.raises(ValueError):
            shop.query_node_properties(*bad)
    with pytest.raises(KeyError):
        shop.query_node_properties("none", 1, "<")


def test_views(shop):
    red, web = (lambda n: n["colour"] == "red"), (lambda e: e["via"] == "web")
    assert pairs(shop.subgraph_view(red, web).edges()) == [(3, 1)]
    assert pairs(shop.subgraph_view(filter_node=red).edges()) == [(1, 2), (2, 3), (3, 1), (3, 4)]
    assert pairs(shop.subgraph_view(filter_node=lambda n: n["colour"] == "blue").edges()) == [(1, 2), (2, 3)]
    assert pairs(shop.subgraph_view(filter_edge=web).edges()) == [(1, 2), (3, 1)]
    assert type(shop.subgraph_view()) is DiGraph


def test_added_columns(spark):
    g = PropGraph().load_edge_attributes(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), "a", "b")
    with pytest.raises(KeyError):
        g.get_node_labels()
    g.add_node_labels(spark.createDataFrame([(1, "x"), (7, "y")], "v long, l string"), "v")
    g.add_edge_relationships(spark.createDataFrame([(1, 2, "r")], "a long, b long, r string"), "a", "b")
    assert {r.id: r.l for r in g.get_node_labels().collect()} == {1: "x", 2: None, 3: None}
    assert pairs(g.query_relationships(["r"])) == [(1, 2)]
    with pytest.raises(KeyError):
        g.add_node_labels(spark.createDataFrame([(1, "x")], "v long, l string"), "v")
    with pytest.raises(ValueError):
        PropGraph().load_node_attributes(spark.createDataFrame([(1, "x")], "v long, l string"), "v")
    with pytest.raises(TypeError):
        g.add_node_properties(spark.createDataFrame([(1, [1])], "v long, m array<int>"), "v")


# --- patterns


def slow(host, pattern, induced):
    vs, names = sorted({v for e in host for v in e}), sorted({v for e in pattern for v in e})
    out = set()
    for pick in itertools.permutations(vs, len(names)):
        m = dict(zip(names, pick, strict=True))
        ok = all((m[a], m[b]) in host for a, b in pattern)
        if ok and induced:
            ok = all(((m[a], m[b]) in host) == ((a, b) in pattern) for a in names for b in names if a != b)
        if ok:
            out.add(pick)
    return out


@pytest.mark.parametrize("pattern", [[(0, 1), (1, 2)], [(0, 1), (1, 2), (2, 0), (1, 3)], [(0, 1), (1, 0)], [(0, 1), (2, 1), (2, 3)]])
def test_against_all_maps(spark, pattern):
    r = random.Random(len(pattern))
    host = {(a, b) for a in range(8) for b in range(8) if a != b and r.random() < 0.3}
    g = DiGraph().add_edges_from(*zip(*host, strict=True))
    h = DiGraph().add_edges_from(*zip(*pattern, strict=True))
    for induced, f in ((True, skein.subgraph_isomorphism), (False, skein.subgraph_monomorphism)):
        want = slow(host, pattern, induced)
        assert {tuple(x) for x in compile_pattern(g, Pattern.of(h), induced).collect()} == want
        assert f(g, h, return_isos_as="count", reorder_type="None") == len(want)


def test_return_shapes_and_limits(spark):
    g, h = skein.complete_graph(4, DiGraph), DiGraph().add_edges_from([0], [1])
    assert skein.subgraph_monomorphism(g, h, return_isos_as="vertices").count() == 24
    assert skein.subgraph_monomorphism(g, h, return_isos_as="edges").columns == ["match_id", "h_src", "h_dst", "src", "dst"]
    vertices, edges = skein.subgraph_monomorphism(g, h, return_isos_as="complete", time_limit=5)
    assert vertices.count() == 24 and edges.count() == 12
    assert skein.subgraph_monomorphism(g, h, return_isos_as="count", size_limit=5) == 5
    for bad in ({"algorithm_type": "x"}, {"return_isos_as": "x"}, {"reorder_type": "x"}):
        with pytest.raises(ValueError):
            skein.subgraph_monomorphism(g, h, **bad)
    with pytest.raises(ValueError):
        skein.subgraph_monomorphism(skein.complete_graph(4, Graph), h)
    with pytest.raises(ValueError):
        skein.subgraph_monomorphism(g, DiGraph().add_edges_from([0, 2], [1, 3]))


def test_attributes(spark):
    edges = spark.createDataFrame([(0, 1, "r"), (1, 2, "r"), (2, 0, "s"), (0, 2, "r")], "a long, b long, rel string")
    nodes = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "v long, lab string")
    host = PropGraph().load_edge_attributes(edges, "a", "b", ["rel"]).load_node_attributes(nodes, "v", ["lab"])
    bare = DiGraph().add_edges_from([0, 1, 2, 0], [1, 2, 0, 2])

    def pattern(rel="rel string", lab="lab string", r="r", a="x", b="y"):
        p = PropGraph().load_edge_attributes(spark.createDataFrame([(0, 1, r)], f"a long, b long, {rel}"), "a", "b")
        return p.load_node_attributes(spark.createDataFrame([(0, a), (1, b)], f"v long, {lab}"), "v")

    found = lambda g, p, **k: sorted(map(tuple, compile_pattern(g, Pattern.of(p), False, **k).collect()))
    assert found(host, pattern()) == [(0, 1)] == found(host, pattern(), reorder_type="probability")
    assert found(host, pattern(b="x")) == [(0, 2)]
    assert found(bare, pattern()) == []  # the pattern has attributes, the host none
    assert len(found(host, DiGraph().add_edges_from([0], [1]))) == 4  # the host has attributes, the pattern none
    assert found(host, pattern(rel="other string")) == []  # nothing to compare
    shapes = skein.subgraph_monomorphism(host, DiGraph().add_edges_from([0, 1], [1, 2]), return_isos_as="edges")
    kept = skein.with_multiplicities(shapes, host.get_edge_attributes(), "rel", [2])
    assert kept.count() == 1


def test_wide_fixture(spark):
    """A pattern with constant labels; induced matches are among the others, and automorphic images divide the count."""
    g, h = skein.karate_club_graph(DiGraph), DiGraph().add_edges_from([0, 1, 2], [1, 2, 0])
    assert skein.subgraph_monomorphism(g, h, return_isos_as="count") == 45 * 6
    assert skein.subgraph_isomorphism(g, h, return_isos_as="count") == 0  # every edge goes both ways


# --- files


def test_matrix_market_and_edge_lists(spark, tmp_path):
    (tmp_path / "k.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n%comment\n\n4 4 3\n2 1\n3  1\n4\t3\n")
    (tmp_path / "w.mtx").write_text("%%MatrixMarket\n3 3 2\n1 2 0.5\n2 3 1.5\n")
    (tmp_path / "e.tsv").write_text("1   2\n2\t3\n 3   1 \n\n1   2\n")
    (tmp_path / "w.tsv").write_text("1 2 5\n2 3 7\n")
    g = skein.read_matrix_market_file(str(tmp_path / "k.mtx"))
    assert (len(g), g.size()) == (4, 3) and pairs(skein.read_matrix_market_file(str(tmp_path / "k.mtx"), directed=True).edges()) == [(2, 1), (3, 1), (4, 3)]
    assert {r.weight for r in skein.read_matrix_market_file(str(tmp_path / "w.mtx"), only_edges=True).collect()} == {0.5, 1.5}
    assert skein.read_tsv_file(str(tmp_path / "e.tsv")).size() == 3
    assert {r.weight for r in skein.read_tsv_file(str(tmp_path / "w.tsv"), directed=True, weighted=True).edges().collect()} == {5, 7}
    assert skein.graph_file_read(str(tmp_path / "e.tsv"), degree_sort=True).size() == 3
    assert skein.graph_file_read_mtx(str(tmp_path / "k.mtx"), rcm=True).size() == 3
    assert pairs(skein.preprocess_edge_file(str(tmp_path / "e.tsv"), str(tmp_path / "out"), skip_lines=1)) == [(0, 1), (0, 2), (1, 2)]
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_outputs(spark, tmp_path):
    g = Graph().add_edges_from([5, 6, 7, 7], [6, 7, 8, 5])
    files.write_nde(g, str(tmp_path / "nde"))
    assert [r.value for r in spark.read.text(str(tmp_path / "nde")).collect()] == ["4", "0    2", "1    2", "2    3", "3    1", "0    1", "0    2", "1    2", "2    3"]
    skein.write_jaccard(skein.jaccard(g), str(tmp_path / "j"))
    assert all(r.value.startswith("u=") for r in spark.read.text(str(tmp_path / "j")).collect())
    p = PropGraph().load_edge_attributes(spark.createDataFrame([(5, 6, "r"), (6, 9, "s")], "a long, b long, rel string"), "a", "b")
    p.load_node_attributes(spark.createDataFrame([(5, 1), (6, 2), (9, 3)], "v long, x int"), "v")
    files.write_lines(files.glasgow_lines(p), str(tmp_path / "g"))
    assert [r.value for r in spark.read.text(str(tmp_path / "g")).collect()] == ["0>1,r", "1>2,s", "0,,1", "1,,2", "2,,3"]
    files.write_lines(files.vf3_lines(p), str(tmp_path / "v"))
    assert [r.value for r in spark.read.text(str(tmp_path / "v")).collect()] == ["3", "", "0 1", "1 2", "2 3", "", "1", "0 1", "", "1", "1 2", "", "0"]
    with pytest.raises(Exception, match="exists"):
        files.write_nde(g, str(tmp_path / "nde"))


def test_relabelling_keeps_the_graph(spark):
    g = skein.karate_club_graph(Graph)
    for order in ("rank", "degree", "rcm"):
        again = skein.relabelled(g, order)
        assert (len(again), again.size(), skein.count_triangles(again)) == (34, 78, 45)
        assert sorted(r.vid for r in skein.relabelling(g, order).collect()) == list(range(34))


# --- communities


def brute_cut(adjacency):
    vs = sorted(adjacency)
    best = None
    for bits in range(1, 1 << (len(vs) - 1)):
        side = {v for i, v in enumerate(vs) if bits >> i & 1}
        cut = sum(1 for v in side for u in adjacency[v] if u not in side)
        best = cut if best is None else min(best, cut)
    return best


def test_min_cut():
    r = random.Random(4)
    for n in range(2, 9):
        for _ in range(12):
            adjacency = {v: set() for v in range(n)}
            for a in range(n):
                for b in range(a):
                    if r.random() < 0.5:
                        adjacency[a].add(b)
                        adjacency[b].add(a)
            size, side = min_cut(adjacency)
            assert size == brute_cut(adjacency) and 0 < len(side) < n
            assert size == sum(1 for v in side for u in adjacency[v] if u not in side)


def test_criteria():
    assert [criterion(c, 100) for c in ("log10", "log2", "sqrt")] == [2, 6, 2] and criterion("mult", 100, 0.07) == 7
    with pytest.raises(ValueError):
        criterion("no", 1)


def test_well_connected(spark, tmp_path):
    clique = lambda k, at: [(at + a, at + b) for a in range(k) for b in range(a)]
    edges = clique(6, 0) + clique(6, 10) + [(0, 10)] + [(30 + i, 31 + i) for i in range(5)] + clique(5, 50)
    g = Graph().add_edges_from(*zip(*edges, strict=True))
    (tmp_path / "c").write_text("".join(f"{v} 1\n" for v in [*range(6), *range(10, 16)]) + "".join(f"{v}\t2\n" for v in range(30, 36)) + "".join(f"{v} 3\n" for v in range(50, 55)) + "bad\n999 3\n50 3\n")
    n = skein.well_connected_components(g, str(tmp_path / "c"), str(tmp_path / "out"), "res", "log2", pre_filter_min_size=3, post_filter_min_size=3)
    got = skein.read_clusters(spark, str(tmp_path / "out/res"))
    groups = sorted(sorted(r.ids) for r in got.groupBy("cluster").agg(F.collect_list("id").alias("ids")).collect())
    assert n == 3 and groups == [list(range(6)), list(range(10, 16)), list(range(50, 55))]
    assert sorted(r.cluster for r in got.select("cluster").distinct().collect()) == [0, 1, 2]


# --- sketches and sequences


def test_sketches(spark, tmp_path):
    r = random.Random(6)
    lines = [(r.randrange(90), r.randrange(90)) for _ in range(600)]
    (tmp_path / "s").write_text("".join(f"{a} {b}\n" for a, b in lines))
    stream = skein.read_stream(str(tmp_path / "s"))
    want = {}
    for i, (a, b) in enumerate(lines):
        a, b = a % 45, b % 45
        want[i % 300] = ((a + 1) % 45 if a == b else a, b)
    assert {x.slot: (x.src, x.dst) for x in skein.sketch(stream, 300, 45).collect()} == want
    near = {v: set() for v in range(45)}
    for a, b in want.values():
        near[a].add(b)
        near[b].add(a)
    tri = sum(1 for a, b, c in itertools.combinations(range(45), 3) if b in near[a] and c in near[a] and c in near[b])
    assert skein.stream_tri_cnt(stream, 600, 90, 2) == tri
    assert skein.stream_pl_tri_cnt(stream, 600, 90, 1, 0) >= 0


def test_suffix_arrays(spark):
    rows = [(0, "banana"), (1, "yabbadabbado"), (2, ""), (3, "aaaa"), (4, None), (5, "banana\0")]
    df = spark.createDataFrame(rows, "row long, text string").withColumn("sa", skein.suffix_array("text"))
    got = {r.row: list(r.sa) for r in df.collect()}
    assert got[0] == [6, 5, 3, 1, 0, 4, 2] == got[5] and got[1] == [12, 1, 6, 4, 9, 3, 8, 2, 7, 5, 10, 11, 0] and got[2] == [0] == got[4]
    lcp = {r.row: list(r.l) for r in df.withColumn("l", skein.lcp_array("text", "sa")).collect()}
    assert lcp[0] == [0, 0, 1, 3, 0, 0, 2] and lcp[3] == [0, 0, 1, 2, 3]


def test_lcs_is_longest(spark):
    from skein.functions.sequences import longest_common

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    def inside(s, t):
        it = iter(t)
        return all(c in it for c in s)

    r = random.Random(1)
    for _ in range(60):
        a, b = ("".join(r.choice("abcé") for _ in range(r.randrange(12))) for _ in range(2))
        c = longest_common(a, b)
        assert len(c) == length(a, b) and inside(c, a) and inside(c, b)
    assert longest_common(None, "a") == ""
    assert spark.range(1).select(skein.lcs(F.lit("ABCBDAB"), F.lit("BDCABA")).alias("c")).first().c is not None


def test_arrays_of_numbers(spark, tmp_path):
    s = skein.SArrays(spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, []), (3, [1, 2])], "row long, values array<int>"))
    t = skein.SArrays(spark.createDataFrame([(0, [1, 2]), (1, [4]), (2, []), (3, [3])], "row long, values array<int>"))
    flags = lambda df: [r.result for r in df.orderBy("row").collect()]
    assert flags(s == t) == [True, False, True, False] and flags(s != t) == [False, True, False, True]
    assert flags(s == [1, 2]) == [True, False, False, True]
    assert flags(s.in1d(t)) == [True, True, True, True] and flags(t.in1d(s, invert=True)) == [False, True, False, False]
    assert s[1].to_list() == [[3]] and s[1:3].to_list() == [[3], []] and s[-1:].to_list() == [[1, 2]] and s[[0, 2]].to_list() == [[1, 2], []]
    assert s[F.size("values") > 1].info() == {"rows": 2, "values": 4}
    assert [r.length for r in s.get_lengths().orderBy("row").collect()] == [2, 1, 0, 2]
    s.save(str(tmp_path / "s"))
    s.register("some_arrays")
    assert skein.SArrays.attach("some_arrays").to_list() == s.to_list()
    s.unregister("some_arrays")
