"""Graphs, accessors, traversal and cohesion on drawn graphs against plain Python, and on graphs with published values."""

import itertools
import random
from collections import Counter, defaultdict

import pytest

import skein
from skein import DiGraph, Graph


def drawn(seed, n, m, first=0):
    """``m`` rows of edges between ``n`` vertices, some of them repeated, mirrored or loops."""
    r = random.Random(seed)
    rows = [(r.randrange(first, first + n), r.randrange(first, first + n)) for _ in range(m)]
    rows += [rows[0], rows[1], rows[2][::-1], rows[3][::-1], (first, first)]
    return [a for a, _ in rows], [b for _, b in rows]


# two clusters with a gap in the ids, a path apart, and a vertex that has nothing but a loop
SRC, DST = (x + y + z for x, y, z in zip(drawn(11, 9, 22), drawn(12, 6, 9, 40), ([70, 71, 90], [71, 72, 90]), strict=True))
WGT = [1 + i % 3 for i in range(len(SRC))]


@pytest.fixture(scope="module")
def mixed(spark):
    return Graph().add_edges_from(SRC, DST, WGT)


def near(src, dst):
    out = defaultdict(set)
    for a, b in zip(src, dst, strict=True):
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def corners(adjacency):
    """The triangles, each once."""
    return [(a, b, c) for a in adjacency for b in adjacency[a] for c in adjacency[b] if a < b < c and c in adjacency[a]]


def crossings(adjacency):
    """The number of cycles of four edges; each has two diagonals."""
    twice = sum(k * (k - 1) // 2 for a, b in itertools.combinations(adjacency, 2) for k in [len(adjacency[a] & adjacency[b])])
    return twice // 2


def peeled(adjacency):
    """(edge, truss number) by removing edges with too few triangles for one k after the other."""
    left, out, k = {v: set(n) for v, n in adjacency.items()}, {}, 2
    while any(left.values()):
        weak = [(a, b) for a in left for b in left[a] if a < b and len(left[a] & left[b]) < k - 1]
        for a, b in weak:
            out[a, b] = k
            left[a].discard(b)
            left[b].discard(a)
        k += not weak
    return out


def layers(adjacency, source):
    depth, todo = {source: 0}, [source]
    for v in todo:
        for u in adjacency[v]:
            if u not in depth:
                depth[u] = depth[v] + 1
                todo.append(u)
    return depth


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_counts_and_edges(mixed):
    adjacency = near(SRC, DST)
    n, m = len(adjacency), sum(map(len, adjacency.values())) // 2
    assert (len(mixed), mixed.size(), mixed.edges().count()) == (n, m, 2 * m)
    assert mixed.density() == pytest.approx(2 * m / (n * (n - 1)))
    assert sorted(r.id for r in mixed.nodes().collect()) == sorted(adjacency)
    ranks = as_dict(mixed.ranked_nodes(), "id", "vid")
    assert ranks == {v: i for i, v in enumerate(sorted(adjacency))}
    weight = Counter()
    for a, b, w in zip(SRC, DST, WGT, strict=True):
        if a != b:
            weight[a, b] += w
            weight[b, a] += w
    assert {(r.src, r.dst): r.weight for r in mixed.edges().collect()} == weight


def test_degrees_with_and_without_loops(mixed, spark):
    assert as_dict(mixed.degree(), "id", "degree") == {v: len(n) for v, n in near(SRC, DST).items()}
    looped = Graph().add_edges_from(SRC, DST, no_self_loops=False)
    loops = {a for a, b in zip(SRC, DST, strict=True) if a == b}
    assert (len(looped), looped.size()) == (len({*SRC, *DST}), len({frozenset(e) for e in zip(SRC, DST, strict=True)}))
    assert 90 in loops and as_dict(looped.degree(), "id", "degree")[90] == 2
    di = DiGraph().add_edges_from(SRC, DST)
    edges = {(a, b) for a, b in zip(SRC, DST, strict=True) if a != b}
    assert di.size() == len(edges)
    assert as_dict(di.out_degree(), "id", "out_degree") == {v: sum(a == v for a, _ in edges) for v in near(SRC, DST)}
    assert as_dict(di.in_degree(), "id", "in_degree") == {v: sum(b == v for _, b in edges) for v in near(SRC, DST)}
    assert as_dict(di.degree(), "id", "degree") == {v: sum(v in e for e in edges) for v in near(SRC, DST)}


def test_input_checks(spark):
    with pytest.raises(TypeError):
        Graph().add_edges_from(spark.createDataFrame([("a", 1)], "src string, dst long"))
    with pytest.raises(ValueError):
        Graph().add_edges_from([1, 2], [3])
    with pytest.raises(ValueError):
        DiGraph().add_edges_from([1], [2], generate_reversed_arrays=True)
    for f in (skein.count_triangles, skein.connected_components, skein.diameter, skein.squares, skein.jaccard, skein.truss_decomposition, skein.triangle_centrality):
        with pytest.raises(ValueError):
            f(DiGraph().add_edges_from([1], [2]))


def test_stored_arrays(mixed):
    ids = sorted(near(SRC, DST))
    degree = [len(near(SRC, DST)[v]) for v in ids]
    assert as_dict(mixed.graph_query("neighbour"), "vid", "neighbour") == dict(enumerate(degree))
    assert as_dict(mixed.graph_query("start_i"), "vid", "start_i") == {i: sum(degree[:i]) for i in range(len(ids))}
    assert mixed.graph_query("e_weight").count() == mixed.graph_query("srcR").count() == sum(degree)
    with pytest.raises(ValueError):
        mixed.graph_query("nothing")


@pytest.mark.parametrize("source", [2, 71])
def test_layers(mixed, source):
    want = layers(near(SRC, DST), source)
    got = as_dict(skein.bfs_layers(mixed, source), "id", "depth")
    assert got == {v: want.get(v, -1) for v in near(SRC, DST)}


def test_directed_layers_and_unknown_source(mixed):
    path = skein.path_graph(12, DiGraph)
    assert as_dict(skein.bfs_layers(path, 3), "id", "depth") == {i: i - 3 if i >= 3 else -1 for i in range(12)}
    with pytest.raises(ValueError, match="Source vertex not found"):
        skein.bfs_layers(mixed, 90)


def test_components_and_diameter(spark):
    """Three trees drawn by parents, far apart in ids."""
    r = random.Random(21)
    trees = [[(base + r.randrange(max(0, i - 3), i), base + i) for i in range(1, n)] for base, n in ((30, 12), (3, 5), (100, 7))]
    src, dst = zip(*itertools.chain(*trees), strict=True)
    g, adjacency = Graph().add_edges_from(list(src), list(dst)), near(src, dst)
    ids = sorted(adjacency)
    want = {v: ids.index(min(e for t in trees if any(v in e for e in t) for x in t for e in x)) for v in ids}
    assert {r.id: r.label for r in skein.connected_components(g).collect()} == want
    assert skein.count_components(g) == 3
    longest = max(max(layers(adjacency, v).values()) for v in ids)
    assert skein.diameter(g) == longest and skein.diameter(g, reference_compatible=True) == longest - 1
    assert skein.diameter_of(g, exact_limit=5).value == longest


def test_diameter_of_components_over_the_limit(spark):
    """Here a double sweep from the smallest vertex ends at 4; another component is a cycle, whose vertices are all alike."""
    ends = [(0, 1), (0, 9), (1, 2), (1, 3), (1, 4), (1, 8), (2, 7), (4, 5), (4, 8), (5, 6), (6, 9)]
    g = Graph().add_edges_from(*map(list, zip(*ends, strict=True)))
    assert skein.diameter_of(g, exact_limit=3) == skein.diameter_of(g) and skein.diameter(g, exact_limit=3) == 5
    ends += [(20 + k, 20 + (k + 1) % 9) for k in range(9)] + [(40, 41)]
    both = Graph().add_edges_from(*map(list, zip(*ends, strict=True)))
    found = skein.diameter_of(both, exact_limit=3)
    assert (found.value, found.exact) == (5, True)


def test_triangles_and_squares(mixed):
    adjacency = near(SRC, DST)
    found = corners(adjacency)
    assert found and skein.triangles(mixed) == 3 * len(found) and skein.squares(mixed) == crossings(adjacency) > 0
    asked = [*sorted(adjacency)[:5], 71, 999]
    assert as_dict(skein.triangles(mixed, asked), "id", "triangles") == {v: sum(v in t for t in found) for v in asked if v in adjacency}


def test_triangle_centrality(spark):
    src, dst = drawn(31, 12, 30)
    adjacency, g = near(src, dst), Graph().add_edges_from(src, dst)
    found = corners(adjacency)
    at = Counter(itertools.chain(*found))
    close = {(a, b) for t in found for a, b in itertools.permutations(t, 2)}
    got = as_dict(skein.triangle_centrality(g), "id", "centrality")
    for v in adjacency:
        inner = at[v] + sum(at[u] for u in adjacency[v] if (v, u) in close)
        outer = sum(at[u] for u in adjacency[v] if (v, u) not in close)
        assert got[v] == pytest.approx((inner / 3 + outer) / len(found))
    assert set(as_dict(skein.triangle_centrality(skein.path_graph(5, Graph)), "id", "centrality").values()) == {0.0}


def test_trusses(spark):
    src, dst = drawn(41, 8, 24)
    src, dst = [*src, 5, 20, 21], [*dst, 20, 21, 22]  # and a tail without triangles
    want, g = peeled(near(src, dst)), Graph().add_edges_from(src, dst)
    got = {(r.src, r.dst): r.truss for r in skein.truss_decomposition(g).collect()}
    assert got == want and len(set(want.values())) > 2
    most = max(want.values())
    assert skein.max_truss(g) == most
    for k in (3, most, most + 1):
        assert {(r.src, r.dst): r.value for r in skein.k_truss(g, k).collect()} == {e: -1 if t >= k else k - 1 for e, t in want.items()}
    assert skein.max_truss(skein.path_graph(4, Graph)) == 2


@pytest.fixture(scope="module")
def karate(spark):
    return skein.karate_club_graph(Graph)


def test_karate(karate):
    assert (len(karate), karate.size(), skein.count_triangles(karate), skein.squares(karate), skein.diameter(karate)) == (34, 78, 45, 154, 5)
    assert sorted(as_dict(skein.bfs_layers(karate, 0), "id", "depth").values()) == [0] + [1] * 16 + [2] * 9 + [3] * 8
    counts = {r.truss: r["count"] for r in skein.truss_decomposition(karate).groupBy("truss").count().collect()}
    assert counts == {2: 11, 3: 42, 4: 11, 5: 14} and skein.max_truss(karate) == 5
    top = skein.triangle_centrality(karate).orderBy("centrality", ascending=False).limit(3).collect()
    assert [(r.id, round(r.centrality, 6)) for r in top] == [(13, 0.755556), (0, 0.674074), (31, 0.651852)]
    similar = {(r.u, r.v): r.jaccard for r in skein.jaccard(karate).collect()}
    assert len(similar) == 332 and similar[0, 1] == pytest.approx(0.388889, abs=1e-6) and similar[32, 33] == pytest.approx(0.526316, abs=1e-6)


def test_generators(spark):
    complete = skein.complete_graph(10, Graph)
    assert (len(complete), complete.size(), skein.complete_graph(10, DiGraph).size()) == (10, 45, 90)
    assert skein.path_graph(10, Graph).size() == 9
    tree = skein.random_tree(50, Graph, seed=1)
    assert (len(tree), tree.size(), skein.count_components(tree)) == (50, 49, 1)
    rmat = skein.rmat_graph(7, Graph, edge_factor=8, seed=3)
    again = skein.rmat_graph(7, Graph, edge_factor=8, seed=3)
    assert len(rmat) <= 128 and sorted(rmat.edges().collect()) == sorted(again.edges().collect())
    degrees = sorted(as_dict(rmat.degree(), "id", "degree").values())
    assert degrees[-1] > 3 * degrees[len(degrees) // 2]  # skewed
    assert skein.rmat_gen(5, 4, 0.4, seed=1).size() > 0
    gnp = skein.gnp_random_graph(60, 0.1, DiGraph, seed=5)
    assert 250 < gnp.size() < 460
    assert 120 < skein.gnp_random_graph(60, 0.1, Graph, seed=5, each_pair_once=True).size() < 240
    ring = skein.watts_strogatz_graph(30, 4, 0.0, Graph, seed=1)
    assert ring.size() == 60 and set(as_dict(ring.degree(), "id", "degree").values()) == {4}
    assert skein.watts_strogatz_graph(30, 4, 0.5, DiGraph, seed=1).size() > 60
    ba = skein.barabasi_albert_graph(80, 3, Graph, seed=1)
    assert len(ba) == 80 and skein.count_components(ba) == 1
    for bad in (lambda: skein.rmat_graph(4, Graph, p=(1, 1, 1, 1)), lambda: skein.gnp_random_graph(3, 1.5, Graph), lambda: skein.watts_strogatz_graph(3, 4, 0.1, Graph), lambda: skein.barabasi_albert_graph(3, 3, Graph), lambda: skein.empty_graph(int)):
        with pytest.raises(ValueError):
            bad()


def test_the_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F

    from skein.generators import _shuffled

    for bits in (1, 2, 5, 9):
        n = 1 << bits
        assert spark.range(n).select(_shuffled(F.col("id"), bits, 7).alias("x")).distinct().agg(F.min("x"), F.max("x"), F.count("x")).first()[:] == (0, n - 1, n)


def test_two_vertex_random_graphs(spark):
    allowed = [set(c) for r in range(5) for c in itertools.combinations([(0, 0), (0, 1), (1, 0), (1, 1)], r)]
    for g in (skein.gnp_random_graph(2, 0.5, DiGraph, seed=2), skein.watts_strogatz_graph(2, 2, 0.5, DiGraph, seed=2), skein.random_tree(2, DiGraph, seed=2), skein.barabasi_albert_graph(2, 1, DiGraph, seed=2)):
        assert {(r.src, r.dst) for r in g.edges().collect()} in allowed
