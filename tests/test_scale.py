"""What the graph operators move, and how their steps are bounded, on graphs with hubs."""

import math
import random

import pytest

from skein import DiGraph, Graph
from skein.operators import cohesion, matching


def moved(spark, work):
    """The result of ``work`` and the rows that its stages sent through shuffles."""
    context = spark.sparkContext._jsc.sc()

    def rows():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = rows()
    return work(), rows() - before


def hub_edges(n):
    """n edges into a vertex and n out of it, and one that closes a loop of three."""
    return [*range(1, n + 1), *[0] * n, n + 1], [*[0] * n, *range(n + 1, 2 * n + 1), 1]


@pytest.mark.parametrize("induced", [True, False])
def test_loops_make_no_row_for_each_path(spark, induced):
    graph, loop = DiGraph().add_edges_from(*hub_edges(300)), DiGraph().add_edges_from([0, 1, 2], [1, 2, 0])
    find = matching.subgraph_isomorphism if induced else matching.subgraph_monomorphism
    found, rows = moved(spark, lambda: find(graph, loop, return_isos_as="count"))
    assert found == 3 and rows < 30_000  # 90,000 paths go through the hub


def test_patterns_around_three_joined_vertices(spark):
    """Against plain search, with edges both ways and a tail, induced or not."""
    import itertools

    r = random.Random(4)
    host = {(a, b) for a in range(9) for b in range(9) if a != b and r.random() < 0.35}
    graph = DiGraph().add_edges_from(*map(list, zip(*host, strict=True)))
    for pattern in ([(0, 1), (1, 2), (2, 0)], [(0, 1), (1, 0), (1, 2), (2, 0), (0, 3)], [(1, 0), (1, 2), (0, 2), (2, 3), (3, 1)]):
        n = 1 + max(map(max, pattern))
        small = DiGraph().add_edges_from(*map(list, zip(*pattern, strict=True)))
        for induced in (True, False):
            fits = lambda m: all(((m[a], m[b]) in host) if (a, b) in pattern else not (induced and (m[a], m[b]) in host) for a, b in itertools.permutations(range(n), 2))  # noqa: B023, E731
            want = sorted(m for m in itertools.permutations(range(9), n) if fits(m))
            assert sorted(map(tuple, matching.match_table(graph, small, induced).collect())) == want


def test_triads_share_one_list_of_triangles(spark):
    graph = DiGraph().add_edges_from(*hub_edges(300))
    matching.match_table(graph, DiGraph().add_edges_from([0, 1, 2], [1, 2, 0])).count()
    assert "corners" in graph.__dict__ and graph.corners.count() == 1


def test_triangles_make_no_row_for_each_path(spark):
    """Every vertex has the same degree, so the order by degree spares nothing."""
    n = 40
    graph = Graph().add_edges_from(*map(list, zip(*((a, n + b) for a in range(n) for b in range(n)), strict=True)))
    found, rows = moved(spark, lambda: cohesion.count_triangles(graph))
    assert found == 0 and rows < 20_000


@pytest.mark.parametrize("threshold", [0.0, 0.4])
def test_jaccard_moves_lists_not_pairs(spark, threshold):
    n = 120  # neighbours of each of 10 vertices, which makes 71,400 pairs
    graph = Graph().add_edges_from(*map(list, zip(*((a, 1000 + b) for a in range(10) for b in range(n)), strict=True)))
    found, rows = moved(spark, lambda: cohesion.jaccard(graph, threshold).count())
    assert found == math.comb(n, 2) + math.comb(10, 2) and rows < 20_000


def test_jaccard_file_is_compressed_and_reads_back(spark, tmp_path):
    from skein.sources import files

    graph = Graph().add_edges_from([1, 1, 2, 3, 3], [2, 3, 3, 4, 5])
    want = cohesion.jaccard(graph)
    files.write_jaccard(want, str(tmp_path / "j"))
    assert not [p for p in (tmp_path / "j").iterdir() if p.name.startswith("part-") and not p.name.endswith(".gz")]
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "j")).collect()) == sorted(f"u={x.u},v={x.v},{x.jaccard}" for x in want.collect())


def test_squares_move_lists_not_paths(spark):
    n = 40
    graph = Graph().add_edges_from(*map(list, zip(*((a, n + b) for a in range(n) for b in range(n)), strict=True)))
    found, rows = moved(spark, lambda: cohesion.squares(graph))
    assert found == math.comb(n, 2) ** 2 and rows < 25_000


def longest_path(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    most = 0
    for v in near:
        seen, now, depth = {v}, {v}, 0
        while now := {b for a in now for b in near[a]} - seen:
            seen |= now
            depth += 1
        most = max(most, depth)
    return most


@pytest.mark.parametrize("limit", [20, 1000])
def test_diameter_where_bounds_exclude_nothing(spark, monkeypatch, limit):
    """Nearly all vertices have the same eccentricity; two such components, and one with a tail."""
    from skein.operators import traversal

    r = random.Random(6)
    edges = [(first + r.randrange(300), first + r.randrange(300)) for first in (0, 1000) for _ in range(1500)] + [(5, 2000), (2000, 2001)]
    edges = [(a, b) for a, b in edges if a != b]
    searches, own = [], traversal._levels
    monkeypatch.setattr(traversal, "_levels", lambda *a: searches.append(a) or own(*a))
    monkeypatch.setattr(traversal, "_WORDS", 2)
    monkeypatch.setattr(traversal, "_GATHERED", 64)
    assert traversal.diameter_of(Graph().add_edges_from(*map(list, zip(*edges, strict=True))), exact_limit=limit).value == longest_path(edges)
    assert len(searches) <= 3


def cut_plainly(adjacency, pre, post):
    """Every part cut by its smallest cut until that is above log2, as before parts without a result were dropped."""
    from skein.operators.communities import _components, _within, criterion, min_cut

    done, todo = [], [p for p in _components(adjacency) if len(p) > pre and any(adjacency[v] for v in p)]
    while todo:
        part = todo.pop()
        own = _within(adjacency, part)
        lone = min((v for v in part if len(own[v]) == 1), default=None)
        cut, side = (1, {lone}) if lone is not None else min_cut(own)
        if cut > criterion("log2", len(part)):
            done.append(part)
            continue
        todo += [h for h in (side, part - side) if len(h) > post and any(_within(own, h).values())]
    return done


def mutual(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def test_clusters_are_split_as_by_plain_cuts():
    from skein.operators.communities import split

    r, found = random.Random(8), 0
    for n, m in [(30, 5), (40, 6), (60, 8), (25, 25), (14, 14)] * 4:
        edges = {(a, -1 - r.randrange(m)) for a in range(n) for _ in range(r.randrange(1, 6))} | {tuple(r.sample(range(n), 2)) for _ in range(r.choice([0, n]))}
        for pre, post in ((3, 3), (10, 4)):
            want = sorted(map(sorted, cut_plainly(mutual(edges), pre, post)))
            assert sorted(map(sorted, split(mutual(edges), "log2", None, pre, post))) == want
            found += len(want)
    assert found > 10


def test_sparse_clusters_take_no_smallest_cut(monkeypatch):
    from skein.operators import communities

    r = random.Random(9)
    edges = {(a, -1 - r.randrange(250)) for a in range(3500) for _ in range(r.randrange(4))}
    dense = {(10_000 + a, 10_000 + b) for a in range(400) for b in r.sample(range(400), 20) if a != b}
    sizes, own = [], communities.min_cut
    monkeypatch.setattr(communities, "min_cut", lambda a: sizes.append(len(a)) or own(a))
    parts = communities.split(mutual(edges | dense | {(0, 10_000)}), "log2", None, 3, 3)
    assert [len(p) for p in parts] == [400] and max(sizes, default=0) <= communities._EXACT


def test_ordered_file_is_written_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from skein.sources import files

    head = spark.createDataFrame([(0, 0, 0, "%%MatrixMarket matrix coordinate real general"), (1, 0, 0, "3000 3001 3000")], "part int, a long, b long, line string")
    entries = spark.range(1, 3001, 1, 3).select(F.lit(2).alias("part"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.concat_ws(" ", "id", F.col("id") + 1, F.lit("2.5")).alias("line"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few lines are one part
    try:
        files.write_lines(head.unionByName(entries), str(tmp_path / "m"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    parts = sorted(p for p in (tmp_path / "m").iterdir() if p.name.startswith("part-"))
    lines = [x for p in parts for x in p.read_text().splitlines()]
    assert len(parts) > 1 and lines == ["%%MatrixMarket matrix coordinate real general", "3000 3001 3000", *(f"{i} {i + 1} 2.5" for i in range(1, 3001))]
    got = files.read_matrix_market_file(str(tmp_path / "m"), directed=True, only_edges=True)
    assert sorted(map(tuple, got.collect())) == [(i, i + 1, 2.5) for i in range(1, 3001)]
