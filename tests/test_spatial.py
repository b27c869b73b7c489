"""Hand-computed and simulated cases of graphs, enrichment and quotients."""

from __future__ import annotations

import math
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from colocus.operators import coloc, graph
from colocus.operators.cohort import crosstab
from colocus.plans import QUERIES


def points(spark, xy, classes, image=0):
    return spark.createDataFrame([(image, i, float(x), float(y), None if c is None else int(c)) for i, ((x, y), c) in enumerate(zip(xy, classes, strict=True))], "image long, cell_id long, x double, y double, class long")


def test_path_graph_moments(spark):
    cells = points(spark, [(i, 0) for i in range(4)], [0, 0, 1, 1])
    pairs = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3)], "image long, i long, j long")
    got = {(r.a, r.b): r for r in coloc.enrichment(cells, pairs, least=1).collect()}
    assert got[0, 1].observed == got[0, 0].observed == got[1, 1].observed == 1
    assert got[0, 1].mean == pytest.approx(2) and got[0, 1].var == pytest.approx(4 / 6)
    assert got[0, 1].z == pytest.approx(-1.2247, abs=1e-4)
    assert got[0, 0].mean == pytest.approx(0.5)
    assert all(r.z is None for r in coloc.enrichment(cells, pairs).collect())


def test_undirected_edges(spark):
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 2, 1)], "image long, src long, dst long")
    assert sorted((r.i, r.j) for r in graph.undirected(edges).collect()) == [(0, 1), (1, 2)]


def test_all_neighbour_forms_agree(spark):
    rng = np.random.default_rng(4)
    xy = np.round(rng.random((400, 2)) ** 3 * 50, 1)
    xy[:20] = xy[0]
    cells = points(spark, xy, rng.integers(0, 3, 400))
    key = lambda df: sorted((r.src, r.rank, r.dst) for r in df.collect())
    want = key(graph.knn(cells, 7))
    assert len(want) == 2800
    assert key(graph.knn_grouped(cells, 7)) == want
    assert key(graph.knn_grid(cells, 7)) == want
    for per_tile in (1000, 40, 3):
        assert key(graph.knn_tiled(cells, 7, per_tile)) == want
    assert len(graph.knn(points(spark, [(0, 0), (1, 1)], [0, 1]), 5).collect()) == 2


def _empty_circles(xy: np.ndarray) -> set[tuple[int, int]]:
    """Edges of the triangles whose circle holds no other point, by trying all of them in fractions."""
    points, out = [(Fraction(x), Fraction(y)) for x, y in xy.tolist()], set()

    def outside(a, b, c, p):
        m = [(q[0] - p[0], q[1] - p[1]) for q in (a, b, c)]
        n = [u * u + v * v for u, v in m]
        return sum(n[i] * (m[(i + 1) % 3][0] * m[(i + 2) % 3][1] - m[(i + 1) % 3][1] * m[(i + 2) % 3][0]) for i in range(3)) <= 0

    for i, j, k in combinations(range(len(points)), 3):
        a, b, c = points[i], points[j], points[k]
        area = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        if area < 0:
            b, c = c, b
        if area and all(outside(a, b, c, p) for m, p in enumerate(points) if m not in (i, j, k)):
            out |= {(i, j), (j, k), (i, k)}
    return out


def test_delaunay_tiles_against_all_triangles(spark):
    rng = np.random.default_rng(6)
    images = [rng.random((45, 2)), rng.random((45, 2)) ** 4 * 1e6, np.c_[rng.random(40), rng.random(40) * 1e-3]]
    rows = [(image, i, float(x), float(y)) for image, xy in enumerate(images) for i, (x, y) in enumerate(xy)]
    cells = spark.createDataFrame(rows, "image long, cell_id long, x double, y double")
    want = sorted((image, i, j) for image, xy in enumerate(images) for i, j in _empty_circles(xy))
    for per_tile in (1000, 12, 2):
        assert sorted((r.image, r.i, r.j) for r in graph.delaunay(cells, None, per_tile).collect()) == want
    short = graph.delaunay(cells, 0.2, 12).collect()
    assert 0 < len(short) < len(want) and max(r.dist for r in short) <= 0.2


def test_delaunay_of_odd_images(spark):
    """Lines, a lattice and a circle (ties everywhere), coincident cells across tiles, a clump, cells without coordinates: the tiles' width changes nothing."""
    rng = np.random.default_rng(9)
    turn = np.arange(60) * 2 * np.pi / 60
    lattice = [(i % 15 * 0.1, i // 15 * 0.1) for i in range(225)]
    images = [[(0, 0)], [(0, 0), (5, 5)], [(1, 1)] * 9, [(i * 0.5, i * 1.5) for i in range(50)], [(3, i) for i in range(50)], lattice + lattice[::7],
              np.c_[np.cos(turn), np.sin(turn)], np.r_[rng.normal(size=(200, 2)) * 0.01, rng.random((9, 2)) * 90], [(0, 0), (1, 0), (0, float("nan")), (float("inf"), 1), (None, 2)]]
    rows = [(image, i, None if x is None else float(x), float(y)) for image, xy in enumerate(images) for i, (x, y) in enumerate(xy)]
    cells = spark.createDataFrame(rows, "image long, cell_id long, x double, y double")
    got = [sorted(map(tuple, graph.delaunay(cells, None, per_tile).collect())) for per_tile in (10_000, 20, 4)]
    assert got[0] == got[1] == got[2]
    count = Counter(r[0] for r in got[0])
    assert [count[i] for i in range(5)] == [0, 1, 8, 49, 49] and count[8] == 1
    assert count[5] == 3 * 225 - 3 - 4 * 14 + len(lattice[::7])  # a full triangulation: no two sides cross, none is missing
    assert count[6] == 2 * 60 - 3
    assert {r[1:3] for r in got[0] if r[0] == 2} == {(0, i) for i in range(1, 9)}
    assert graph.delaunay(cells.limit(0)).count() == 0


def test_later_rounds_take_few_cells(spark):
    """After the first round all but the cells near the hull are done, so that the last tile stays small."""
    rng = np.random.default_rng(3)
    x, y = rng.random((2, 20_000))
    inside = (x > 0.4) & (x < 0.6) & (y > 0.4) & (y < 0.6)
    _, _, done = graph.tile_sides(x[inside], y[inside], (0.4, 0.4, 0.6, 0.6))
    core = (x[inside] > 0.45) & (x[inside] < 0.55) & (y[inside] > 0.45) & (y[inside] < 0.55)
    assert done[core].all() and not done.all()


def test_tiles_of_odd_images(spark):
    """Lone cells, pairs, coincident cells, a lattice full of ties and a clump far from the rest, in images of their own."""
    rng = np.random.default_rng(8)
    clump = np.r_[rng.normal(size=(150, 2)) * 0.01, rng.random((9, 2)) * 90]
    images = [[(0, 0)], [(0, 0), (5, 5)], [(1, 1)] * 40, [(i % 12, i // 12) for i in range(144)], clump]
    rows = [(image, i, float(x), float(y)) for image, xy in enumerate(images) for i, (x, y) in enumerate(xy)]
    cells = spark.createDataFrame(rows, "image long, cell_id long, x double, y double")
    key = lambda df: sorted(map(tuple, df.collect()))
    for k, per_tile in ((1, 10), (8, 10), (20, 50)):
        assert key(graph.knn_tiled(cells, k, per_tile)) == key(graph.knn(cells, k))
    assert graph.knn_tiled(cells.limit(0), 3).count() == 0


def test_halves_and_checkerboard(spark):
    xy = [(x, y) for x in range(20) for y in range(20)]
    for name, classes in {"halves": [int(x >= 10) for x, _ in xy], "board": [(x + y) % 2 for x, y in xy]}.items():
        cells = points(spark, xy, classes)
        edges = graph.knn(cells, 4)
        pairs = graph.undirected(edges)
        z = {(r.a, r.b): r.z for r in coloc.enrichment(cells, pairs).collect()}[0, 1]
        f = coloc.neighbour_fraction(cells, edges, [0], [1]).first().fraction
        m = coloc.mixing(cells, pairs, [0], [1]).first().mixing
        assert (z < -5 and f < 0.1 and m < 0.15) if name == "halves" else (z > 5 and f > 0.9 and m > 0.85)


def test_permutation_agrees_with_exact_moments(spark):
    rng = np.random.default_rng(1)
    cells = points(spark, rng.random((120, 2)), rng.choice(3, 120, p=[0.5, 0.3, 0.2]))
    pairs = graph.undirected(graph.knn(cells, 6))
    exact = {(r.a, r.b): r for r in coloc.enrichment(cells, pairs).collect()}
    for r in coloc.permuted_enrichment(cells, pairs, 2000, 5).collect():
        e = exact[r.a, r.b]
        assert abs(r.perm_mean - e["mean"]) < 5 * math.sqrt(e["var"] / 2000) + 1e-9
        assert r.perm_sd == pytest.approx(math.sqrt(e["var"]), rel=0.1)
    again = coloc.permuted_enrichment(cells.repartition(7), pairs, 50, 5).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, coloc.permuted_enrichment(cells, pairs, 50, 5).collect()))


def test_quotients_of_pairs(spark):
    xy, classes = [], []
    for i, (a, b) in enumerate([(0, 1)] * 6 + [(0, 0)] * 2 + [(1, 1)] * 2):
        xy += [(100 * i, 0), (100 * i + 1, 0)]
        classes += [a, b]
    q = {(r.a, r.b): r.clq for r in coloc.clq(points(spark, xy, classes), [1]).collect()}
    assert q[0, 1] == pytest.approx((6 / 10) / (10 / 19)) and q[0, 0] == pytest.approx((4 / 10) / (9 / 19))
    assert q[1, 0] == pytest.approx(q[0, 1]) and q[1, 1] == pytest.approx(q[0, 0])


def test_random_labels_give_one_and_rare_classes_nothing(spark):
    rng = np.random.default_rng(8)
    classes = rng.choice(4, 800, p=[0.55, 0.2, 0.15, 0.1])
    classes[classes == 3] = 2
    classes[:4] = 3
    cells = points(spark, rng.random((800, 2)), classes)
    q = {(r.a, r.b): r.clq_k for r in coloc.clq(cells, [10]).collect()}
    assert all((v is None) == (3 in k) for k, v in q.items())
    assert abs(np.mean([v for v in q.values() if v is not None]) - 1) < 0.05
    perm = {(r.a, r.b): r for r in coloc.permuted_clq(cells, 10, 60, 3).collect()}
    for k, r in perm.items():
        assert (r.clq is None) == (3 in k)
        if r.clq is not None:
            assert r.clq / 10 == pytest.approx(q[k]) and abs(r.perm_mean / 10 - 1) < 0.05 and 0 < r.p_two_sided <= 1


def test_clustered_class_is_flagged(spark):
    rng = np.random.default_rng(2)
    xy = rng.random((600, 2))
    classes = np.where(np.hypot(*(xy - 0.5).T) < 0.2, 1, 0)
    r = next(r for r in coloc.permuted_clq(points(spark, xy, classes), 20, 60, 1).collect() if (r.a, r.b) == (1, 1))
    assert r.clq / 20 > 1.3 and r.p_two_sided < 0.05 and r.significant


def test_weighted_mean_and_counts(spark):
    rows = spark.createDataFrame([(1, 100, 1.0, None), (1, 300, 3.0, 5.0), (2, 50, None, None)], "patient long, n long, v double, w double")
    got = {r.patient: (r.v, r.w) for r in coloc.weighted_mean(rows, "patient", "n", ["v", "w"]).collect()}
    assert got == {1: (2.5, 5.0), 2: (None, None)}
    cells = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 2)], "patient long, class long")
    assert {tuple(r) for r in crosstab(cells, "patient", "class", [1, 2, 3]).collect()} == {(1, 2, 1, 0), (2, 0, 1, 0)}


def test_composition_ignores_unassigned(spark):
    cells = points(spark, [(0, 0), (1, 0), (2, 0), (3, 0)], [0, 1, None, 1])
    edges = graph.weighted(graph.symmetric(graph.knn(cells, 1)))
    rows = {r.cell_id: (r.share_0, r.share_1) for r in graph.neighbourhood_composition(cells, edges, [0, 1], "weight").collect()}
    assert rows[0] == (0.0, 1.0) and rows[3] == (0.0, 0.0)


def test_triangulation_is_empty_of_points():
    rng = np.random.default_rng(6)
    x, y = rng.random(40), rng.random(40)
    edges = {tuple(e) for e in graph.triangulation(x, y)}
    for i in range(40):
        for j in range(i + 1, 40):
            for k in range(j + 1, 40):
                a = 2 * ((x[j] - x[i]) * (y[k] - y[i]) - (y[j] - y[i]) * (x[k] - x[i]))
                b2, c2 = (x[j] - x[i]) ** 2 + (y[j] - y[i]) ** 2, (x[k] - x[i]) ** 2 + (y[k] - y[i]) ** 2
                u, v = ((y[k] - y[i]) * b2 - (y[j] - y[i]) * c2) / a, ((x[j] - x[i]) * c2 - (x[k] - x[i]) * b2) / a
                inside = (x - x[i] - u) ** 2 + (y - y[i] - v) ** 2 < (u * u + v * v) * (1 - 1e-9)
                if not inside.any():
                    assert {(i, j), (i, k), (j, k)} <= edges
    assert graph.triangulation(np.array([0.0, 0.0]), np.array([1.0, 1.0])).tolist() == [[0, 1]]


def test_weight_kinds(spark):
    edges = spark.createDataFrame([(0, 0, 1, 2.0)], "image long, src long, dst long, dist double")
    assert graph.weighted(edges, "inverse").first().weight == 0.5
    assert graph.weighted(edges, "gaussian", 2.0).first().weight == pytest.approx(math.exp(-0.5))
    with pytest.raises(ValueError):
        graph.weighted(edges, "gaussian")


def test_log_ratios_sum_to_zero(spark):
    n = spark.createDataFrame(pd.DataFrame({"k": [1, 1, 2], "c": ["a", "b", "a"], "n": [3, 0, 5]}))
    out = coloc.clr(coloc.full_grid(n, "k", "c", ["a", "b"], "n"), "k", "c", "n").toPandas()
    assert out.groupby("k").clr.sum().abs().max() < 1e-12 and len(out) == 4


def test_permutations_split_over_tasks_count_alike(spark):
    rng = np.random.default_rng(6)
    cells = points(spark, rng.random((60, 2)), rng.integers(0, 3, 60)).union(points(spark, [(0, 0)], [1], image=1))
    pairs = graph.undirected(graph.knn(cells, 4)).select("image", "i", "j").toDF("image", "p", "q")
    key = lambda task_edges: sorted(map(tuple, coloc.permuted_counts(cells, pairs, 10, 5, task_edges).collect()))
    whole = key(10**9)
    assert len(whole) == 10 * 9 + 10 and key(500) == whole and key(1) == whole


def test_grid_deals_pairs_out_and_bounds_copies(spark):
    """Tasks of few pairs, many cells at one place, and far ones: the same rows as all pairs."""
    rng = np.random.default_rng(3)
    rows = [(0, i, 1.0, 1.0) for i in range(150)] + [(0, 150 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 5, (120, 2)))] + [(1, 900, 0.0, 0.0), (1, 901, 1e6, 1.0), (2, 950, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "image long, cell_id long, x double, y double")
    want = sorted(map(tuple, graph.knn(df, 4).collect()))
    for pairs in (500, 10**9):
        assert sorted(map(tuple, graph.knn_grid(df, 4, task_pairs=pairs).collect())) == want


def test_edges_query_meets_tiles_not_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "knn", lambda *_: pytest.fail("all pairs"))
    assert QUERIES["b01_knn_edges"](spark, "/root/testdata/sf0.001").count() > 0
