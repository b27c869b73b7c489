"""Typing over tables against typing of one image after the other."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from colocus.operators import celltype as T
from colocus.operators import lineage as L
from colocus.operators import mixture as M
from tests.test_typing import _band

TREE = T.Signature((T.Kind("A", {"a": 1, "b": 0}), T.Kind("B", {"a": 0, "b": 1}), T.Kind("A1", {"c": 1}, 2, "A"), T.Kind("A2", {"c": 0}, 2, "A")))


def images(seed):
    """A blurred band, a scatter with two lineages, a lone cell, an image of artefacts and one without anchors."""
    rng = np.random.default_rng(seed)
    x, y, ep, _, _ = _band()
    yield 0, x, y, np.c_[ep, rng.random(len(x))]
    n = 300
    kind = rng.integers(0, 4, n)
    base = np.stack([np.where(kind < 2, 0.9, 0.1), np.where(kind < 2, 0.1, 0.9), np.where(kind == 0, 0.9, 0.1)], axis=1)
    yield 1, rng.random(n) * 200, rng.random(n) * 200, np.clip(base + rng.normal(size=(n, 3)) * 0.2, 0, 1)
    yield 2, np.zeros(1), np.zeros(1), np.array([[0.9, 0.1, 0.5]])
    yield 3, np.arange(9.0), np.zeros(9), np.full((9, 3), 0.95)
    yield 4, np.arange(30.0), np.arange(30.0), np.full((30, 3), 0.5)


def tables(spark, made, markers):
    cells = pd.concat([pd.DataFrame({"image": i, "cell_id": np.arange(len(x)) * 3, "x": x, "y": y}) for i, x, y, _ in made])
    long = pd.concat([pd.DataFrame({"image": i, "cell_id": np.arange(len(x)) * 3, "marker": m, "ep": ep[:, k]}) for i, x, _, ep in made for k, m in enumerate(markers)])
    return spark.createDataFrame(cells), spark.createDataFrame(long)


@pytest.mark.parametrize("config", [
    M.TypingConfig(artefact=(0.9, 0.05), bandwidth=30.0, neighbours=6),
    M.TypingConfig(artefact=None, bandwidth=12.0, iterations=4, least_change=0.0, anchor=(0.8, 0.3), index=(0.4, 0.7)),
    M.TypingConfig(artefact=(0.9, 0.05), iterations=1),
    M.TypingConfig(artefact=(0.9, 0.05), factor=0.0, of_class=(("A1", (0.95, 0.5, 0.6, 0.5)),)),
])
def test_tables_type_as_single_images_do(spark, config):
    made = list(images(11))
    typed, records = L.type_tables(*tables(spark, made, TREE.markers), TREE, config)
    got = typed.toPandas().sort_values(["image", "cell_id"])
    rounds = {(r.image, r.round): r.asDict() for r in records.collect()}
    assert len(rounds) == 2 * len(made)
    for i, x, y, ep in made:
        label, anchor, artefact, alone, want = M.type_image(np.arange(len(x)), x, y, ep, TREE, config)
        own = got[got.image == i]
        assert own.label.tolist() == label.tolist() and own.anchor.tolist() == anchor.tolist()
        assert own.artefact.tolist() == artefact.tolist() and own.marker_only.tolist() == alone.tolist()
        for w in want:
            assert rounds[i, w["round"]] == w | {"image": i}


def test_large_images_go_over_tables(spark):
    made = list(images(3))[:2]
    cells, ep = tables(spark, made, TREE.markers)
    config = M.TypingConfig(bandwidth=30.0)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(M.type_cells(cells, ep, TREE, config))
    assert rows(L.type_cells(cells, ep, TREE, config, most_cells=400)) == want
    assert rows(L.type_cells(cells, ep, TREE, config)) == want


def test_a_missing_marker_is_an_error(spark):
    cells, ep = tables(spark, list(images(1))[2:3], TREE.markers)
    with pytest.raises(Exception, match="marker of the signature is missing"):
        L.type_tables(cells, ep.filter("marker <> 'c'"), TREE)


def test_no_cells(spark):
    cells, ep = tables(spark, list(images(1))[2:3], TREE.markers)
    typed, records = L.type_tables(cells.limit(0), ep, TREE)
    assert typed.count() == 0 and records.count() == 0


@pytest.mark.parametrize("bandwidth", [0.01, 0.3, 50.0])
def test_distances_within_any_bandwidth(spark, monkeypatch, bandwidth):
    """A bandwidth as wide as an image brought all of its settled cells, four times over, to tasks that held them whole."""
    monkeypatch.setattr(L, "SQUARE", 32)
    rng = np.random.default_rng(5)
    n = 20_000
    made = pd.DataFrame({"image": rng.integers(0, 2, n), "cell_id": np.arange(n), "x": rng.random(n), "y": rng.random(n), "kind": rng.integers(0, 4, n)})
    made.loc[made.kind == 2, "kind"] = 3
    made.loc[(made.x > 0.8) & (made.kind == 1), "kind"] = 2  # one class in a corner, far from most
    cells = L.in_squares(spark.createDataFrame(made)).localCheckpoint()
    open_, settled = cells.filter("kind = 3"), cells.filter("kind < 3")
    most = L.met(open_, settled, bandwidth).groupBy("image", "tx", "ty").count().agg({"count": "max"}).first()[0]
    assert most < (made.image == 0).sum() * 0.2
    got = L.distances(open_, settled, bandwidth, 3).toPandas().set_index("cell_id")
    heard = 0
    for image in (0, 1):
        own = made[made.image == image]
        rest = own[own.kind == 3]
        gap = np.full((len(rest), 3), np.nan)
        for k in range(3):
            at = own[own.kind == k]
            dx, dy = rest.x.to_numpy()[:, None] - at.x.to_numpy(), rest.y.to_numpy()[:, None] - at.y.to_numpy()
            d = np.sqrt((dx * dx + dy * dy).min(axis=1))
            gap[:, k] = np.where(d < bandwidth, d, np.nan)
        want = pd.DataFrame(gap, index=rest.cell_id)[~np.isnan(gap).all(axis=1)]
        heard += len(want)
        assert np.array_equal(got.loc[want.index].filter(like="near_").to_numpy(float), want.to_numpy(), equal_nan=True)
    assert len(got) == heard
