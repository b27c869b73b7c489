"""Components of edge tables against brute force, and the rows that they take."""

from __future__ import annotations

import random

import pytest

from colocus.llm import components as module
from colocus.llm.common import shared_folder


def brute(edges):
    label = {x: x for e in edges if None not in e for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if None not in (a, b) and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def some(kind):
    pick = random.Random(kind)
    if kind == "loops, nulls and repeats":
        return [(1, 1), (2, 3), (3, 2), (2, 3), (3, 3), (None, 4), (5, None), (None, None), (-7, 3), (9, 9)]
    if kind == "none":
        return []
    if kind == "star":
        return [(50, i) for i in range(100)]
    if kind == "tree":
        return [(i, pick.randrange(i)) for i in range(1, 200)]
    return [(pick.randrange(200), pick.randrange(200)) for _ in range(120)]


@pytest.mark.parametrize("kind", ["loops, nulls and repeats", "none", "star", "tree", "sparse"])
def test_components_equal_brute_force(spark, kind):
    edges = some(kind)
    got = module.components(spark.createDataFrame(edges, "a long, b long"), shared_folder(spark, "components")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["label"] for r in got} == brute(edges)


@pytest.mark.parametrize("kind", ["path", "stars in a row"])
def test_rounds_shrink(spark, monkeypatch, kind):
    """All rounds together write a few times the number of nodes: edges whose ends are one are not met again."""
    n, written, saved = 3_000, [], module.saved
    edges = [(i, i + 1) for i in range(n)] if kind == "path" else [(i, i // 50 * 50 + 50) for i in range(n)]

    def counted(df, folder):
        df = saved(df, folder)
        written.append(df.count())
        return df

    monkeypatch.setattr(module, "saved", counted)
    got = module.components(spark.createDataFrame(edges, "a long, b long"), shared_folder(spark, "components"))
    assert got.filter("label = 0").count() == n + 1
    assert sum(written) < 7 * n
