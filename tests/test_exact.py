"""Results that must not depend on the order of rows."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from colocus.sources.tables import exact_mean


def test_means_of_halves_in_any_order(spark):
    """64 values of two digits often have a mean that ends in half a millionth."""
    rng = np.random.default_rng(4)
    cents = rng.integers(0, 20_000, (300, 64))
    rows = spark.createDataFrame([(u, float(c) / 100) for u, own in enumerate(cents.tolist()) for c in own], "u long, v double")
    want = {u: float((Decimal(int(own.sum())) / 6400).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for u, own in enumerate(cents)}
    for parts in (1, 7):
        assert {r.u: r.m for r in rows.repartition(parts, "v").groupBy("u").agg(exact_mean("v", 6).alias("m")).collect()} == want


def test_means_of_awkward_values(spark):
    rows = spark.createDataFrame([(0, None), (1, None), (1, 2.0), (1, -4.5), (2, float("nan")), (2, 1.0), (3, float("inf")), (4, 1e300), (4, 3.0), (5, 1e17), (5, 1e17)], "u long, v double")
    got = {r.u: r.m for r in rows.groupBy("u").agg(exact_mean("v", 6).alias("m")).collect()}
    assert got == {0: None, 1: -1.25, 2: pytest.approx(float("nan"), nan_ok=True), 3: float("inf"), 4: pytest.approx(5e299), 5: 1e17}
