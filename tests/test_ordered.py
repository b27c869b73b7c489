"""Running totals, ranks and quantiles by ranges against plain sorts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colocus.operators import ordered as O


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    n = 900
    g = rng.choice(["a", "b", None], n, p=[0.7, 0.2, 0.1])
    x = np.round(np.where(rng.random(n) < 0.3, 5.0, rng.normal(size=n) * 10), 1)
    return pd.DataFrame({"id": range(n), "g": g, "x": x, "w": rng.integers(0, 5, n)})


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("range_rows", [7, 120, 10_000])
@pytest.mark.parametrize("back", [False, True])
def test_running(spark, table, by, range_rows, back):
    df = spark.createDataFrame(table)
    sums = O.running(df, by, "x", {"upto": F.col("w")}, back, range_rows=range_rows).toPandas().set_index("id").upto
    mins = O.running(df, by, "x", {"least": F.col("w")}, back, True, range_rows).toPandas().set_index("id").least
    for _, own in table.groupby(by, dropna=False) if by else [(None, table)]:
        for r in own.itertuples():
            there = own.w[(own.x >= r.x) if back else (own.x <= r.x)]
            assert sums[r.id] == there.sum() and mins[r.id] == there.min()


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("range_rows", [9, 10_000])
def test_ranks_and_numbers(spark, table, by, range_rows):
    df = spark.createDataFrame(table)
    got = O.with_ranks(df, by, "x", "rank", range_rows).toPandas().set_index("id")["rank"]
    hashed = df.withColumn("h", F.md5(F.col("id").cast("string")))
    number = O.numbered_by(hashed, by, "h", "id", range_rows=range_rows).toPandas().set_index("id")
    for _, own in table.groupby(by, dropna=False) if by else [(None, table)]:
        assert (own.x.rank().to_numpy() == got.loc[own.id].to_numpy()).all()
        assert number.loc[own.id].sort_values("h")._number.tolist() == list(range(1, len(own) + 1))
    assert O.with_ranks(df.limit(0), by, "x", "rank").count() == 0 and O.running(df.limit(0), by, "x", {"s": F.col("w")}).count() == 0


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("buffer_rows", [1, 150, 10_000])
def test_quantiles(spark, table, by, buffer_rows, monkeypatch):
    monkeypatch.setattr(O, "BINS", 8)
    at = [0.0, 0.025, 0.5, 0.9, 1.0]
    rows = pd.concat([table, table.assign(x=None)[:50], pd.DataFrame({"id": [0, 1, 2], "g": "c", "x": [-1e300, 0.0, 1e300], "w": 0})] + ([pd.DataFrame({"id": [3], "g": ["d"], "x": [None], "w": [0]})] if by else []))
    df = spark.createDataFrame(rows.astype({"x": float})).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = {(r["g"] if by else None): r["q"] for r in O.exact_quantiles(df, by, "x", at, buffer_rows).collect()}
    groups = rows.astype({"x": float}).groupby(by, dropna=False) if by else [((None,), rows.astype({"x": float}))]
    seen = 0
    for k, own in groups:
        name = None if not by or (isinstance(k[0], float) and math.isnan(k[0])) else k[0]
        v = own.x.dropna()
        seen += 1
        if len(v):
            assert got[name] == pytest.approx(v.quantile(at).tolist(), rel=1e-12)
        else:
            assert got[name] is None
    assert seen == len(got)


def test_quantiles_of_many_close_values(spark):
    """Clumps far apart: the bins narrow down on the clump that holds the rank."""
    x = np.r_[1 + np.arange(400) * 1e-12, np.full(300, 7.0), 1e9 + np.arange(301)]
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    q = O.exact_quantiles(df, [], "x", [0.1, 0.3, 0.5, 0.8], 10).first().q
    assert q == np.quantile(x, [0.1, 0.3, 0.5, 0.8]).tolist()


def test_quantiles_of_large_groups_without_python(spark):
    """The ranks that are left go to executors as a table of the JVM, not through Python processes."""
    rows = spark.range(3000).select(F.col("id").cast("double").alias("x"), F.lit("a").alias("g"))
    found = O.exact_quantiles(rows, ["g"], "x", [0.5], 1000)
    assert found.collect()[0].q == [1499.5]
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
