"""Survival kernels, validation without leakage, association."""

from __future__ import annotations

import hashlib
import math
import time as clock
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colocus.functions import columns as C
from colocus.functions import special
from colocus.operators import assoc, evaluate as E
from colocus.operators import survival as S
from colocus.operators import validation as V
from colocus.operators.digests import Digests
from colocus.plans import QUERIES
from colocus.sources.files import scratch


def cohort(n=120, seed=0):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"id": np.arange(n), "age": rng.normal(60, 10, n), "er": rng.integers(0, 2, n).astype(float), "c1": rng.poisson(40, n) * 1.0, "c2": rng.poisson(30, n) * 1.0, "c3": rng.poisson(20, n) * 1.0, "s1": rng.normal(size=n), "s2": rng.normal(size=n)})
    rows.loc[rng.random(n) < 0.15, "age"] = np.nan
    rows.loc[rng.random(n) < 0.15, "s1"] = np.nan
    hazard = np.exp(0.9 * rows.s2 + 0.02 * (rows.age.fillna(60) - 60))
    t = rng.exponential(30 / hazard)
    rows["time"], rows["event"] = np.minimum(t, 40), t < 40
    return rows


FULL = S.FeatureSet("full", ("age", "er"), ("c1", "c2", "c3"), ("s1", "s2"))
QUICK = V.Settings(outer=3, inner=2, count=4, ratio=0.2)


def test_ridge_gradient_vanishes_and_shrinks():
    rows = cohort()
    x = np.c_[rows.s2, rows.er - rows.er.mean()]
    beta = S.ridge_cox(x, rows.time.to_numpy(), rows.event.to_numpy(), 2.0)
    assert np.abs(S.log_likelihood(x, rows.time.to_numpy(), rows.event.to_numpy(), beta)[1] - 2 * beta).max() < 1e-6
    assert np.abs(S.ridge_cox(x, rows.time.to_numpy(), rows.event.to_numpy(), 1e4)).max() < np.abs(beta).max() / 10


def test_elastic_net_conditions():
    rows = cohort()
    x = S.Preparation(FULL, rows[list(FULL.columns)].to_numpy())(rows[list(FULL.columns)].to_numpy())
    t, e, n = rows.time.to_numpy(), rows.event.to_numpy(), len(rows)
    alphas = S.penalties(x, t, e, 0.5, FULL.factor, 5)
    path = S.elastic_net_path(x, t, e, alphas, 0.5, FULL.factor)
    assert np.abs(path[2:, 0]).max() < 1e-6
    for a, b in zip(alphas, path.T, strict=True):
        g = S.log_likelihood(x, t, e, b)[1] / n - a * FULL.factor * 0.5 * b
        for j, f in enumerate(FULL.factor):
            assert abs(g[j]) <= a * 0.5 * f + 1e-6 if b[j] == 0 else g[j] == pytest.approx(a * 0.5 * f * np.sign(b[j]), abs=1e-6)
    none = S.elastic_net_path(x, t, e, np.array([0.3]), 0.0, np.ones(x.shape[1]))[:, 0]
    assert none == pytest.approx(S.ridge_cox(x, t, e, 0.3 * n), abs=1e-5)


def test_preparation_uses_training_rows_only():
    rows = cohort()
    f = S.FeatureSet("beyond", ("age",), ("c1", "c2", "c3"), ("s1", "s2"), True)
    x = rows[list(f.columns)].to_numpy()
    train, other = x[:80], x[80:].copy()
    a = S.Preparation(f, train)
    other[:, 0] += 1e6
    b = S.Preparation(f, x[:80])
    assert np.array_equal(a.median, b.median) and np.array_equal(a.mean, b.mean) and np.array_equal(a.slope, b.slope)
    assert np.isfinite(a(other)).all()
    with pytest.raises(ValueError):
        S.FeatureSet("bad", ("age",), (), ("s1",), True)


def test_spatial_block_is_orthogonal_to_composition():
    """What is left of the spatial columns has no linear part in the log-ratios and the log total; new rows use the same plane."""
    rng = np.random.default_rng(17)
    counts = rng.integers(1, 90, (150, 3)).astype(float)
    f = S.FeatureSet("r", ("a",), ("c1", "c2", "c3"), ("p", "q"), True)
    x = np.c_[rng.normal(size=150), counts, rng.gamma(2, 1, 150) + 0.01 * counts[:, 0], np.sqrt(counts[:, 1])]
    ready = S.Preparation(f, x)
    left = ready(x)[:, 4:]
    plane = np.c_[np.ones(150), S.log_ratios(counts), np.log(counts.sum(axis=1) + 1)]
    assert np.abs(plane.T @ left).max() < 1e-6 * 150
    beside = x[:1] + np.array([[0, 0, 0, 0, 1.0, 0]])
    assert (ready(beside) - ready(x[:1]))[0, 4] == pytest.approx(1 / ready.sd[4])


def test_ladder_reports_how_far_it_came(monkeypatch):
    """The grid is the first range that fits to its end, and a final fit stops at the last penalty reached."""
    rows = cohort()
    x, t, e = rows[list(FULL.columns)].to_numpy(), rows.time.to_numpy(), rows.event.to_numpy()
    ready = S.Preparation(FULL, x)(x)
    whole = V.Ladder(FULL, ready, t, e, V.grid(FULL, ready, t, e, QUICK), QUICK)
    assert whole.whole and whole.reached == QUICK.count - 1
    real, least = S.elastic_net_descent, whole.alphas[0] * 0.5
    monkeypatch.setattr(S, "elastic_net_descent", lambda x, t, e, alphas, *a, **k: real(x, t, e, alphas[: int((alphas >= least).sum())], *a, **k))
    alphas = V.grid(FULL, ready, t, e, QUICK)
    assert len(alphas) == QUICK.count and least <= alphas[-1] < 2 * least
    assert V.final_fit(FULL, x, t, e, whole.alphas[-1], whole.alphas, QUICK)[2] == min(a for a in whole.alphas if a >= least)
    with pytest.raises(S.Diverged):
        V.final_fit(FULL, x, t, e, least / 2, whole.alphas[:0], QUICK)


def test_all_missing_and_constant_columns():
    f = S.FeatureSet("c", ("a", "b"))
    out = S.Preparation(f, x := np.c_[np.full(5, np.nan), np.ones(5)])(x)
    assert (out == 0).all()


def test_concordance_against_pairs(spark):
    rng = np.random.default_rng(9)
    t, e, r = rng.integers(1, 15, 80) * 1.0, rng.random(80) < 0.6, rng.integers(0, 8, 80) * 1.0
    df = spark.createDataFrame([(i, bool(b), float(a), float(c)) for i, (a, b, c) in enumerate(zip(t, e, r, strict=True))], "id long, event boolean, time double, risk double")
    assert S.concordance(t, e, r) == pytest.approx(E.cindex(df, []).first().c)
    assert S.concordance(t, e, -(t + 0.5 * ~e)) == 1.0
    assert E.breslow_loglik(df.withColumn("risk", F.col("risk") / 8), []).first().loglik == pytest.approx(S.log_likelihood(r[:, None] / 8, t, e, np.ones(1))[0])


def test_folds_partition_and_stratify():
    event = np.arange(280) % 7 < 2
    fold = V.fold_of(np.arange(280), event, 5, 1)
    assert sorted(np.bincount(fold)) == [56] * 5
    assert all(abs(event[fold == k].mean() - event.mean()) < 0.03 for k in range(5))
    again = V.fold_of(np.arange(280)[::-1], event[::-1], 5, 1)[::-1]
    assert (fold == again).all() and (fold != V.fold_of(np.arange(280), event, 5, 2)).any()


def test_nested_cv_scores_everyone_once_and_finds_the_signal(spark):
    rows = cohort(150, 3)
    models = [S.FeatureSet("clinical", ("age", "er")), FULL]
    out = V.nested_cv(spark, rows, models, [0], QUICK).toPandas()
    assert out.groupby("model").id.apply(lambda s: sorted(s) == list(range(150))).all()
    c = {m: S.concordance(rows.time.to_numpy(), rows.event.to_numpy(), g.sort_values("id").risk.to_numpy()) for m, g in out.groupby("model")}
    assert c["full"] > 0.65 and c["full"] > c["clinical"] + 0.1
    random = S.concordance(rows.time.to_numpy(), rows.event.to_numpy(), V.random_risks(rows, 0))
    assert abs(random - 0.5) < 0.1
    moved = V.permuted_block(rows, "id", ["s1", "s2"], 10000)
    assert sorted(moved.s2) == sorted(rows.s2) and (moved.s2 != rows.s2).any() and (moved.c1 == rows.c1).all()


def test_held_out_rows_do_not_change_the_fit():
    rows = cohort()
    f = S.FeatureSet("clinical", ("age", "er"))
    x, t, e = rows[["age", "er"]].to_numpy(), rows.time.to_numpy(), rows.event.to_numpy()
    fold = V.fold_of(rows.id.to_numpy(), e, 3, 0)
    train = fold != 0
    one = V.chosen(f, x[train], t[train], e[train], rows.id.to_numpy()[train], 0, QUICK)
    x2 = x.copy()
    x2[~train] = 1e9
    two = V.chosen(f, x2[train], t[train], e[train], rows.id.to_numpy()[train], 0, QUICK)
    assert one[0] == two[0] and one[1] == two[1]


def test_calibration_and_auc():
    rng = np.random.default_rng(5)
    x = rng.normal(size=800)
    t = rng.exponential(np.exp(-x))
    c = rng.exponential(3.0, 800)
    time, event = np.minimum(t, c), t <= c
    assert V.calibration_slope(time, event, x) == pytest.approx(1, abs=0.2)
    assert V.calibration_slope(time, event, 2 * x) == pytest.approx(0.5, abs=0.1)
    assert 0.7 < V.td_auc(time, event, x, 1.0) < 0.95 and V.td_auc(time, event, -x, 1.0) < 0.3
    assert np.isnan(V.td_auc(time, event, x, 1e9))


def test_linear_models_from_sums_are_least_squares(spark):
    """Repeated and constant columns, a far mean, a level without rows, missing values: as numpy solves them from the rows."""
    rng = np.random.default_rng(0)
    n = 240
    rows = pd.DataFrame({"pair": np.repeat(["p", "q"], n // 2), "g": rng.choice(["a", "b", "c"], n), "x": rng.normal(size=n), "far": 1e5 + rng.normal(size=n), "one": 3.0})
    rows["twice"] = 2 * rows.x
    rows["y"] = 1 + rows.x - 2 * (rows.g == "b") + 0.01 * rows.far + rng.normal(0, 0.1, n)
    rows.loc[::17, "y"] = np.nan
    covariates, levels = ["x", "twice", "far", "one"], ["a", "b", "c", "none"]
    got = assoc.model_by_group(spark.createDataFrame(rows), ["pair"], "y", "g", levels, covariates).toPandas().set_index(["pair", "term"])
    tests = {r.pair: r for r in assoc.f_test_by_group(spark.createDataFrame(rows), ["pair"], "y", "g", levels, covariates).collect()}
    for pair, own in rows.dropna().groupby("pair"):
        terms = ["intercept", "b", "c", "x", "far"]
        x = np.c_[np.ones(len(own)), own.g == "b", own.g == "c", own.x, own.far].astype(float)
        beta, rss, _, _ = np.linalg.lstsq(x, own.y, rcond=None)
        df = len(own) - 5
        se = np.sqrt((np.linalg.inv(np.linalg.qr(x)[1]) ** 2).sum(axis=1) * rss[0] / df)
        assert got.loc[pair].loc[terms].estimate.to_numpy() == pytest.approx(beta, rel=1e-6) and got.loc[pair].loc[terms].se.to_numpy() == pytest.approx(se, rel=1e-6)
        assert got.loc[pair].loc[["none", "twice", "one"]].estimate.isna().all() and (got.loc[pair].n == len(own)).all()
        less = np.linalg.lstsq(x[:, [0, 3, 4]], own.y, rcond=None)[1][0]
        assert (tests[pair].df1, tests[pair].df2) == (2, df) and tests[pair].f == pytest.approx((less - rss[0]) / 2 / (rss[0] / df), rel=1e-6)


def test_partial_f_equals_one_way_and_permutations_are_calibrated(spark):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"id": np.tile(np.arange(90), 3), "pair": np.repeat([0, 1, 2], 90), "y": rng.normal(size=270), "g": np.tile(rng.choice(["a", "b", "c"], 90), 3), "x": rng.normal(size=270)})
    df = spark.createDataFrame(rows)
    f = {r.pair: r for r in assoc.f_test_by_group(df, ["pair"], "y", "g", ["a", "b", "c"], []).collect()}
    for r in assoc.one_way(df, ["pair"], "y", "g").collect():
        assert f[r.pair].f == pytest.approx(r.f) and 0 < f[r.pair].p <= 1
    perm = assoc.label_permutations(df, ["pair"], "id", "y", "g", ["a", "b", "c"], ["x"], 60, 7).toPandas()
    own = perm[perm.permutation < 0].set_index("pair")
    full = {r.pair: r.f for r in assoc.f_test_by_group(df, ["pair"], "y", "g", ["a", "b", "c"], ["x"]).collect()}
    assert all(own.f[k] == pytest.approx(v) for k, v in full.items())
    assert abs(perm[perm.permutation >= 0].p.mean() - 0.5) < 0.1


def test_small_groups_are_left_out(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0)] * 10, "k long, y double, x double")
    assert assoc.model_by_group(df, ["k"], "y", None, [], ["x"]).count() == 0


def test_tails():
    assert special.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert special.f_tail(3.0, 2, 20) == pytest.approx(0.0725382, abs=1e-6)
    assert special.chi2_tail_1(3.841459) == pytest.approx(0.05, abs=1e-6)


def test_cohort_rules(spark):
    n = spark.createDataFrame([(i, v) for i, v in enumerate([0, 1, 3, 4, 9, 10, 25, None])], "i long, n long")
    assert [r.b for r in n.orderBy("i").select(C.banded(F.col("n")).alias("b")).collect()] == [0, 1, 1, 2, 2, 3, 3, None]
    rows = spark.createDataFrame([(50.0, True), (200.0, True), (180.0, True), (None, True)], "t double, e boolean")
    got = rows.select(C.censored_time(F.col("t"), 180).alias("t"), C.censored_event(F.col("e"), F.col("t"), 180).alias("e")).collect()
    assert [tuple(r) for r in got] == [(50.0, True), (180.0, False), (180.0, True), (None, True)]
    assert spark.range(1).select(C.slug(F.lit("  a+b  (c)! ")).alias("s")).first().s == "a_b_c"


def test_survival_curve_and_ranks(spark):
    rows = spark.createDataFrame([(1.0, True), (2.0, False), (3.0, True), (3.0, True)], "time double, event boolean")
    assert [(r.time, r.at_risk, r.deaths, round(r.s, 6)) for r in E.kaplan_meier(rows, []).orderBy("time").collect()] == [(1.0, 4, 1, 0.75), (2.0, 3, 0, 0.75), (3.0, 2, 2, 0.0)]
    p = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.5)], "i long, p double")
    assert [round(r.q, 6) for r in E.benjamini_hochberg(p, "p", []).orderBy("i").collect()] == [0.04, 0.053333, 0.053333, 0.5]


def test_sign_tail_is_exact():
    for n in (0, 1, 7, 60, 1_000, 3_001):
        for x in {0, n // 3, n // 2, n // 2 + 1, n * 11 // 20, n}:
            assert special.sign_tail(x, n) == pytest.approx(sum(math.comb(n, i) for i in range(x, n + 1)) / 2**n, rel=1e-8, abs=1e-300)


def test_whole_tables_are_tested(spark):
    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet").toPandas().sort_values("event_id")
    p = (events.value - np.floor(events.value)) ** 2
    want = {}
    for _, own in events.assign(p=p).groupby("event_type"):
        least = 1.0
        for r, (i, v) in reversed(list(enumerate(own.sort_values(["p", "event_id"])[["event_id", "p"]].itertuples(index=False), 1))):
            want[i] = least = min(least, v * len(own) / r)
    got = {r.event_id: r.q for r in QUERIES["f06_bh_whole"](spark, folder).collect()}
    assert len(got) == len(events) and all(got[i] == pytest.approx(q, abs=1e-6) for i, q in want.items())
    customers = spark.read.parquet(f"{folder}/customer.parquet").toPandas()
    found = {r.c_mktsegment: (r.x, r.n, r.p) for r in QUERIES["f10_sign_test_whole"](spark, folder).collect()}
    for segment, own in customers.groupby("c_mktsegment"):
        x, n = int((own.c_acctbal > 4000).sum()), int((own.c_acctbal != 4000).sum())
        assert found[segment] == (x, n, pytest.approx(sum(math.comb(n, i) for i in range(x, n + 1)) / 2**n, abs=1e-6))


def test_weighted_concordance_auc_and_places_against_pairs(spark):
    from colocus.operators import cohort

    rng = np.random.default_rng(31)
    rows = [(i, int(g), bool(e), float(t), float(r), int(w)) for i, (g, e, t, r, w) in enumerate(zip(rng.integers(0, 3, 90), rng.random(90) < 0.5, rng.integers(0, 9, 90), rng.integers(0, 6, 90), rng.integers(1, 4, 90), strict=True))]
    df = spark.createDataFrame(rows, "id long, g int, event boolean, time double, risk double, w long")
    want = {}
    for g in range(3):
        own = [r for r in rows if r[1] == g]
        met = [(a[5] * b[5], 0.5 * (a[4] == b[4]) + (a[4] > b[4])) for a in own for b in own if a[2] and (a[3] < b[3] or (a[3] == b[3] and not b[2]))]
        want[g] = (sum(w * s for w, s in met) / sum(w for w, _ in met), sum(w for w, _ in met))
    got = {r["g"]: (r["c"], r["pairs"]) for r in E.cindex(df, ["g"], "w").collect()}
    assert {g: v[1] for g, v in got.items()} == {g: v[1] for g, v in want.items()}
    assert all(got[g][0] == pytest.approx(want[g][0]) for g in want)
    assert tuple(E.cindex(df.filter("NOT event"), []).first()) == (None, 0) and E.cindex(df.filter("NOT event"), ["g"]).count() == 0
    case, control = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    auc = sum(a[5] * (0.5 * (a[4] == b[4]) + (a[4] > b[4])) for a in case for b in control) / sum(a[5] for a in case) / len(control)
    assert E.weighted_auc(df.filter("event").select("risk", F.col("w").cast("double").alias("w")), df.filter("NOT event").select("risk")).first().auc == pytest.approx(auc)
    wide = spark.createDataFrame([(None if i % 50 == 0 else f"k{i * 7919 % 1000:04d}", i) for i in range(1000)], "k string, i long")
    assert [r["row_id"] for r in cohort.numbered(wide, "k", "i").orderBy("k", "i").collect()] == list(range(1000))
    assert cohort.numbered(wide.limit(0), "k").count() == 0
    moved = cohort.shuffled_jointly(df, "id", ["risk", "w"], 5).collect()
    assert len(moved) == 90 and sorted((r["risk"], r["w"]) for r in moved) == sorted((r[4], r[5]) for r in rows)


@pytest.mark.parametrize("draws", [1, 400, 10**9])
def test_permutations_of_several_ranges(spark, draws):
    """Sums by level of every permutation, for ranges of few draws and for one of all; subjects may miss in a group."""
    rng = np.random.default_rng(8)
    rows = pd.DataFrame([(p, int(i), int(i) % 3 if i > 30 else 1, float(rng.normal())) for i in rng.choice(10**7, 150, False) - 50 for p in ("a", "b") if p == "a" or i % 2], columns=["pair", "id", "level", "z_0"])
    found = assoc.permuted_sums(spark.createDataFrame(rows), ["pair"], "id", 1, 3, 70, 5, scratch(spark, "sums"), draws).toPandas().set_index(["pair", "permutation"])
    subjects = rows[["id", "level"]].drop_duplicates().sort_values("id").reset_index(drop=True)
    assert len(found) == 140
    for b in range(70):
        order = sorted(subjects.index, key=lambda i: hashlib.md5(f"5-{b}-{subjects.id[i]}".encode()).hexdigest())
        dealt = dict(zip(subjects.id, subjects.level[order], strict=True))
        for (pair, k), own in rows.groupby(["pair", rows.id.map(dealt)]):
            assert (found.loc[(pair, b), f"n_{k}"], found.loc[(pair, b), f"s_{k}_0"]) == (len(own), pytest.approx(own.z_0.sum()))


@pytest.mark.parametrize("at_once", [1, 7, 70])
def test_permutations_in_rounds(spark, at_once):
    """Sums by level are those of one round, and the files of a round go when it ends."""
    rng = np.random.default_rng(9)
    rows = pd.DataFrame({"id": np.arange(400), "level": rng.integers(0, 5, 400), "z_0": rng.normal(size=400)})
    before = spark.conf.get(assoc.CLEANUP, None)
    sums = lambda most: assoc.permuted_sums(spark.createDataFrame(rows), [], "id", 1, 5, 70, 5, scratch(spark, "sums"), 100, most).toPandas().set_index("permutation").sort_index()
    got, want = sums(400 * at_once), sums(10**9)
    assert list(got.index) == list(range(70)) and got.to_numpy() == pytest.approx(want.to_numpy())
    assert spark.conf.get(assoc.CLEANUP, None) == before


def test_permutations_of_tasks_with_several_chunks(spark):
    """Rows are not dealt quite evenly, so tasks may have some more subjects than are packed together."""
    n = 10 * assoc.CHUNK_SUBJECTS
    base = spark.range(n, numPartitions=3).select("id", (F.col("id") % 3).cast("int").alias("level"), (F.col("id") % 11).cast("double").alias("z_0"))
    found = assoc.permuted_sums(base, [], "id", 1, 3, 3, 5, scratch(spark, "sums")).toPandas().set_index("permutation")
    assert len(found) == 3 and (found[["n_0", "n_1", "n_2"]].sum(axis=1) == n).all()
    for b in range(3):
        level = np.array(sorted(range(n), key=lambda i: hashlib.md5(f"5-{b}-{i}".encode()).digest())) % 3  # noqa: B023
        for k in range(3):
            assert (found.loc[b, f"n_{k}"], found.loc[b, f"s_{k}_0"]) == ((level == k).sum(), (np.arange(n)[level == k] % 11).sum())


def test_levels_as_bits():
    for bits, n in ((1, 9), (3, 0), (3, 1001), (9, 77)):
        level = np.random.default_rng(n).integers(0, 1 << bits, n).astype(np.uint64)
        assert assoc.levels_of(assoc.bits_of(level, bits), bits, n).tolist() == level.tolist()


def test_digests_of_many_texts():
    texts = ["0", "-7", "9223372036854775807", *map(str, range(95, 9000))]
    for prefix in ("", "5-0-", "20261020-999-"):
        assert Digests(texts).after(prefix).tolist() == [int(hashlib.md5((prefix + t).encode()).hexdigest()[:16], 16) for t in texts]


def test_auc_of_many_subjects_has_no_table_of_pairs():
    rng = np.random.default_rng(6)

    def by_pairs(time, event, risk, at):
        g = lambda u: np.prod([1 - (~event & (time == v)).sum() / (time >= v).sum() for v in np.unique(time[time <= u])])
        case = np.flatnonzero(event & (time <= at))
        w = np.array([1 / g(time[i]) for i in case])
        better = np.array([((risk[i] > risk[time > at]) + 0.5 * (risk[i] == risk[time > at])).mean() for i in case])
        return (w * better).sum() / w.sum()

    time, event, risk = rng.integers(1, 40, 200) / 2, rng.random(200) < 0.4, rng.integers(0, 12, 200) / 4
    assert V.td_auc(time, event, risk, 9.0) == pytest.approx(by_pairs(time, event, risk, 9.0))
    assert np.isnan(V.td_auc(time, event, risk, 0.1))
    n = 20_000
    tracemalloc.start()
    V.td_auc(rng.exponential(10, n), rng.random(n) < 0.5, rng.normal(size=n), 7.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


def test_concordance_by_pairs_and_at_size():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 7, 60):
        time, event, risk = rng.integers(1, 15, n) / 2, rng.random(n) < 0.5, rng.integers(0, 9, n) / 4
        score = [(risk[i] > risk[j]) + 0.5 * (risk[i] == risk[j]) for i in range(n) for j in range(n) if event[i] and (time[i] < time[j] or time[i] == time[j] and not event[j])]
        assert S.concordance(time, event, risk) == pytest.approx(np.mean(score) if score else float("nan"), nan_ok=True)
    n, start = 100_000, clock.process_time()
    S.concordance(rng.exponential(10, n), rng.random(n) < 0.5, rng.normal(size=n))
    own = clock.process_time() - start
    start = clock.process_time()
    sum(i & 7 for i in range(10**6))
    assert own < 6 * (clock.process_time() - start)  # 2 here; a tree walked in Python took 12
