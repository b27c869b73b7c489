"""Every query against its SQL, run by another engine over the same tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from colocus import plans
from colocus.operators import survival as S
from colocus.operators import validation as V
from colocus.plans import models as M

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    return con


def rows_of(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = duck.execute(plans.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    kinds = {c[0]: str(c[1]) for c in found.description}
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds
    want = rows_of(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
    got = rows_of(tuple(r[c] for c in columns) for r in df.collect())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-4, nan_ok=True) if any(isinstance(v, float) for v in a) and None not in a else a == b


def found(spark, name):
    return plans.QUERIES[name](spark, FOLDER).toPandas()


def test_every_query_has_sql_or_a_check_here():
    here = "c20_lineage_rounds c21_typing c22_typing_by_image d08_elastic_net_path d16_nested_cv d17_models_and_random d18_transfer e07_resampled_metrics e08_repeat_deltas e10_permutation_null"
    assert sorted(set(plans.QUERIES) - set(plans.ORACLES)) == here.split()


def test_typing_and_its_rounds(spark):
    t, rounds = found(spark, "c21_typing"), found(spark, "c20_lineage_rounds").set_index(["image", "round"])
    assert not t.duplicated(["image", "cell_id"]).any()
    assert (t.label[t.artefact] == "Unknown").all() and (t.label[t.anchor] != "Unknown").all()
    for image, own in t[~t.artefact].groupby("image"):
        refined = own.label.isin(["A", "A1", "A2"]).sum()
        assert tuple(rounds.loc[(image, 1), ["candidates", "assigned"]]) == (len(own), (own.label != "Unknown").sum())
        assert tuple(rounds.loc[(image, 2), ["candidates", "assigned"]]) == (refined, own.label.isin(["A1", "A2"]).sum())
    own = found(spark, "c22_typing_by_image")
    size = own.groupby("image").cell_id.transform("size")
    assert len(own) == len(t) and ((own.label == "Skipped") == (size <= 10)).all()


def test_elastic_net_path_is_optimal(spark):
    rows, f = M.cohort(spark, FOLDER), M.MODELS[2]
    raw = rows[list(f.columns)].to_numpy(float)
    x, time, event = S.Preparation(f, raw)(raw), rows["time"].to_numpy(), rows["event"].to_numpy()
    path = found(spark, "d08_elastic_net_path").pivot(index="alpha", columns="feature", values="beta")[list(f.columns)]
    for alpha, beta in zip(path.index, path.to_numpy(), strict=True):
        slope = S.log_likelihood(x, time, event, beta)[1] / len(x) - alpha * f.factor * 0.5 * beta
        limit = alpha * f.factor * 0.5
        held = beta == 0
        assert (np.abs(slope[held]) <= limit[held] + 1e-4).all()
        assert slope[~held] == pytest.approx((limit * np.sign(beta))[~held], abs=1e-4)


def test_cross_validated_models(spark):
    rows = M.cohort(spark, FOLDER)
    ids, event, time = rows["id"].to_numpy(), rows["event"].to_numpy(), rows["time"].to_numpy()
    oof = found(spark, "d16_nested_cv")
    for _, own in oof.groupby(["model", "seed"]):
        own = own.sort_values("id")
        assert own.id.tolist() == ids.tolist()
        assert own.fold.tolist() == V.fold_of(ids, event, 3, 0).tolist()
        assert (own.alpha_fitted >= own.alpha).all() and own.groupby("fold").alpha.nunique().eq(1).all()
    both = found(spark, "d17_models_and_random")
    assert both.groupby(["model", "seed"]).id.apply(lambda v: sorted(v) == ids.tolist()).all() and both.model.nunique() == 3
    assert both[both.model == "random"].risk.between(0, 1, inclusive="left").all()
    other = found(spark, "d18_transfer")
    assert other.groupby("model").id.apply(lambda v: sorted(v) == ids[ids % 2 == 1].tolist()).all() and other.groupby("model").alpha.nunique().eq(1).all()
    deltas = found(spark, "e08_repeat_deltas").set_index(["model", "seed"]).delta
    risks = V.nested_cv(spark, rows, M.MODELS[:2], [0], M.SMALL).toPandas()
    c = {m: S.concordance(time, event, own.sort_values("id").risk.to_numpy()) for m, own in risks.groupby("model")}
    assert len(deltas) == 4 and deltas["composition", 0] == pytest.approx(c["composition"] - c["clinical"])
    null = found(spark, "e10_permutation_null").iloc[0]
    assert null.p in (0.25, 0.5, 0.75, 1.0) and (null.p == 0.25) == (null.null_max < null.observed) and null.null_mean <= null.null_max


def test_resampled_metrics_start_from_the_whole_cohort(spark):
    t = found(spark, "e07_resampled_metrics")
    whole = t[t["sample"] == -1].set_index("metric").value
    assert whole["slope"] == pytest.approx(found(spark, "e05_calibration_slope").slope[0], abs=1e-5)
    assert whole["auc_20"] == pytest.approx(found(spark, "e06_td_auc").auc[0], abs=1e-5)
    assert t["sample"].between(-1, 15).all() and not t.duplicated(["sample", "model", "metric"]).any()
