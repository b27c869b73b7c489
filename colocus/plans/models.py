"""Families D, E and F: survival models, evaluation, association."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from colocus.functions.special import sign_tails
from colocus.operators import assoc
from colocus.operators import evaluate as E
from colocus.operators import survival as S
from colocus.operators import validation as V
from colocus.operators.ordered import exact_quantiles, with_ranks
from colocus.plans import linear_sql as L
from colocus.plans.registry import query, rounded
from colocus.sources.files import scratch
from colocus.sources.tables import SURVIVAL_SQL, survival, table

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SUB = f"WITH {SURVIVAL_SQL}"


def subjects(spark, d):
    return survival(spark, d)


# D: preprocessing and survival models

TRAIN = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END"


def _folded(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("value")).alias("x"), (F.col("user_id") % 5).alias("fold"))
    return e


TRAINED = "e JOIN (SELECT k::BIGINT AS k FROM range(5) f(k)) f ON fold <> k"


@query("d01_median_imputation", f"WITH e AS (SELECT event_id, {TRAIN} AS x, user_id % 5 AS fold FROM events), m AS (SELECT k, coalesce(quantile_cont(x, 0.5), 0e0) AS m FROM {TRAINED} GROUP BY k) SELECT event_id, fold, round(coalesce(x, m), 6) AS x FROM e JOIN m ON k = fold")
def d01(spark, d):
    """Each fold filled in with the median of the four others."""
    e = _folded(spark, d)
    m = exact_quantiles(_trained(e), ["k"], "x", [0.5]).select("k", F.coalesce(F.get("q", 0), F.lit(0.0)).alias("m"))
    return e.join(F.broadcast(m), e.fold == m.k).select("event_id", "fold", F.round(F.coalesce("x", "m"), 6).alias("x"))  # five rows


def _trained(e):
    """Every row once for each fold k of which it is a training row."""
    return e.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in range(5)]))).filter("k <> fold")


@query("d02_standardise", f"WITH e AS (SELECT event_id, value AS x, user_id % 5 AS fold FROM events), m AS (SELECT k, avg(x) AS m, stddev_pop(x) AS s FROM {TRAINED} GROUP BY k) SELECT event_id, fold, round((x - m) / CASE WHEN s > 1e-12 THEN s ELSE 1e0 END, 4) AS x FROM e JOIN m ON k = fold")
def d02(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("value").alias("x"), (F.col("user_id") % 5).alias("fold"))
    m = _trained(e).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    scale = F.when(F.col("s") > 1e-12, F.col("s")).otherwise(1.0)
    return e.join(F.broadcast(m), e.fold == m.k).select("event_id", "fold", F.round((F.col("x") - F.col("m")) / scale, 4).alias("x"))


@query("d03_clr_block", "WITH c AS (SELECT user_id, t AS event_type, count(event_id) FILTER (WHERE event_type = t) AS n FROM events CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS t) GROUP BY 1, 2) SELECT user_id, event_type, round(ln(n + 0.5e0) - avg(ln(n + 0.5e0)) OVER (PARTITION BY user_id), 6) + 0e0 AS clr FROM c")
def d03(spark, d):
    from colocus.operators.coloc import clr, full_grid
    from colocus.plans.etl import TYPES

    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return clr(full_grid(n, "user_id", "event_type", TYPES, "n"), "user_id", "event_type", "n").withColumn("clr", F.round("clr", 6) + 0.0)


MODELS = [
    S.FeatureSet("clinical", ("age", "size")),
    S.FeatureSet("composition", ("age", "size"), ("n_click", "n_error", "n_view")),
    S.FeatureSet("spatial", ("age", "size"), ("n_click", "n_error", "n_view"), ("early", "spread")),
    S.FeatureSet("arrangement", ("age", "size"), ("n_click", "n_error", "n_view"), ("early", "spread"), True),
]
QUICK = V.Settings(outer=3, inner=3, count=6, ratio=0.1)


def cohort(spark, d) -> pd.DataFrame:
    """The subjects with two clinical, three composition and two spatial columns: a row per user, some hundreds to thousands."""
    e = table(spark, d, "events")
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1)).cast("double")
    x = e.groupBy("user_id").agg(
        F.avg("value").alias("age"), F.when(F.max("event_id") % 11 > 0, F.ln(F.count("*").cast("double"))).alias("size"),
        n("click").alias("n_click"), n("error").alias("n_error"), n("view").alias("n_view"),
        F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("early"), F.stddev_samp("value").alias("spread"),
    )
    rows = survival(spark, d).select("user_id", "time", "event").join(x, "user_id").filter("time > 0").withColumnRenamed("user_id", "id").toPandas()
    return rows.sort_values("id").reset_index(drop=True)


def _beyond(over: str) -> str:
    gone = lambda x, y: f"{x} - {y} * (sum({x} * {y}) OVER () / sum({y} * {y}) OVER ()) AS {x}"
    names, rows = ["l1", "l2", "lt", "early", "spread"], over
    for i, y in enumerate(names[:3]):
        rows = f"(SELECT id, {', '.join([*names[: i + 1], *[gone(x, y) for x in names[i + 1 :]]])} FROM {rows})"
    return rows


BEYOND = f"""{SUB}, raw AS (SELECT user_id AS id, count(*) FILTER (WHERE event_type = 'click') + 0.5e0 AS c, count(*) FILTER (WHERE event_type = 'error') + 0.5e0 AS r, count(*) FILTER (WHERE event_type = 'view') + 0.5e0 AS w,
avg(value) FILTER (WHERE event_type = 'view') AS early, stddev_samp(value) AS spread FROM events GROUP BY 1),
known AS (SELECT id, ln(c) - (ln(c) + ln(r) + ln(w)) / 3 AS l1, ln(r) - (ln(c) + ln(r) + ln(w)) / 3 AS l2, ln(c + r + w - 1.5e0 + 1) AS lt, coalesce(early, quantile_cont(early, 0.5) OVER ()) AS early, coalesce(spread, quantile_cont(spread, 0.5) OVER ()) AS spread FROM subjects JOIN raw ON id = user_id WHERE time > 0),
mid AS (SELECT id, {', '.join(f'{x} - avg({x}) OVER () AS {x}' for x in ('l1', 'l2', 'lt', 'early', 'spread'))} FROM known)"""


@query("d04_residual_spatial", f"{BEYOND} SELECT id, round(early / stddev_pop(early) OVER (), 6) AS early, round(spread / stddev_pop(spread) OVER (), 6) AS spread FROM {_beyond('mid')}")
def d04(spark, d):
    rows = cohort(spark, d)
    f = MODELS[3]
    out = S.Preparation(f, rows[list(f.columns)].to_numpy(float))(rows[list(f.columns)].to_numpy(float))
    return rounded(spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(rows["id"], out[:, -2:], strict=True)], "id long, early double, spread double"))


CLINICAL = f"""{SUB}, raw AS (SELECT user_id, avg(value) AS age, CASE WHEN max(event_id) % 11 > 0 THEN ln(count(*)::DOUBLE) END AS size FROM events GROUP BY 1),
known AS (SELECT time, event, age, size FROM subjects JOIN raw USING (user_id) WHERE time > 0),
filled AS (SELECT time, event, age, coalesce(size, quantile_cont(size, 0.5) OVER ()) AS size FROM known),
ready AS (SELECT time, event, (age - avg(age) OVER ()) / stddev_pop(age) OVER () AS u, (size - avg(size) OVER ()) / stddev_pop(size) OVER () AS v FROM filled)"""


@query("d06_ridge_cox", f"{CLINICAL}, {L.cox('fit', 'ready', 1.0)} SELECT unnest(['age', 'size']) AS feature, unnest([round(bu, 6), round(bv, 6)]) AS beta FROM fit")
def d06(spark, d):
    rows, f = cohort(spark, d), MODELS[0]
    x = S.Preparation(f, rows[list(f.columns)].to_numpy(float))(rows[list(f.columns)].to_numpy(float))
    beta = S.ridge_cox(x, rows["time"].to_numpy(), rows["event"].to_numpy(), 1.0)
    return rounded(spark.createDataFrame(list(zip(f.columns, map(float, beta), strict=True)), "feature string, beta double"))


@query("d09_penalty_grid", "SELECT i::BIGINT AS place, round(pow(10, 3 - 5e0 * i / 19), 6) AS alpha FROM range(20) r(i)")
def d09(spark, d):
    """The penalties of a model without penalised blocks of its own: 10^3 down to 10^-2, evenly in the exponent."""
    rows, f = cohort(spark, d), MODELS[0]
    x = S.Preparation(f, rows[list(f.columns)].to_numpy(float))(rows[list(f.columns)].to_numpy(float))
    alphas = V.grid(f, x, rows["time"].to_numpy(), rows["event"].to_numpy(), V.Settings())
    return rounded(spark.createDataFrame([(i, float(a)) for i, a in enumerate(alphas)], "place long, alpha double"))


FITS = " UNION ALL ".join(f"SELECT {a}e0 AS alpha, unnest(['age', 'size']) AS feature, unnest([round(bu, 6), round(bv, 6)]) AS beta FROM fit{i}" for i, a in enumerate((1000, 10, 0.1)))


@query("d11_fit_each_penalty", f"{CLINICAL}, {', '.join(L.cox(f'fit{i}', 'ready', a) for i, a in enumerate((1000.0, 10.0, 0.1)))} {FITS}")
def d11(spark, d):
    """A fit for every penalty, one task each; a fit that fails has no rows."""
    rows, f = cohort(spark, d), MODELS[0]
    x = S.Preparation(f, rows[list(f.columns)].to_numpy(float))(rows[list(f.columns)].to_numpy(float))
    alphas = [1000.0, 10.0, 0.1]
    beta = V.path(f, x, rows["time"].to_numpy(), rows["event"].to_numpy(), alphas, V.Settings())
    found = [(a, c, float(beta[i, j])) for j, a in enumerate(alphas) for i, c in enumerate(f.columns) if pd.notna(beta[i, j])]
    return rounded(spark.createDataFrame(found, "alpha double, feature string, beta double"))


@query("d12_final_fit", f"{CLINICAL}, {L.cox('fit', 'ready', 10.0)} SELECT 10e0 AS alpha, round(bu, 6) AS age, round(bv, 6) AS size FROM fit")
def d12(spark, d):
    """The refit on all subjects at a chosen penalty, with the penalty that was fitted."""
    rows, f = cohort(spark, d), MODELS[0]
    _, beta, alpha = V.final_fit(f, rows[list(f.columns)].to_numpy(float), rows["time"].to_numpy(), rows["event"].to_numpy(), 10.0, pd.Series([100.0, 10.0, 1.0]).to_numpy(), V.Settings())
    return rounded(spark.createDataFrame([(alpha, *map(float, beta))], "alpha double, age double, size double"))


@query("d07_partial_likelihood", f"{SUB}, w AS (SELECT time, sum(exp(risk / 100e0)) AS w FROM subjects GROUP BY 1), s AS (SELECT time, sum(w) OVER (ORDER BY time DESC) AS s FROM w) SELECT round(sum(risk / 100e0 - ln(s)), 4) AS loglik FROM subjects JOIN s USING (time) WHERE event")
def d07(spark, d):
    rows = subjects(spark, d).withColumn("risk", F.col("risk") / 100.0)
    return E.breslow_loglik(rows, []).select(F.round("loglik", 4).alias("loglik"))


@query("d08_elastic_net_path")
def d08(spark, d):
    """D09 and D10 inside: the automatic penalty grid and the path with its smallest penalties dropped if they diverge."""
    rows, f = cohort(spark, d), MODELS[2]
    raw = rows[list(f.columns)].to_numpy(float)
    x, time, event = S.Preparation(f, raw)(raw), rows["time"].to_numpy(), rows["event"].to_numpy()
    alphas = V.grid(f, x, time, event, QUICK)
    beta = V.path(f, x, time, event, alphas, QUICK)
    return spark.createDataFrame([(float(a), c, float(beta[i, j])) for j, a in enumerate(alphas) for i, c in enumerate(f.columns)], "alpha double, feature string, beta double")


@query("d10_path_reach", "SELECT i::BIGINT AS place, TRUE AS fitted FROM range(6) r(i)")
def d10(spark, d):
    """The chosen grid is one whose path fits to its end; a path that diverges loses its smallest penalties only."""
    rows, f = cohort(spark, d), MODELS[2]
    raw = rows[list(f.columns)].to_numpy(float)
    x, time, event = S.Preparation(f, raw)(raw), rows["time"].to_numpy(), rows["event"].to_numpy()
    ladder = V.Ladder(f, x, time, event, V.grid(f, x, time, event, QUICK), QUICK)
    return spark.createDataFrame([(i, i in ladder.fits) for i in range(len(ladder.alphas))], "place long, fitted boolean")


RISK = "round(0.5e0 * floor(o_totalprice / 1000e0) - 0.25e0 * (o_custkey % 7), 2)"


@query("d13_risk_score", f"SELECT o_orderkey, {RISK} AS risk FROM orders")
def d13(spark, d):
    beta = spark.createDataFrame([("price", 0.5), ("rest", -0.25)], "feature string, beta double")
    o = table(spark, d, "orders")
    long = o.select("o_orderkey", F.explode(F.array(F.struct(F.lit("price").alias("feature"), F.floor(F.col("o_totalprice") / 1000.0).cast("double").alias("x")), F.struct(F.lit("rest").alias("feature"), (F.col("o_custkey") % 7).cast("double").alias("x")))).alias("p")).select("o_orderkey", "p.*")
    return long.join(F.broadcast(beta), "feature").groupBy("o_orderkey").agg(F.round(F.sum(F.col("x") * F.col("beta")), 2).alias("risk"))


@query("d14_stratified_folds", f"{SUB} SELECT user_id, ((row_number() OVER (PARTITION BY event ORDER BY md5('3-' || user_id::VARCHAR), user_id) - 1) % 5)::BIGINT AS fold FROM subjects")
def d14(spark, d):
    return E.folds(subjects(spark, d), "user_id", 5, 3).select("user_id", "fold")


@query("d15_penalty_choice", "WITH c AS (SELECT o_orderpriority AS model, (o_custkey % 10)::DOUBLE AS alpha, avg(o_totalprice) AS c FROM orders GROUP BY 1, 2) SELECT model, alpha FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(c, -4) DESC, alpha DESC) AS r FROM c) WHERE r = 1")
def d15(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 10).cast("double").alias("alpha")).agg(F.avg("o_totalprice").alias("c"))
    return c.groupBy("model").agg(F.max_by("alpha", F.struct(F.round("c", -4).alias("c"), "alpha")).alias("alpha"))


@query("d16_nested_cv")
def d16(spark, d):
    return V.nested_cv(spark, cohort(spark, d), MODELS[:1] + MODELS[2:3], [0], QUICK).select("model", "seed", "fold", "id", "risk", "alpha", "alpha_fitted", "inner_c", "n_nonzero")


@query("d17_models_and_random")
def d17(spark, d):
    rows = cohort(spark, d)
    oof = V.nested_cv(spark, rows, MODELS[:2], [0, 1], V.Settings(outer=3, inner=2, count=4, ratio=0.2)).select("model", "seed", "id", "risk")
    none = spark.createDataFrame([("random", s, int(i), float(r)) for s in (0, 1) for i, r in zip(rows["id"], V.random_risks(rows, s), strict=True)], "model string, seed long, id long, risk double")
    return oof.unionByName(none)


@query("d18_transfer")
def d18(spark, d):
    rows = cohort(spark, d)
    even = rows["id"] % 2 == 0
    return V.transfer(spark, rows[even].reset_index(drop=True), rows[~even].reset_index(drop=True), MODELS[:2], 5, QUICK)


@query("d19_coefficient_table", "WITH b AS (SELECT event_type AS feature, user_id, avg(value) - 50e0 AS beta FROM events GROUP BY 1, 2) SELECT feature, round(avg(beta), 6) AS mean, round(stddev_samp(beta), 6) AS sd, round(avg(CASE WHEN abs(beta) > 10e0 THEN 1e0 ELSE 0e0 END), 6) AS selected FROM b GROUP BY 1")
def d19(spark, d):
    b = table(spark, d, "events").groupBy(F.col("event_type").alias("feature"), "user_id").agg((F.avg("value") - 50.0).alias("beta"))
    out = b.groupBy("feature").agg(F.round(F.avg("beta"), 6).alias("mean"), F.round(F.stddev_samp("beta"), 6).alias("sd"), F.round(F.avg((F.abs("beta") > 10).cast("double")), 6).alias("selected"))
    return out.orderBy(F.abs("mean").desc())


# E: evaluation

PAIRS = """pairs AS (SELECT a.user_id AS i, b.user_id AS j, CASE WHEN abs(a.risk - b.risk) <= 1e-8 THEN 0.5e0 WHEN a.risk > b.risk THEN 1e0 ELSE 0e0 END AS score
FROM subjects a JOIN subjects b ON a.event AND (a.time < b.time OR (a.time = b.time AND NOT b.event)))"""


@query("e01_cindex", f"{SUB}, {PAIRS} SELECT round(avg(score), 6) AS c, count(*)::BIGINT AS pairs FROM pairs")
def e01(spark, d):
    return E.cindex(subjects(spark, d), []).withColumn("c", F.round("c", 6))


MANY = "many AS (SELECT user_id, event, time, m AS model, s AS seed, round(risk + m * 10e0 * sin(user_id * (s + 1)), 6) AS risk FROM subjects CROSS JOIN (SELECT unnest([0, 1]) AS m) CROSS JOIN (SELECT unnest([0, 1, 2]) AS s))"


def many(spark, d):
    grid = subjects(spark, d).withColumn("model", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return grid.withColumn("risk", F.round(F.col("risk") + F.col("model") * 10.0 * F.sin(F.col("user_id") * (F.col("seed") + 1)), 6))


def _many_pairs(keys):
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    cols = ", ".join(f"a.{k}" for k in keys)
    return f"mp AS (SELECT {cols}, a.user_id AS i, b.user_id AS j, CASE WHEN abs(a.risk - b.risk) <= 1e-8 THEN 0.5e0 WHEN a.risk > b.risk THEN 1e0 ELSE 0e0 END AS score FROM many a JOIN many b ON {on} AND a.event AND (a.time < b.time OR (a.time = b.time AND NOT b.event)))"


@query("e02_seed_mean_cindex", f"{SUB}, {MANY}, {_many_pairs(['model', 'seed'])} SELECT model::BIGINT AS model, round(avg(c), 6) AS c FROM (SELECT model, seed, avg(score) AS c FROM mp GROUP BY 1, 2) GROUP BY 1")
def e02(spark, d):
    c = E.cindex(many(spark, d), ["model", "seed"])
    return c.groupBy(F.col("model").cast("long").alias("model")).agg(F.round(F.avg("c"), 6).alias("c"))


SAMPLES = 20
BOOT = f"""{SUB}, {MANY}, one AS (SELECT * FROM many WHERE seed = 0), {_many_pairs(['model']).replace('many a JOIN many b', 'one a JOIN one b')},
place AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS p, count(*) OVER () AS n FROM subjects),
draw AS (SELECT s AS sample, ('0x' || substr(md5('11-' || s::VARCHAR || '-' || dd::VARCHAR), 1, 8))::BIGINT % (SELECT max(n) FROM place) AS p FROM range({SAMPLES}) t(s), range((SELECT count(*) FROM subjects)) u(dd)),
w AS (SELECT sample, user_id, count(*) AS w FROM draw JOIN place USING (p) GROUP BY 1, 2),
boot AS (SELECT model, x.sample, sum(x.w * y.w * score) / sum(x.w * y.w) AS c FROM mp JOIN w x ON x.user_id = i JOIN w y ON y.user_id = j AND y.sample = x.sample GROUP BY 1, 2)"""


def boot(spark, d):
    rows = many(spark, d).filter("seed = 0")
    place = subjects(spark, d).select("user_id", (F.row_number().over(Window.orderBy("user_id")) - 1).cast("long").alias("p"))  # one row per subject
    w = E.resample_weights(place, "p", "user_id", place.count(), SAMPLES, 11)
    return E.bootstrap_cindex(rows, ["model"], "user_id", w)


@query("e03_bootstrap", f"{BOOT} SELECT model::BIGINT AS model, sample, round(c, 6) AS c FROM boot")
def e03(spark, d):
    return boot(spark, d).select(F.col("model").cast("long").alias("model"), "sample", F.round("c", 6).alias("c"))


@query("e04_boot_ci", f"{BOOT} SELECT round(quantile_cont(a.c - b.c, 0.025), 6) AS low, round(quantile_cont(a.c - b.c, 0.975), 6) AS high, round(avg(CASE WHEN a.c > b.c THEN 1e0 ELSE 0e0 END), 6) AS share_above FROM boot a JOIN boot b ON a.sample = b.sample AND a.model = 1 AND b.model = 0")
def e04(spark, d):
    c = boot(spark, d).groupBy("sample").agg((F.max(F.when(F.col("model") == 1, F.col("c"))) - F.max(F.when(F.col("model") == 0, F.col("c")))).alias("gap"))
    out = E.interval(c, [], "gap")
    return out.select(*[F.round(x, 6).alias(x) for x in out.columns])


@query("e05_calibration_slope", f"{SUB}, ready AS (SELECT time, event, risk / 100e0 AS u, 0e0 AS v FROM subjects), {L.cox('fit', 'ready', 0.0, False)} SELECT round(bu, 6) AS slope FROM fit")
def e05(spark, d):
    rows = subjects(spark, d).toPandas()  # a cohort
    slope = V.calibration_slope(rows["time"].to_numpy(), rows["event"].to_numpy(), rows["risk"].to_numpy() / 100)
    return rounded(spark.createDataFrame([(float(slope),)], "slope double"))


AT = 20.0


@query("e06_td_auc", f"""{SUB}, n AS (SELECT time, count(*) AS n, count(*) FILTER (WHERE NOT event) AS c FROM subjects GROUP BY 1), r AS (SELECT time, c, sum(n) OVER (ORDER BY time DESC) AS at_risk FROM n),
g AS (SELECT time, exp(sum(ln(CASE WHEN at_risk > c THEN 1 - c::DOUBLE / at_risk END)) OVER (ORDER BY time)) AS g, max(CASE WHEN at_risk = c THEN 1 ELSE 0 END) OVER (ORDER BY time) AS dead FROM r),
cs AS (SELECT user_id, risk, 1 / g AS w FROM subjects JOIN g USING (time) WHERE event AND subjects.time <= {AT}e0 AND dead = 0), ct AS (SELECT risk FROM subjects WHERE time > {AT}e0)
SELECT round(sum(w * CASE WHEN cs.risk > ct.risk THEN 1e0 WHEN cs.risk = ct.risk THEN 0.5e0 ELSE 0e0 END) / sum(w), 6) AS auc FROM cs, ct""")
def e06(spark, d):
    rows = subjects(spark, d)
    g = E.kaplan_meier(rows.withColumn("event", ~F.col("event")), []).select("time", F.col("s").alias("g"))
    case = rows.filter(F.col("event") & (F.col("time") <= AT)).join(g, "time").filter("g > 0").select("risk", (1 / F.col("g")).alias("w"))
    return E.weighted_auc(case, rows.filter(F.col("time") > AT).select("risk")).select(F.round("auc", 6).alias("auc"))


@query("e07_resampled_metrics")
def e07(spark, d):
    rows = subjects(spark, d).orderBy("user_id").toPandas()
    return V.resampled_metrics(spark, rows, {"risk": rows["risk"].to_numpy() / 100}, [10.0, 20.0], 16, 2024)


def _cv_c(spark, rows, models, seeds, settings, shuffle=None):
    oof = V.nested_cv(spark, rows, models, seeds, settings, shuffle_spatial=shuffle).select("model", "seed", "id", "risk")
    folder = scratch(spark, "risks")  # fits run once, however often the risks are read
    oof.join(spark.createDataFrame(rows[["id", "time", "event"]]), "id").write.parquet(folder)
    return E.cindex(spark.read.parquet(folder), ["model", "seed"])


SMALL = V.Settings(outer=3, inner=2, count=3, ratio=0.3)


@query("e08_repeat_deltas")
def e08(spark, d):
    c = _cv_c(spark, cohort(spark, d), MODELS[:3], [0, 1], SMALL)
    base = c.filter("model = 'clinical'").select("seed", F.col("c").alias("base"))
    return c.filter("model <> 'clinical'").join(base, "seed").select("model", "seed", (F.col("c") - F.col("base")).alias("delta"))


@query("e09_block_permutation", "SELECT a.user_id, b.value AS moved FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) AS p FROM (SELECT DISTINCT user_id FROM events)) a JOIN (SELECT user_id, value, row_number() OVER (ORDER BY md5('10001-' || user_id::VARCHAR), user_id) AS p FROM (SELECT user_id, round(avg(value), 6) AS value FROM events GROUP BY 1)) b USING (p)")
def e09(spark, d):
    from colocus.operators.cohort import shuffled_jointly

    v = table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("moved"))
    return shuffled_jointly(v, "user_id", ["moved"], 10001)


@query("e10_permutation_null")
def e10(spark, d):
    """Gain of the spatial block against its permutations; the base model is fitted once."""
    rows = cohort(spark, d)
    base = _cv_c(spark, rows, MODELS[1:2], [0], SMALL).select(F.col("c").alias("base"))
    runs = [(p, _cv_c(spark, rows, MODELS[2:3], [0], SMALL, p)) for p in (None, 10000, 10001, 10002)]
    deltas = None
    for p, c in runs:
        one = c.crossJoin(base).select(F.lit(-1 if p is None else p).alias("permutation"), (F.col("c") - F.col("base")).alias("delta"))
        deltas = one if deltas is None else deltas.unionByName(one)
    seen = deltas.filter("permutation < 0").select(F.col("delta").alias("observed"))
    null = deltas.filter("permutation >= 0").crossJoin(seen)
    return null.groupBy("observed").agg(((1 + F.count(F.when(F.col("delta") >= F.col("observed"), 1))) / (1 + F.count("*"))).alias("p"), F.avg("delta").alias("null_mean"), F.stddev_samp("delta").alias("null_sd"), F.max("delta").alias("null_max"))


GROUPED = f"{SUB}, med AS (SELECT quantile_cont(risk, 0.5) AS m FROM subjects), grouped AS (SELECT s.*, risk > m AS high FROM subjects s, med)"


def grouped(spark, d):
    s = subjects(spark, d)
    return s.crossJoin(F.broadcast(exact_quantiles(s, [], "risk", [0.5]).select(F.get("q", 0).alias("m")))).withColumn("high", F.col("risk") > F.col("m"))


@query("e11_km", f"""{GROUPED}, n AS (SELECT high, time, count(*) AS n, count(*) FILTER (WHERE event) AS d FROM grouped GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY high ORDER BY time DESC) AS at_risk FROM n)
SELECT high, time, at_risk::BIGINT AS at_risk, d::BIGINT AS deaths, round(CASE WHEN max(CASE WHEN d = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0e0 ELSE exp(sum(ln(CASE WHEN at_risk > d THEN 1 - d::DOUBLE / at_risk END)) OVER w) END, 6) AS s FROM r WINDOW w AS (PARTITION BY high ORDER BY time)""")
def e11(spark, d):
    return E.kaplan_meier(grouped(spark, d), ["high"]).withColumn("s", F.round("s", 6))


@query("e12_logrank", f"""{GROUPED}, n AS (SELECT time, count(*) AS n, count(*) FILTER (WHERE high) AS n1, count(*) FILTER (WHERE event) AS d, count(*) FILTER (WHERE event AND high) AS d1 FROM grouped GROUP BY 1),
r AS (SELECT d, d1, sum(n) OVER (ORDER BY time DESC)::DOUBLE AS r, sum(n1) OVER (ORDER BY time DESC)::DOUBLE AS r1 FROM n), s AS (SELECT sum(d1) AS o, sum(d * r1 / r) AS e, sum(CASE WHEN r > 1 THEN d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0e0 END) AS v FROM r WHERE d > 0)
SELECT o::BIGINT AS observed, round(e, 6) AS expected, round(v, 6) AS variance, round((o - e) * (o - e) / v, 6) AS chi2 FROM s""")
def e12(spark, d):
    out = E.log_rank(grouped(spark, d), F.col("high"))
    return out.select("observed", *[F.round(c, 6).alias(c) for c in ("expected", "variance", "chi2")])


@query("e13_mean_ranks", f"{SUB}, {MANY}, r AS (SELECT user_id, rank() OVER (PARTITION BY seed ORDER BY risk) + (count(*) OVER (PARTITION BY seed, risk) - 1) / 2e0 AS r FROM many WHERE model = 1) SELECT user_id, round(avg(r), 6) AS rank FROM r GROUP BY 1")
def e13(spark, d):
    r = with_ranks(many(spark, d).filter("model = 1"), ["seed"], "risk", "r")
    return r.groupBy("user_id").agg(F.round(F.avg("r"), 6).alias("rank"))


@query("e14_spearman", "WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2e0 AS x, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2e0 AS y FROM events) SELECT event_type, round(corr(x, y), 6) AS rho, count(*)::BIGINT AS n FROM r GROUP BY 1")
def e14(spark, d):
    return E.spearman(table(spark, d, "events"), "value", "user_id", ["event_type"]).withColumn("rho", F.round("rho", 6))


@query("e15_example_pick", "WITH u AS (SELECT user_id, count(*) AS n, avg(value) AS v FROM events GROUP BY 1), b AS (SELECT quantile_cont(n, 0.4) AS lo, quantile_cont(n, 0.6) AS hi, quantile_cont(v, 0.9) AS q FROM u) SELECT user_id FROM u, b WHERE n BETWEEN lo AND hi ORDER BY abs(v - q), user_id LIMIT 1")
def e15(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    size = exact_quantiles(u, [], "n", [0.4, 0.6]).select(F.get("q", 0).alias("lo"), F.get("q", 1).alias("hi"))
    b = size.crossJoin(exact_quantiles(u, [], "v", [0.9]).select(F.get("q", 0).alias("q")))
    t = u.crossJoin(F.broadcast(b)).filter(F.col("n").between(F.col("lo"), F.col("hi")))
    return t.agg(F.min_by("user_id", F.struct(F.abs(F.col("v") - F.col("q")).alias("g"), "user_id")).alias("user_id"))


@query("e16_verdict", "WITH t AS (SELECT event_type, quantile_cont(value - 40e0, 0.025) AS low, quantile_cont(value - 40e0, 0.975) AS high, avg(value - 40e0) AS mean, count(*) FILTER (WHERE value > 200e0)::DOUBLE / count(*) AS p FROM events GROUP BY 1) SELECT event_type, CASE WHEN low > 0 AND p < 0.05e0 AND mean > 0 THEN 'supported' WHEN high <= 0 THEN 'refuted' ELSE 'inconclusive' END AS verdict FROM t")
def e16(spark, d):
    e = table(spark, d, "events").withColumn("x", F.col("value") - 40.0)
    t = e.groupBy("event_type").agg(F.avg("x").alias("mean"), F.avg((F.col("value") > 200).cast("double")).alias("p"))
    t = t.join(exact_quantiles(e, ["event_type"], "x", [0.025, 0.975]), "event_type").withColumns({"low": F.get("q", 0), "high": F.get("q", 1)})
    return t.select("event_type", E.verdict(F.col("low"), F.col("high"), F.col("p"), F.col("mean")).alias("verdict"))


@query("e17_detectable_effect", "WITH s AS (SELECT event_type, stddev_samp(value) AS sd, stddev_samp(value) FILTER (WHERE user_id % 2 = 0) AS r FROM events GROUP BY 1) SELECT event_type, round((1.959964e0 + 0.841621e0) * sd, 4) AS effect, round((1.959964e0 + 0.841621e0) * sqrt(sd * sd + r * r / 3), 4) AS effect_repeat FROM s")
def e17(spark, d):
    s = table(spark, d, "events").groupBy("event_type").agg(F.stddev_samp("value").alias("sd"), F.stddev_samp(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("r"))
    z = 1.959964 + 0.841621
    return s.select("event_type", F.round(z * F.col("sd"), 4).alias("effect"), F.round(z * F.sqrt(F.col("sd") * F.col("sd") + F.col("r") * F.col("r") / 3), 4).alias("effect_repeat"))


@query("e18_sparsity", "SELECT o_orderpriority AS model, quantile_cont(o_custkey % 13, 0.5) AS median, min(o_custkey % 13)::BIGINT AS low, max(o_custkey % 13)::BIGINT AS high FROM orders GROUP BY 1")
def e18(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 13).alias("n"))
    ends = o.groupBy("model").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    return ends.join(exact_quantiles(o, ["model"], "n", [0.5]), "model").select("model", F.get("q", 0).alias("median"), "low", "high")


# F: association

def analysis(spark, d):
    """A row per customer and order status: mean price (the response), market segment (the factor), balance and nation band."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("pair")).agg((F.avg("o_totalprice") / 100000.0).alias("y"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") / 1000.0).alias("age"), (F.col("c_nationkey") % 3).cast("double").alias("grade"))
    return o.join(c, "id")


@query("f01_analysis_table", "SELECT c_custkey AS id, o_orderstatus AS pair, round(avg(o_totalprice) / 100000e0, 4) AS y, c_mktsegment AS segment FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0e0 GROUP BY 1, 2, 4")
def f01(spark, d):
    return analysis(spark, d).filter("age > 0").select("id", "pair", F.round("y", 4).alias("y"), "segment")


OLS = f"WITH {L.ANALYSIS}, {L.coefficients('m', 'a', SEGMENTS[0], 'age', 'grade')}"


@query("f02_ols_by_group", f"{OLS} SELECT pair, term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, n FROM m")
def f02(spark, d):
    """With F03 and F05: standard errors, intervals and contrasts against the first level."""
    return rounded(assoc.model_by_group(analysis(spark, d), ["pair"], "y", "segment", SEGMENTS, ["age", "grade"]))


@query("f03_coefficients", f"{OLS} SELECT pair, term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(p, 6) AS p, n FROM m WHERE term IN ('age', 'grade')")
def f03(spark, d):
    """Coefficients whose term matches a pattern: here the covariates."""
    t = assoc.model_by_group(analysis(spark, d), ["pair"], "y", "segment", SEGMENTS, ["age", "grade"])
    return rounded(t.filter(F.col("term").rlike("^(age|gr.*)$")).select("pair", "term", "estimate", "se", "p", "n"))


TURNED = [SEGMENTS[2], *SEGMENTS[:2], *SEGMENTS[3:]]


@query("f05_contrasts", f"WITH {L.ANALYSIS}, {L.coefficients('m', 'a', TURNED[0], 'age', 'grade')} SELECT pair, term AS level, round(estimate, 6) AS estimate, round(low, 6) AS low, round(high, 6) AS high FROM m WHERE term NOT IN ('age', 'grade', 'intercept')")
def f05(spark, d):
    """Treatment contrasts against another reference level than the first by name."""
    t = assoc.model_by_group(analysis(spark, d), ["pair"], "y", "segment", TURNED, ["age", "grade"])
    return rounded(t.filter(F.col("term").isin(*TURNED)).select("pair", F.col("term").alias("level"), "estimate", "low", "high"))


@query("f04_partial_f", f"WITH {L.ANALYSIS}, {L.f_test('t', 'a', 'pair')} SELECT pair, n, round(f, 6) AS f, df1, df2, round(p, 6) AS p FROM t")
def f04(spark, d):
    return rounded(assoc.f_test_by_group(analysis(spark, d), ["pair"], "y", "segment", SEGMENTS, ["age", "grade"]))


@query("f04_one_way", """WITH a AS (SELECT o_custkey AS id, o_orderstatus AS pair, avg(o_totalprice) / 100000e0 AS y FROM orders GROUP BY 1, 2), g AS (SELECT pair, c_mktsegment, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM a JOIN customer ON c_custkey = id GROUP BY 1, 2),
t AS (SELECT pair, sum(n) AS n, count(*) AS k, sum(s * s / n) AS b, sum(s) AS s, sum(q) AS q FROM g GROUP BY 1) SELECT pair, n::BIGINT AS n, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 4) AS f FROM t""")
def f04_one_way(spark, d):
    return assoc.one_way(analysis(spark, d), ["pair"], "y", "segment").withColumn("f", F.round("f", 4))


@query("f06_bh_whole", "WITH p AS (SELECT event_id, event_type, (value - floor(value)) * (value - floor(value)) AS p FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS m FROM p) SELECT event_id, round(least(1e0, min(p * m / r) OVER (PARTITION BY event_type ORDER BY r DESC)), 6) AS q FROM r")
def f06_whole(spark, d):
    """F06 over all events, by type."""
    part = F.col("value") - F.floor("value")
    p = table(spark, d, "events").select("event_id", "event_type", (part * part).alias("p"))
    return E.benjamini_hochberg(p, "p", ["event_type"]).select("event_id", F.round("q", 6).alias("q"))


BINARY = f"WITH {L.ANALYSIS}, b AS (SELECT * REPLACE (CASE WHEN id % 9 = 0 THEN 'other' ELSE segment END AS segment), (id % 2)::DOUBLE AS grp FROM a), {L.coefficients('m', 'b', SEGMENTS[0], 'grp', 'age')}, g AS (SELECT *, row_number() OVER (ORDER BY p, pair) AS r, count(*) OVER () AS k FROM m WHERE term = 'grp')"


@query("f07_binary_family", f"{BINARY} SELECT pair, term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, n, round(least(1e0, min(p * k / r) OVER (ORDER BY r DESC)), 6) AS q FROM g")
def f07(spark, d):
    """A 0/1 group beside the segment (unknown: other), one family for all pairs, q by Benjamini and Hochberg."""
    a = analysis(spark, d).withColumn("segment", F.when(F.col("id") % 9 == 0, "other").otherwise(F.col("segment"))).withColumn("grp", (F.col("id") % 2).cast("double"))
    t = assoc.model_by_group(a, ["pair"], "y", "segment", [*SEGMENTS, "other"], ["grp", "age"]).filter("term = 'grp'")
    return rounded(E.benjamini_hochberg(t, "p", []))


NULL = f"""WITH {L.ANALYSIS}, {L.permuted(20261020, 1000)}, {L.f_test('t', 'perm', 'pair, permutation')}, r AS (SELECT *, row_number() OVER (PARTITION BY permutation ORDER BY p, pair) AS r, count(*) OVER (PARTITION BY permutation) AS k FROM t),
q AS (SELECT permutation, p, min(p * k / r) OVER (PARTITION BY permutation ORDER BY r DESC) AS q FROM r), per AS (SELECT permutation, max(CASE WHEN q < 0.05e0 THEN 1e0 ELSE 0e0 END) AS hit, sum(p) AS s, count(*) AS n FROM q GROUP BY 1)"""


@query("f08_label_permutations", f"{NULL} SELECT round(avg(hit), 6) AS share_any, round(sum(s) / sum(n), 6) AS mean_p, avg(hit) <= 0.10e0 AND abs(sum(s) / sum(n) - 0.5e0) <= 0.02e0 AS calibrated FROM per")
def f08(spark, d):
    found = assoc.label_permutations(analysis(spark, d), ["pair"], "id", "y", "segment", SEGMENTS, ["age", "grade"], 1000, 20261020)
    return rounded(assoc.calibration(found, ["pair"]))


HALVES = f"WITH {L.ANALYSIS}, h0 AS (SELECT * FROM a WHERE id % 2 = 0), h1 AS (SELECT * FROM a WHERE id % 2 = 1), {L.coefficients('m', 'h0', SEGMENTS[0], 'age', None, 30)}, {L.coefficients('o', 'h1', SEGMENTS[0], 'age', None, 30)}"


@query("f09_replication", f"{HALVES} SELECT pair, term, round(m.estimate, 6) AS estimate, round(o.estimate, 6) AS estimate_2, round(m.p, 6) AS p, round(o.p, 6) AS p_2, sign(m.estimate) = sign(o.estimate) AS same_sign FROM m JOIN o USING (pair, term) WHERE term NOT IN ('intercept', 'age')")
def f09(spark, d):
    a = analysis(spark, d)
    one = assoc.model_by_group(a.filter("id % 2 = 0"), ["pair"], "y", "segment", SEGMENTS, ["age"], 30).filter("term <> 'intercept' AND term <> 'age'")
    two = assoc.model_by_group(a.filter("id % 2 = 1"), ["pair"], "y", "segment", SEGMENTS, ["age"], 30).select("pair", "term", F.col("estimate").alias("estimate_2"), F.col("p").alias("p_2"))
    return rounded(one.join(two, ["pair", "term"]).select("pair", "term", "estimate", "estimate_2", "p", "p_2", (F.signum("estimate") == F.signum("estimate_2")).alias("same_sign")))


@query("f10_sign_test_whole", """WITH s AS (SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal > 4000e0) AS x, count(*) FILTER (WHERE c_acctbal <> 4000e0) AS n FROM customer GROUP BY 1)
SELECT c_mktsegment, x, n, round(sum(exp(lgamma(n + 1e0) - lgamma(i + 1e0) - lgamma(n - i + 1e0) - n * ln(2e0))), 6) AS p FROM s JOIN (SELECT i FROM range(0, (SELECT max(n) + 1 FROM s)) r(i)) ON i >= x AND i <= n GROUP BY 1, 2, 3""")
def f10_whole(spark, d):
    """F10 over all customers, n from the data without values at the centre."""
    over = F.col("c_acctbal") - 4000.0
    s = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.when(over > 0, 1)).alias("x"), F.count(F.when(over != 0, 1)).alias("n"))
    return rounded(s.withColumn("p", sign_tails("x", "n")))


LOKO = "t AS (SELECT event_type AS pair, user_id % 3 AS k, avg(value) - 45e0 AS e, count(*) FILTER (WHERE value > 150e0)::DOUBLE / count(*) AS p FROM events GROUP BY 1, 2)"


@query("f11_leave_one_out", f"WITH {LOKO} SELECT a.pair, a.k, count(*) = 2 AND bool_and(b.p < 0.05e0) AS consistent FROM t a JOIN t b ON a.pair = b.pair AND a.k <> b.k GROUP BY 1, 2")
def f11(spark, d):
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("pair"), (F.col("user_id") % 3).alias("k")).agg(F.avg((F.col("value") > 150).cast("double")).alias("p"))
    b = t.select("pair", F.col("k").alias("k2"), F.col("p").alias("p2"))
    return t.join(b, "pair").filter("k <> k2").groupBy("pair", "k").agg(((F.count("*") == 2) & F.bool_and(F.col("p2") < 0.05)).alias("consistent"))


@query("f12_alternative_comparison", "WITH a AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') - 45e0 AS x, avg(value) FILTER (WHERE event_type = 'click') - 45e0 AS y FROM events GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2e0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS ry, x, y FROM a WHERE x IS NOT NULL AND y IS NOT NULL) SELECT round(corr(rx, ry), 6) AS rho, count(*)::BIGINT AS n, round(avg(CASE WHEN sign(x) = sign(y) THEN 1e0 ELSE 0e0 END), 6) AS same_sign FROM r")
def f12(spark, d):
    mean = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value"))) - 45.0
    a = table(spark, d, "events").groupBy("user_id").agg(mean("view").alias("x"), mean("click").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    same = a.agg(F.round(F.avg((F.signum("x") == F.signum("y")).cast("double")), 6).alias("same_sign"))
    return E.spearman(a, "x", "y", []).select(F.round("rho", 6).alias("rho"), "n").crossJoin(same)


@query("f13_fraction_stats", "WITH f AS (SELECT user_id, user_id % 4 AS grp, count(*) FILTER (WHERE event_type IN ('click', 'view'))::DOUBLE / count(*) AS f FROM events GROUP BY 1) SELECT grp, count(*)::BIGINT AS n, round(avg(f), 6) AS mean, round(quantile_cont(f, 0.5), 6) AS median FROM f GROUP BY 1")
def f13(spark, d):
    f = table(spark, d, "events").groupBy("user_id", (F.col("user_id") % 4).alias("grp")).agg(F.avg(F.col("event_type").isin("click", "view").cast("double")).alias("f"))
    mid = exact_quantiles(f, ["grp"], "f", [0.5]).select("grp", F.round(F.get("q", 0), 6).alias("median"))
    return f.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("mean")).join(mid, "grp")


@query("f14_descriptive", "SELECT event_type, user_id % 3 AS grp, count(*)::BIGINT AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM events GROUP BY 1, 2")
def f14(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("grp"), "value")
    g = e.groupBy("event_type", "grp").agg(F.count("*").alias("n")).join(exact_quantiles(e, ["event_type", "grp"], "value", [0.25, 0.5, 0.75]), ["event_type", "grp"])
    r = lambda c, n: F.round(c, 6).alias(n)
    return g.select("event_type", "grp", "n", r(F.get("q", 1), "median"), r(F.get("q", 0), "q1"), r(F.get("q", 2), "q3"), r(F.get("q", 2) - F.get("q", 0), "iqr"))


@query("f15_outcomes", f"WITH {LOKO} SELECT pair, CASE WHEN count(*) < 3 THEN 'not estimable' WHEN bool_and(e > 0) AND min(p) < 0.05e0 THEN 'pass' ELSE 'fail' END AS outcome FROM t GROUP BY 1")
def f15(spark, d):
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("pair"), (F.col("user_id") % 3).alias("k")).agg((F.avg("value") - 45.0).alias("e"), F.avg((F.col("value") > 150).cast("double")).alias("p"))
    g = t.groupBy("pair").agg(F.count("*").alias("n"), F.bool_and(F.col("e") > 0).alias("all"), F.min("p").alias("p"))
    return g.select("pair", F.when(F.col("n") < 3, "not estimable").when(F.col("all") & (F.col("p") < 0.05), "pass").otherwise("fail").alias("outcome"))


@query("f16_heatmap", "SELECT c_mktsegment, o_orderpriority, round(avg(o_totalprice), 4) AS mean, any_value(q.n)::BIGINT AS n_fast FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderpriority < '3' GROUP BY 1) q ON q.p = o_orderpriority GROUP BY 1, 2")
def f16(spark, d):
    o = table(spark, d, "orders")
    n = o.filter("o_orderpriority < '3'").groupBy("o_orderpriority").agg(F.count("*").alias("n_fast"))
    m = o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").groupBy("c_mktsegment", "o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return m.join(n, "o_orderpriority", "left")


@query("f17_top_per_family", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r FROM events) WHERE r <= 8")
def f17(spark, d):
    w = Window.partitionBy("event_type").orderBy("value", "event_id")
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).filter("r <= 8").select("event_type", "event_id", "value")


@query("f18_report_rows", f"{SUB}, {PAIRS} SELECT printf('C %.3f over %d pairs', avg(score), count(*)) AS line FROM pairs")
def f18(spark, d):
    return E.cindex(subjects(spark, d), []).select(F.format_string("C %.3f over %d pairs", "c", "pairs").alias("line"))
