"""Family C: class assignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colocus.operators import agreement as A
from colocus.operators import celltype as T
from colocus.operators import graph
from colocus.operators import lineage as L
from colocus.operators import mixture as M
from colocus.operators.ordered import exact_quantiles
from colocus.plans.registry import query, rounded
from colocus.plans.spatial import knn_sql
from colocus.sources.tables import CELLS_SQL, EXPRESSION_SQL, cells, expression, table

SIGNATURE = T.Signature((
    T.Kind("A", {"m0": 1, "m1": 0}), T.Kind("B", {"m1": 1, "m2": 0}), T.Kind("C", {"m2": 1, "m0": 0}),
    T.Kind("A1", {"m3": 1, "m4": 0}, 2, "A"), T.Kind("A2", {"m4": 1, "m3": 0}, 2, "A"),
))
FIRST = T.Signature(SIGNATURE.kinds[:3])
SIG_SQL = "sig AS (SELECT * FROM (VALUES ('A', 0, 'm0', 1), ('A', 0, 'm1', 0), ('B', 1, 'm1', 1), ('B', 1, 'm2', 0), ('C', 2, 'm2', 1), ('C', 2, 'm0', 0)) v(class, class_index, marker, level))"
VALUES_SQL = f"{EXPRESSION_SQL}, vals AS (SELECT cell_id, image, marker, asinh(value) AS value FROM expression)"
MODELS_SQL = "models AS (SELECT marker, round(quantile_cont(value, 0.25), 6) AS m1, round(quantile_cont(value, 0.75), 6) AS m2, round(var_samp(value) / 4, 6) AS v1, round(var_samp(value) / 2, 6) AS v2, round(quantile_cont(value, 0.5), 6) AS xc FROM vals GROUP BY 1)"
EP_SQL = f"""WITH {VALUES_SQL}, {MODELS_SQL}, y AS (SELECT vals.*, 1 / (1 + exp(xc - value)) AS y FROM vals JOIN models USING (marker)),
ep AS (SELECT cell_id, image, marker, value, round((y - min(y) OVER (PARTITION BY marker)) / (max(y) OVER (PARTITION BY marker) - min(y) OVER (PARTITION BY marker)), 6) AS ep FROM y)"""
SCORE_SQL = f"""{EP_SQL}, {SIG_SQL}, z AS (SELECT image, cell_id, class, class_index, round(1 - avg((ep - level) * (ep - level)), 6) AS z FROM ep JOIN sig USING (marker) GROUP BY 1, 2, 3, 4),
f AS (SELECT *, round(z / sum(z) OVER (PARTITION BY cell_id), 6) AS f FROM z), best AS (SELECT image, cell_id, class, class_index FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY f DESC, class_index) AS r FROM f) WHERE r = 1)"""


def values(spark, d):
    return expression(spark, d).withColumn("value", T.arcsinh(F.col("value"), 1.0))


def models(v):
    q = lambda i, name: F.round(F.get("q", i), 6).alias(name)
    spread = v.groupBy("marker").agg(F.round(F.var_samp("value") / 4, 6).alias("v1"), F.round(F.var_samp("value") / 2, 6).alias("v2"))
    return exact_quantiles(v, ["marker"], "value", [0.25, 0.75, 0.5]).join(spread, "marker").select("marker", q(0, "m1"), q(1, "m2"), "v1", "v2", q(2, "xc"))


def probabilities(spark, d):
    v = values(spark, d)
    return T.sigmoid_probability(v, models(v)).withColumn("ep", F.round("ep", 6))


def scored(spark, d):
    s = T.scores(probabilities(spark, d), FIRST.table(spark)).withColumn("z", F.round("z", 6))
    return s.withColumn("f", F.round(F.col("z") / F.sum("z").over(Window.partitionBy("cell_id")), 6))


@query("c01_arcsinh", f"WITH {EXPRESSION_SQL} SELECT cell_id, marker, round(asinh(value / 5e0), 6) AS value FROM expression")
def c01(spark, d):
    return expression(spark, d).select("cell_id", "marker", F.round(T.arcsinh(F.col("value")), 6).alias("value"))


@query("c02_scaling", f"WITH {VALUES_SQL} SELECT cell_id, marker, round((value - avg(value) OVER (PARTITION BY marker)) / stddev_samp(value) OVER (PARTITION BY marker), 4) AS zscore, round(value / (quantile_cont(value, 0.99) OVER (PARTITION BY marker) / 10), 6) AS p99 FROM vals")
def c02(spark, d):
    v = values(spark, d).select("cell_id", "marker", "value")
    z = T.scaled(v, "zscore").select("cell_id", "marker", F.round("value", 4).alias("zscore"))
    return z.join(T.scaled(v, "p99").select("cell_id", "marker", F.round("value", 6).alias("p99")), ["cell_id", "marker"])


@query("c03_zero_removal", f"""WITH {EXPRESSION_SQL}, e AS (SELECT cell_id, marker, CASE WHEN value < substr(marker, 2)::DOUBLE / 5 THEN 0e0 ELSE value END AS value FROM expression),
s AS (SELECT *, count(*) OVER (PARTITION BY marker) AS n, count(*) FILTER (WHERE value = 0) OVER (PARTITION BY marker) AS z, row_number() OVER (PARTITION BY marker, value = 0 ORDER BY cell_id) AS p FROM e),
g AS (SELECT *, CASE WHEN z::DOUBLE / n < 0.1e0 THEN 0 WHEN z::DOUBLE / n < 0.2e0 THEN z WHEN z::DOUBLE / n < 0.5e0 THEN floor(n * (z::DOUBLE / n - 0.05e0)) WHEN z::DOUBLE / n <= 0.9e0 THEN ceil(n * (z::DOUBLE / n - 0.02e0)) ELSE z END AS gone FROM s)
SELECT marker, count(*)::BIGINT AS n, (count(*) FILTER (WHERE value = 0))::BIGINT AS zeros, sum(CASE WHEN value = 0 THEN cell_id ELSE 0 END)::BIGINT AS ids FROM g WHERE value <> 0 OR p > gone GROUP BY 1""")
def c03(spark, d):
    e = expression(spark, d).withColumn("value", F.when(F.col("value") < F.substring("marker", 2, 9).cast("double") / 5, 0.0).otherwise(F.col("value")))
    zero = F.col("value") == 0
    return T.without_some_zeros(e).groupBy("marker").agg(F.count("*").alias("n"), F.count(F.when(zero, 1)).alias("zeros"), F.sum(F.when(zero, F.col("cell_id")).otherwise(0)).alias("ids"))


#: Binned expectation steps as a recursion; no value of these markers is exactly zero, so nothing is removed before.
MIXTURE_SQL = f"""WITH RECURSIVE {VALUES_SQL}, ends AS (SELECT marker, min(value) AS lo, max(value) AS hi FROM vals GROUP BY 1),
raw AS (SELECT marker, least(floor((value - lo) / (hi - lo) * {M.BINS}), {M.BINS - 1}) AS bin, count(*)::DOUBLE AS n, sum(value) AS s, sum(value * value) AS q FROM vals JOIN ends USING (marker) GROUP BY 1, 2),
mid AS (SELECT marker, sum(n) AS size, sum(s) / sum(n) AS centre FROM raw GROUP BY 1),
z AS MATERIALIZED (SELECT marker, bin, n, s - centre * n AS s, q - 2 * centre * s + centre * centre * n AS q, (s - centre * n) / n AS x, sum(n) OVER (PARTITION BY marker ORDER BY bin) AS upto, size FROM raw JOIN mid USING (marker)),
tot AS MATERIALIZED (SELECT marker, sum(n) AS tn, sum(s) AS ts, sum(q) AS tq, arg_min(x, bin) FILTER (WHERE upto > 0.25e0 * (size - 1)) AS x1, arg_min(x, bin) FILTER (WHERE upto > 0.75e0 * (size - 1)) AS x2 FROM z GROUP BY 1),
em AS (SELECT marker, 0 AS it, x1 AS m1, x2 AS m2, greatest((tq / tn - (ts / tn) ** 2) / 4, 1e-6) AS v1, greatest((tq / tn - (ts / tn) ** 2) / 4, 1e-6) AS v2, -1e300 AS reached, FALSE AS done FROM tot
UNION ALL SELECT marker, it + 1, (ts - us) / greatest(tn - un, 1e-12), us / greatest(un, 1e-12), greatest((tq - uq) / greatest(tn - un, 1e-12) - ((ts - us) / greatest(tn - un, 1e-12)) ** 2, 1e-6), greatest(uq / greatest(un, 1e-12) - (us / greatest(un, 1e-12)) ** 2, 1e-6), ll, ll - reached < 1e-8 * abs(ll)
FROM (SELECT marker, it, reached, tn, ts, tq, sum(c * n) AS un, sum(c * s) AS us, sum(c * q) AS uq, sum(n * (f + greatest(lead, 0) + ln(1 + exp(-abs(lead))))) - tn * ln(2 * pi()) / 2 AS ll
FROM (SELECT *, 1 / (1 + exp(least(-lead, 700e0))) AS c FROM (SELECT *, -((x - m2) ** 2) / (2 * v2) - ln(v2) / 2 - f AS lead FROM (SELECT marker, it, m1, m2, v1, v2, reached, tn, ts, tq, n, s, q, x, -((x - m1) ** 2) / (2 * v1) - ln(v1) / 2 AS f FROM em JOIN z USING (marker) JOIN tot USING (marker) WHERE NOT done AND it < 300))) GROUP BY 1, 2, 3, 4, 5, 6)),
models AS (SELECT marker, least(m1, m2) + centre AS m1, greatest(m1, m2) + centre AS m2, CASE WHEN m1 <= m2 THEN v1 ELSE v2 END AS v1, CASE WHEN m1 <= m2 THEN v2 ELSE v1 END AS v2 FROM (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY it DESC) AS last FROM em) JOIN mid USING (marker) WHERE last = 1)"""
FITTED = "marker, round(m1, 6) AS m1, round(m2, 6) AS m2, round(v1, 6) AS v1, round(v2, 6) AS v2"


@query("c04_mixture_fit", f"{MIXTURE_SQL} SELECT {FITTED} FROM models")
def c04(spark, d):
    return rounded(M.fit_markers(T.without_some_zeros(values(spark, d))))


CROSS_SQL = """cross0 AS (SELECT *, 0.5e0 / v2 - 0.5e0 / v1 AS a, m1 / v1 - m2 / v2 AS b, 0.5e0 * (m2 * m2 / v2 - m1 * m1 / v1) + 0.5e0 * ln(v2 / v1) AS c, 0.5e0 * (m1 + m2) AS mid FROM models),
cross1 AS (SELECT *, b * b - 4 * a * c AS disc FROM cross0), cross2 AS (SELECT *, (-b - sqrt(disc)) / (2 * a) AS lo, (-b + sqrt(disc)) / (2 * a) AS hi FROM cross1)"""


@query("c05_crossing", f"WITH {VALUES_SQL}, {MODELS_SQL}, {CROSS_SQL} SELECT marker, round(CASE WHEN lo BETWEEN m1 AND m2 THEN lo WHEN hi BETWEEN m1 AND m2 THEN hi WHEN abs(lo - mid) <= abs(hi - mid) THEN lo ELSE hi END, 6) AS xc FROM cross2")
def c05(spark, d):
    m = models(values(spark, d))
    return m.select("marker", F.round(T.crossing(F.col("m1"), F.col("m2"), F.col("v1"), F.col("v2")), 6).alias("xc"))


@query("c06_marker_models", f"{MIXTURE_SQL}, {CROSS_SQL} SELECT {FITTED}, round(CASE WHEN lo BETWEEN m1 AND m2 THEN lo WHEN hi BETWEEN m1 AND m2 THEN hi WHEN abs(lo - mid) <= abs(hi - mid) THEN lo ELSE hi END, 6) AS xc FROM cross2")
def c06(spark, d):
    fit = M.fit_markers(T.without_some_zeros(values(spark, d)))
    return rounded(fit.withColumn("xc", T.crossing(F.col("m1"), F.col("m2"), F.col("v1"), F.col("v2"))))


@query("c07_ep_reference", f"{EP_SQL} SELECT cell_id, marker, ep FROM ep")
def c07(spark, d):
    return probabilities(spark, d).select("cell_id", "marker", "ep")


@query("c08_ep_posterior", f"""WITH {VALUES_SQL}, {MODELS_SQL}, p AS (SELECT vals.*, value >= xc AS r, 1 / (1 + exp(-greatest(least((-0.5e0 * ln(v2) - (value - m2) * (value - m2) / (2 * v2)) - (-0.5e0 * ln(v1) - (value - m1) * (value - m1) / (2 * v1)), 50e0), -50e0))) AS p FROM vals JOIN models USING (marker))
SELECT cell_id, marker, round(CASE WHEN r THEN max(greatest(p, 0.5e0)) OVER (PARTITION BY marker, r ORDER BY value) ELSE min(least(p, 0.5e0)) OVER (PARTITION BY marker, r ORDER BY value DESC) END, 6) AS ep FROM p""")
def c08(spark, d):
    v = values(spark, d)
    return T.posterior_probability(v, models(v)).select("cell_id", "marker", F.round("ep", 6).alias("ep"))


@query("c09_artefacts", f"{EP_SQL} SELECT image, cell_id, min(ep) > 0.3e0 OR max(ep) < 0.6e0 AS artefact FROM ep GROUP BY 1, 2")
def c09(spark, d):
    return T.artefacts(probabilities(spark, d), 0.3, 0.6)


@query("c10_scores", f"{SCORE_SQL} SELECT cell_id, class, z, f FROM f")
def c10(spark, d):
    return scored(spark, d).select("cell_id", "class", "z", "f")


def _accept_sql(high: float, low: float) -> str:
    return f"{SCORE_SQL} SELECT b.image, b.cell_id, CASE WHEN bool_and(CASE WHEN level = 1 THEN ep >= {high}e0 ELSE ep <= {low}e0 END) THEN b.class END AS class FROM best b JOIN sig s ON s.class = b.class JOIN ep e ON e.cell_id = b.cell_id AND e.marker = s.marker GROUP BY b.image, b.cell_id, b.class"


def _accept(spark, d, high, low):
    return T.accepted(T.best_class(scored(spark, d)), probabilities(spark, d), FIRST.table(spark), high, low)


@query("c14_assign", _accept_sql(0.3, 0.6))
def c14(spark, d):
    return _accept(spark, d, 0.3, 0.6)


@query("c15_anchors", _accept_sql(0.5, 0.4))
def c15(spark, d):
    return _accept(spark, d, 0.5, 0.4)


@query("c16_marker_only", f"{SCORE_SQL} SELECT image, cell_id, class FROM best")
def c16(spark, d):
    return T.best_class(scored(spark, d)).drop("class_index")


@query("c17_distance_decay", f"""WITH {CELLS_SQL}, a AS (SELECT * FROM cells WHERE class < 3 AND cell_id % 4 = 0), d AS (SELECT c.image, c.cell_id, a.class, min(sqrt((c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y))) AS d FROM cells c JOIN a ON a.image = c.image GROUP BY 1, 2, 3)
SELECT c.image, c.cell_id, k.class, round(CASE WHEN d < 0.4e0 THEN 5 * (1 - d / 0.4e0) ELSE 0e0 END, 6) AS beta FROM cells c CROSS JOIN (SELECT DISTINCT class FROM a) k LEFT JOIN d ON d.cell_id = c.cell_id AND d.class = k.class""")
def c17(spark, d):
    c = cells(spark, d)
    return T.decay(c, c.filter("class < 3 AND cell_id % 4 = 0"), 0.4, 5.0).withColumn("beta", F.round("beta", 6))


#: Settled: cells whose best class has f of 0.36 or more; the rest are open.
SETTLED = f"{SCORE_SQL}, settled AS (SELECT image, cell_id, best.class, f AS chance FROM best JOIN f USING (image, cell_id, class) WHERE f >= 0.36e0)"


def settled(scores):
    best = T.best_class(scores).drop("class_index").join(scores, ["image", "cell_id", "class"])
    return best.filter("f >= 0.36").select("image", "cell_id", "class", F.col("f").alias("chance"))


@query("c18_mean_field", f"""{SETTLED}, {CELLS_SQL}, {knn_sql(5)}, open AS (SELECT f.* FROM f ANTI JOIN settled USING (image, cell_id)),
heard AS (SELECT k.image, src AS cell_id, s.class, sum(chance) AS heard FROM knn k JOIN settled s ON s.image = k.image AND s.cell_id = dst GROUP BY 1, 2, 3),
gap AS (SELECT c.image, c.cell_id, s.class, min(sqrt((c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y))) AS gap FROM cells c JOIN settled s ON s.image = c.image JOIN cells a ON a.cell_id = s.cell_id GROUP BY 1, 2, 3),
u AS (SELECT open.image, open.cell_id, open.class, open.f + CASE WHEN gap < 1e0 THEN 5 * (1 - gap / 1e0) ELSE 0e0 END * coalesce(heard, 0e0) AS u FROM open LEFT JOIN gap ON gap.cell_id = open.cell_id AND gap.class = open.class LEFT JOIN heard ON heard.cell_id = open.cell_id AND heard.class = open.class),
e AS (SELECT *, exp(u - max(u) OVER (PARTITION BY cell_id)) AS e FROM u) SELECT image, cell_id, class, round(e / sum(e) OVER (PARTITION BY cell_id), 6) AS p FROM e""")
def c18(spark, d):
    """One mean-field step on the open cells, over tables of cells and edges."""
    scores, c = scored(spark, d), cells(spark, d)
    done = settled(scores)
    pull = T.decay(c, done.join(c.select("image", "cell_id", "x", "y"), ["image", "cell_id"]), 1.0, 5.0)
    return rounded(T.neighbour_update(scores.join(done, ["image", "cell_id"], "left_anti"), graph.knn_tiled(c, 5), done, pull))


@query("c19_moved_levels", f"{SETTLED} SELECT sig.class, sig.marker, round((coalesce(avg(ep) FILTER (WHERE settled.cell_id IS NOT NULL), any_value(level)) + any_value(level)) / 2, 6) AS level FROM sig LEFT JOIN ep ON ep.marker = sig.marker LEFT JOIN settled ON settled.image = ep.image AND settled.cell_id = ep.cell_id AND settled.class = sig.class GROUP BY 1, 2")
def c19(spark, d):
    """The signature halfway to the settled cells' mean probabilities."""
    return rounded(T.moved_levels(probabilities(spark, d), settled(scored(spark, d)), FIRST.table(spark)).select("class", "marker", "level"))


CONFIG = M.TypingConfig(bandwidth=1.0, anchor=(0.5, 0.4), index=(0.3, 0.7), artefact=(0.95, 0.02))


@query("c20_lineage_rounds")
def c20(spark, d):
    """By image and round: candidates (not artefacts, of the parent class), anchors, steps, and cells that a class of the round took; over tables."""
    return L.type_tables(cells(spark, d), probabilities(spark, d), SIGNATURE, CONFIG)[1]


@query("c21_typing")
def c21(spark, d):
    """C18 to C20 run inside: mean-field steps, signature updates and lineage rounds."""
    return L.type_cells(cells(spark, d), probabilities(spark, d), SIGNATURE, CONFIG)


@query("c22_typing_by_image")
def c22(spark, d):
    """Probabilities from each image's own mixture; images of ten cells or fewer are skipped."""
    v = values(spark, d).withColumn("marker", F.concat("marker", F.lit("@"), F.col("image").cast("string")))
    fit = M.fit_markers(v).withColumn("xc", T.crossing(F.col("m1"), F.col("m2"), F.col("v1"), F.col("v2")))
    ep = T.posterior_probability(v, fit).withColumn("marker", F.split_part("marker", F.lit("@"), F.lit(1)))
    return M.type_cells(cells(spark, d), ep, SIGNATURE, M.TypingConfig(bandwidth=1.0), least_cells=10)


@query("c23_null_safe_agreement", "SELECT count(*)::BIGINT AS n, (count(*) FILTER (WHERE a IS NOT DISTINCT FROM b))::BIGINT AS same FROM (SELECT nullif(o_orderstatus, 'P') AS a, CASE WHEN o_totalprice > 150000e0 THEN 'O' WHEN o_totalprice > 50000e0 THEN 'F' END AS b FROM orders)")
def c23(spark, d):
    price = F.col("o_totalprice")
    t = table(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("a"), F.when(price > 150000, "O").when(price > 50000, "F").alias("b"))
    return t.agg(F.count("*").alias("n"), F.count(F.when(F.col("a").eqNullSafe(F.col("b")), 1)).alias("same"))


@query("c24_fixed_sample", "SELECT event_id, event_type FROM events ORDER BY md5('7-' || event_id::VARCHAR), event_id LIMIT 200")
def c24(spark, d):
    return T.sampled(table(spark, d, "events").select("event_id", "event_type"), "event_id", 200, 7)


LABELLED = "t AS (SELECT quality::VARCHAR AS truth, CASE WHEN doc_id % 7 = 0 THEN 'none' ELSE toxic::VARCHAR END AS label FROM labels)"
AGREE = f"""WITH {LABELLED}, own AS (SELECT * FROM t WHERE label <> 'none'), s AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE truth = label)::DOUBLE AS same FROM own), a AS (SELECT count(*)::DOUBLE AS n_all FROM t),
e AS (SELECT sum(x.c * y.c)::DOUBLE AS e FROM (SELECT truth AS k, count(*) AS c FROM own GROUP BY 1) x JOIN (SELECT label AS k, count(*) AS c FROM own GROUP BY 1) y USING (k))"""


def labelled(spark, d):
    return table(spark, d, "labels").select(F.col("quality").cast("string").alias("truth"), F.when(F.col("doc_id") % 7 == 0, "none").otherwise(F.col("toxic").cast("string")).alias("label"))


@query("c25_kappa", f"{AGREE} SELECT n::BIGINT AS n, round(n / n_all, 6) AS coverage, round(same / n, 6) AS agreement, round((same / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa, round(same / n_all, 6) AS agreement_all FROM s, a, e")
def c25(spark, d):
    out = A.agreement(labelled(spark, d), "truth", "label", "none")
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


PER = f"WITH {LABELLED}, k AS (SELECT unnest(['0', '1']) AS class), p AS (SELECT class, count(*) FILTER (WHERE truth = class) AS nt, count(*) FILTER (WHERE label = class) AS np, count(*) FILTER (WHERE truth = class AND label = class) AS h FROM k, t GROUP BY 1)"


@query("c26_per_class", f"{PER} SELECT class, nt::BIGINT AS n_true, np::BIGINT AS n_label, h::BIGINT AS hits, round(h::DOUBLE / greatest(np, 1), 6) AS precision, round(h::DOUBLE / greatest(nt, 1), 6) AS recall, round(2.0e0 * h / (nt + np), 6) AS f1 FROM p")
def c26(spark, d):
    out = A.per_class(labelled(spark, d), "truth", "label", ["0", "1"])
    return out.select("class", "n_true", "n_label", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("c27_confusion", "SELECT l_returnflag AS truth, (count(*) FILTER (WHERE l_linestatus = 'A'))::BIGINT AS \"as_A\", (count(*) FILTER (WHERE l_linestatus = 'O'))::BIGINT AS \"as_O\" FROM lineitem WHERE l_returnflag IN ('A', 'O') GROUP BY 1")
def c27(spark, d):
    return A.confusion(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["A", "O"])


@query("c28_macro_f1", f"{PER}, m AS (SELECT avg(2.0e0 * h / (nt + np)) AS f FROM p), s AS (SELECT count(*)::DOUBLE AS n_all, count(*) FILTER (WHERE label <> 'none')::DOUBLE AS n, count(*) FILTER (WHERE truth = label)::DOUBLE AS same FROM t) SELECT round(same / n_all, 6) AS accuracy, round(f, 6) AS macro_f1, round(n / n_all, 6) AS coverage, round(same / n, 6) AS accuracy_assigned FROM s, m")
def c28(spark, d):
    out = A.comparison(labelled(spark, d), "truth", "label", ["0", "1"], "none")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("c29_report", f"{PER} SELECT printf('%s precision %.3f recall %.3f support %d', class, h::DOUBLE / greatest(np, 1), h::DOUBLE / greatest(nt, 1), nt) AS line FROM p")
def c29(spark, d):
    out = A.per_class(labelled(spark, d), "truth", "label", ["0", "1"])
    return out.select(F.format_string("%s precision %.3f recall %.3f support %d", "class", "precision", "recall", "n_true").alias("line"))


@query("c30_mean_ep", f"{EP_SQL} SELECT (vec.label % 6)::BIGINT AS class, marker, round(avg(ep), 6) AS ep FROM ep JOIN embeddings vec ON vec_id = cell_id GROUP BY 1, 2")
def c30(spark, d):
    ep = probabilities(spark, d).join(cells(spark, d).select("cell_id", "class"), "cell_id")
    return ep.groupBy("class", "marker").agg(F.round(F.avg("ep"), 6).alias("ep"))


@query("c31_marker_summary", f"WITH {VALUES_SQL}, {MODELS_SQL} SELECT marker, round(avg(value), 6) AS mean, round(xc, 6) AS xc, round(avg(CASE WHEN value > xc THEN 1e0 ELSE 0e0 END), 6) AS share_high FROM vals JOIN models USING (marker) GROUP BY marker, xc")
def c31(spark, d):
    v = values(spark, d)
    t = v.join(models(v).select("marker", "xc"), "marker")
    return t.groupBy("marker", "xc").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg((F.col("value") > F.col("xc")).cast("double")), 6).alias("share_high"))


@query("c32_class_presence", f"{SCORE_SQL} SELECT x.image, x.n::BIGINT AS n, round(a, 6) AS share_a, present_a, round(amb, 6) AS ambiguous FROM (SELECT image, count(*) AS n, avg(CASE WHEN class = 'A' THEN 1e0 ELSE 0e0 END) AS a, bool_or(class = 'A') AS present_a FROM best GROUP BY 1) x JOIN (SELECT image, avg(CASE WHEN ep > 0.3e0 AND ep < 0.7e0 THEN 1e0 ELSE 0e0 END) AS amb FROM ep GROUP BY 1) y USING (image)")
def c32(spark, d):
    is_a = F.col("class") == "A"
    x = T.best_class(scored(spark, d)).groupBy("image").agg(F.count("*").alias("n"), F.round(F.avg(is_a.cast("double")), 6).alias("share_a"), F.bool_or(is_a).alias("present_a"))
    between = (F.col("ep") > 0.3) & (F.col("ep") < 0.7)
    return x.join(probabilities(spark, d).groupBy("image").agg(F.round(F.avg(between.cast("double")), 6).alias("ambiguous")), "image")


@query("c33_decision_rule", "SELECT setting, n, round(mean, 6) AS mean FROM (SELECT o_orderpriority AS setting, count(*)::BIGINT AS n, avg(o_totalprice) AS mean, avg(CASE WHEN o_orderstatus = 'P' THEN 1e0 ELSE 0e0 END) AS filtered FROM orders GROUP BY 1) WHERE filtered < 0.5e0 ORDER BY mean DESC, setting LIMIT 1")
def c33(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("setting")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.avg((F.col("o_orderstatus") == "P").cast("double")).alias("filtered"))
    return g.filter("filtered < 0.5").orderBy(F.col("mean").desc(), "setting").limit(1).select("setting", "n", F.round("mean", 6).alias("mean"))


@query("c34_acceptance", f"{SCORE_SQL} SELECT class, count(*)::BIGINT AS n_images, round(avg(CASE WHEN n >= 10 THEN 1e0 ELSE 0e0 END), 6) AS share, avg(CASE WHEN n >= 10 THEN 1e0 ELSE 0e0 END) >= 0.8e0 AS pass FROM (SELECT image, class, count(*) AS n FROM best GROUP BY 1, 2) WHERE n >= 5 GROUP BY 1")
def c34(spark, d):
    n = T.best_class(scored(spark, d)).groupBy("image", "class").agg(F.count("*").alias("n")).filter("n >= 5")
    share = F.avg((F.col("n") >= 10).cast("double"))
    return n.groupBy("class").agg(F.count("*").alias("n_images"), F.round(share, 6).alias("share"), (share >= 0.8).alias("pass"))


@query("c35_class_share", "SELECT event_type, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def c35(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("c36_marker_z", f"WITH {VALUES_SQL}, m AS (SELECT (vec.label % 6)::BIGINT AS class, marker, avg(value) AS v FROM vals JOIN embeddings vec ON vec_id = cell_id GROUP BY 1, 2) SELECT class, marker, round((v - avg(v) OVER (PARTITION BY marker)) / stddev_samp(v) OVER (PARTITION BY marker), 4) AS z FROM m")
def c36(spark, d):
    m = values(spark, d).join(cells(spark, d).select("cell_id", "class"), "cell_id").groupBy("class", "marker").agg(F.avg("value").alias("v"))
    by = Window.partitionBy("marker")
    return m.select("class", "marker", F.round((F.col("v") - F.avg("v").over(by)) / F.stddev_samp("v").over(by), 4).alias("z"))


@query("c37_nearest_to_median", "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n::BIGINT AS n FROM n ORDER BY abs(n - (SELECT quantile_cont(n, 0.5) FROM n)), user_id LIMIT 1")
def c37(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    gap = n.crossJoin(exact_quantiles(n, [], "n", [0.5]).select(F.get("q", 0).alias("m")))
    best = F.min_by(F.struct("user_id", "n"), F.struct(F.abs(F.col("n") - F.col("m")).alias("g"), "user_id"))
    return gap.agg(best.alias("b")).select("b.*")


@query("c38_nearest_composition", """WITH n AS (SELECT user_id, user_id % 3 AS grp, event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2, 3), m AS (SELECT grp, event_type, quantile_cont(n, 0.5) AS m FROM n GROUP BY 1, 2), g AS (SELECT n.grp, user_id, round(sum((n - m) * (n - m)), 6) AS gap FROM n JOIN m ON m.grp = n.grp AND m.event_type = n.event_type GROUP BY 1, 2)
SELECT grp, user_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY gap, user_id) AS r FROM g) WHERE r = 1""")
def c38(spark, d):
    n = table(spark, d, "events").groupBy("user_id", (F.col("user_id") % 3).alias("grp"), "event_type").agg(F.count("*").cast("double").alias("n"))
    m = exact_quantiles(n, ["grp", "event_type"], "n", [0.5]).select("grp", "event_type", F.get("q", 0).alias("m"))
    gap = n.join(m, ["grp", "event_type"]).groupBy("grp", "user_id").agg(F.round(F.sum((F.col("n") - F.col("m")) * (F.col("n") - F.col("m"))), 6).alias("gap"))
    best = F.min_by(F.struct("user_id", "gap"), F.struct("gap", "user_id"))
    return gap.groupBy("grp").agg(best.alias("b")).select("grp", "b.*")
