"""Evaluation as SQL plans: concordance, resampling, Kaplan-Meier, log-rank, ranks, false discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colocus.functions.columns import md5_uniform
from colocus.operators.ordered import exact_quantiles, numbered_by, running, with_ranks


#: Risks this close count as tied.
TIED = 1e-8


def cindex(rows: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Harrell's C by group: c and the (weighted) number of comparable pairs, n log n without a table of pairs.

    i and j are comparable if i has the event and stands before j in the order
    of (time, events first). The places of that order are halved bit by bit: at
    each bit a pair meets in just one node, i in its lower and j in its upper
    half, where a running sum over risks counts the j below i. Groups without a
    comparable pair give no row (without ``by``: NULL and 0).
    """
    w = F.col(weight) if weight else F.lit(1)
    t = rows.select(*by, "time", "event", "risk", w.cast("long").alias("_w")).withColumn("_late", ~F.col("event"))
    places = t.select(*by, "time", "_late").distinct().withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("time", "_late")) - 1)
    most = places.agg(F.max("_place").alias("m")).first()["m"] or 0
    t = t.join(places, [*by, "time", "_late"]).withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(max(0, int(most).bit_length() - 1)))))
    t = t.withColumn("_upper", F.expr("shiftright(_place, _bit) & 1") == 1).filter("event OR _upper").withColumn("_node", F.expr("shiftright(_place, _bit + 1)"))
    t = t.withColumn("_j", F.when(F.col("_upper"), F.col("_w")).otherwise(0))
    node = f"PARTITION BY {', '.join([f'`{c}`' for c in by] + ['_bit', '_node'])}"
    below = F.expr(f"coalesce(sum(_j) OVER ({node} ORDER BY risk RANGE BETWEEN UNBOUNDED PRECEDING AND {TIED * (1 + 1e-6)!r}D PRECEDING), 0)")
    upto = F.expr(f"sum(_j) OVER ({node} ORDER BY risk RANGE BETWEEN UNBOUNDED PRECEDING AND {TIED!r}D FOLLOWING)")
    t = t.withColumns({"_good": below + upto, "_met": F.expr(f"sum(_j) OVER ({node})")}).filter("NOT _upper")
    out = t.groupBy(*by).agg((F.sum(F.col("_w") * F.col("_good")) / 2).alias("_g"), F.coalesce(F.sum(F.col("_w") * F.col("_met")), F.lit(0)).alias("pairs"))
    out = out.select(*by, F.try_divide("_g", "pairs").alias("c"), "pairs")
    return out.filter("pairs > 0") if by else out


def weighted_auc(cases: DataFrame, controls: DataFrame) -> DataFrame:
    """One row: the share of the cases' weight times controls with the case's risk above, ties half. cases (risk, w), controls (risk).

    Both sides are summed by risk first; a running count over the distinct risks replaces the table of pairs.
    """
    sides = cases.select("risk", "w", F.lit(0).alias("n")).unionByName(controls.select("risk", F.lit(0.0).alias("w"), F.lit(1).alias("n")))
    at = sides.groupBy("risk").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    t = running(at, [], "risk", {"upto": F.col("n")}).withColumn("under", F.col("upto") - F.col("n") / 2.0)
    return t.agg(F.try_divide(F.sum(F.col("w") * F.col("under")), F.sum("w") * F.sum("n")).alias("auc"))


def resample_weights(rows: DataFrame, place: str, id_: str, n: int, samples: int, seed: int) -> DataFrame:
    """(sample, id, w): how often each subject is drawn; draw d of a sample is the md5 of seed, sample and d, modulo n."""
    spark = rows.sparkSession
    draws = spark.range(samples).withColumnRenamed("id", "sample").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    hit = F.pmod(md5_uniform(F.lit(f"{seed}-"), F.col("sample").cast("string"), F.lit("-"), F.col("d").cast("string")), F.lit(n))
    w = draws.groupBy("sample", hit.alias(place)).agg(F.count("*").alias("w"))
    return w.join(rows.select(place, id_), place).select("sample", id_, "w")


def bootstrap_cindex(rows: DataFrame, by: list[str], id_: str, weights: DataFrame) -> DataFrame:
    """C of every sample: pairs weigh the product of their subjects' draws, so resamples are shared by all models."""
    return cindex(rows.join(weights.select("sample", id_, "w"), id_), [*by, "sample"], "w").select(*by, "sample", "c")


def interval(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """low, high (2.5 and 97.5 %) and share_above (0) by group."""
    share = rows.groupBy(*by).agg(F.avg((F.col(value) > 0).cast("double")).alias("share_above"))
    ends = exact_quantiles(rows, by, value, [0.025, 0.975])
    return (share.join(ends, by) if by else share.crossJoin(ends)).select(*by, F.get("q", 0).alias("low"), F.get("q", 1).alias("high"), "share_above")


def kaplan_meier(rows: DataFrame, by: list[str]) -> DataFrame:
    """Survival after each time: time, at_risk, deaths, s. Times that end with everybody dead give 0."""
    n = rows.groupBy(*by, "time").agg(F.count("*").alias("_n"), F.count(F.when(F.col("event"), 1)).alias("deaths"))
    t = running(n, by, "time", {"at_risk": F.col("_n")}, back=True)
    left = 1 - F.col("deaths") / F.col("at_risk")
    t = running(t, by, "time", {"_dead": (left <= 0).cast("int"), "_log": F.ln(F.when(left > 0, left))})
    return t.select(*by, "time", "at_risk", "deaths", F.when(F.col("_dead") > 0, 0.0).otherwise(F.exp("_log")).alias("s"))


def log_rank(rows: DataFrame, group: Column) -> DataFrame:
    """One row for two groups: observed and expected events of the true one, variance, chi2, p."""
    n = rows.withColumn("_g", group.cast("int")).groupBy("time").agg(
        F.count("*").alias("n"), F.sum("_g").alias("n1"), F.sum(F.col("event").cast("int")).alias("d"), F.sum(F.col("event").cast("int") * F.col("_g")).alias("d1")
    )
    t = running(n, [], "time", {"r": F.col("n"), "r1": F.col("n1")}, back=True).filter("d > 0")
    share = F.col("r1") / F.col("r")
    var = F.when(F.col("r") > 1, F.col("d") * share * (1 - share) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    sums = t.agg(F.sum("d1").alias("observed"), F.sum(F.col("d") * share).alias("expected"), F.sum(var).alias("variance"))
    gap = F.col("observed") - F.col("expected")
    return sums.withColumn("chi2", gap * gap / F.col("variance"))


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation over the rows that have both values."""
    t = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    t = with_ranks(with_ranks(t, by, x, "_x"), by, y, "_y")
    return t.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))


def benjamini_hochberg(rows: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Adds q: the smallest p * m / rank from the row's rank on, at most 1. Equal p share the last of their ranks, at which the quotient is smallest; without p there is no q."""
    at = rows.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_n"))
    m = at.groupBy(*by).agg(F.sum("_n").alias("_m"))
    at = running(at, by, p, {"_r": F.col("_n")})
    at = (at.join(m, by) if by else at.crossJoin(m)).withColumn("_v", F.col(p) * F.col("_m") / F.col("_r"))
    at = running(at, by, p, {"_q": F.col("_v")}, back=True, smallest=True).select(*by, p, F.least(F.lit(1.0), "_q").alias("q"))
    return rows.join(at, [*by, p], "left")


def breslow_loglik(rows: DataFrame, by: list[str]) -> DataFrame:
    """Partial log-likelihood of a given linear predictor ``risk``."""
    sums = rows.groupBy(*by, "time").agg(F.sum(F.exp("risk")).alias("_w"))
    at = running(sums, by, "time", {"_s": F.col("_w")}, back=True).select(*by, "time", "_s")
    return rows.filter("event").join(at, [*by, "time"]).groupBy(*by).agg(F.sum(F.col("risk") - F.ln("_s")).alias("loglik"))


def folds(rows: DataFrame, id_: str, n: int, seed: int) -> DataFrame:
    """Adds fold: events and non-events are dealt round in the order of the md5 of seed and id."""
    hashed = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_).cast("string"))))
    return numbered_by(hashed, ["event"], "_h", id_).select(*rows.columns, F.pmod(F.col("_number") - 1, F.lit(n)).cast("long").alias("fold"))


def verdict(low: Column, high: Column, p: Column, mean: Column) -> Column:
    """Supported: the interval lies above 0, p is below 0.05 and the mean above 0; refuted: the interval ends at or below 0."""
    return F.when((low > 0) & (p < 0.05) & (mean > 0), "supported").when(high <= 0, "refuted").otherwise("inconclusive")
