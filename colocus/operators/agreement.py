"""How far two labellings agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def agreement(rows: DataFrame, truth: str, label: str, unassigned: str) -> DataFrame:
    """One row: n, coverage, agreement and kappa on assigned rows, agreement on all.

    One pass makes the contingency table; kappa follows from its margins.
    """
    return agreement_of(rows.groupBy(F.col(truth).alias("t"), F.col(label).alias("p")).agg(F.count("*").alias("n")), unassigned)


def agreement_of(table: DataFrame, unassigned: str) -> DataFrame:
    """As agreement, from a contingency table (t, p, n)."""
    table = table.withColumn("on", F.col("p") != unassigned)
    own = table.filter("on")
    rows_t = own.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("nt"))
    rows_p = own.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("np"))
    chance = rows_t.join(rows_p, "c").agg(F.sum(F.col("nt").cast("double") * F.col("np")).alias("e"))
    sums = table.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("on"), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("on") & (F.col("t") == F.col("p")), F.col("n")).otherwise(0)).alias("same"))
    t = sums.crossJoin(chance)
    po = F.try_divide(F.col("same").cast("double"), F.col("n"))
    pe = F.try_divide(F.coalesce("e", F.lit(0.0)), F.col("n").cast("double") * F.col("n"))
    return t.select(F.col("n"), (F.col("n") / F.col("all")).alias("coverage"), po.alias("agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"), (F.col("same") / F.col("all")).alias("agreement_all"))


def per_class(rows: DataFrame, truth: str, label: str, classes: list[str]) -> DataFrame:
    """class, n_true, n_label, hits, precision, recall, f1 for the given classes; a share of nothing is 0."""
    each = rows.select(F.col(truth).alias("t"), F.col(label).alias("p")).groupBy("t", "p").agg(F.count("*").alias("n"))
    sums = each.agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"{k}{i}") for i, name in enumerate(classes) for k, c in (("t", F.col("t") == name), ("p", F.col("p") == name), ("h", (F.col("t") == name) & (F.col("p") == name)))])
    parts = F.array(*[F.struct(F.lit(name).alias("class"), *[F.coalesce(f"{k}{i}", F.lit(0)).alias(v) for k, v in (("t", "n_true"), ("p", "n_label"), ("h", "hits"))]) for i, name in enumerate(classes)])
    long = sums.select(F.explode(parts).alias("x")).select("x.*")
    share = lambda n: F.col("hits") / F.greatest(F.col(n), F.lit(1))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("n_true") + F.col("n_label")), F.lit(0.0))
    return long.select("*", share("n_label").alias("precision"), share("n_true").alias("recall"), f1.alias("f1"))


def confusion(rows: DataFrame, truth: str, label: str, classes: list[str]) -> DataFrame:
    return rows.filter(F.col(truth).isin(classes)).groupBy(F.col(truth).alias("truth")).agg(*[F.count(F.when(F.col(label) == c, 1)).alias(f"as_{c}") for c in classes])


def comparison(rows: DataFrame, truth: str, label: str, classes: list[str], unassigned: str) -> DataFrame:
    """One row: accuracy, macro_f1, coverage, accuracy_assigned."""
    macro = per_class(rows, truth, label, classes).agg(F.avg("f1").alias("macro_f1"))
    a = agreement(rows, truth, label, unassigned)
    return a.crossJoin(macro).select(F.col("agreement_all").alias("accuracy"), "macro_f1", "coverage", F.col("agreement").alias("accuracy_assigned"))
