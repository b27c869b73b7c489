"""Cohort tables: look-ups, pivots, roll-ups, eligibility and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colocus.operators.ordered import exact_quantiles


def last_value_wide(rows: DataFrame, key: str, name: str, value: str, order: str, names: list[str]) -> DataFrame:
    """(key, name, value) rows to one row per key with a column per name; of repeated names the last by ``order`` stays."""
    return rows.groupBy(key).agg(*[F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.col(order))).alias(n) for n in names])


def first_value_wide(rows: DataFrame, key: str, name: str, value: str, order: str, names: list[str]) -> DataFrame:
    """As last_value_wide with the first value by ``order``."""
    return rows.groupBy(key).agg(*[F.min_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.col(order))).alias(n) for n in names])


def crosstab(rows: DataFrame, key: str, name: str, names: list[str], prefix: str = "") -> DataFrame:
    """Counts of each name per key, 0 where it is absent: one aggregation with fixed columns."""
    return rows.groupBy(key).agg(*[F.count(F.when(F.col(name) == n, 1)).alias(f"{prefix}{n}") for n in names])


def rolled_up(rows: DataFrame, key: str, fine: str, mapping: dict, classes: list[str]) -> DataFrame:
    """Counts per key of the classes that the fine values map to."""
    from colocus.functions.columns import recoded

    return crosstab(rows.withColumn("_class", recoded(F.col(fine), mapping)), key, "_class", classes)


def _placed(rows: DataFrame, name: str, bucket: Column, *order: Column | str) -> DataFrame:
    """Adds the place from 0 in a total order; ``bucket`` (a few hundred values) rises with it, so each bucket is sorted by itself and moved up by the sizes of those before."""
    t = rows.withColumn("_b", bucket)
    sizes = t.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))  # one row per bucket
    own = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return t.join(F.broadcast(before), "_b").withColumn(name, (own + F.col("_before")).cast("long")).drop("_b", "_before")


def _range_bucket(rows: DataFrame, column: str, cuts: int = 200) -> Column:
    """How many of ``cuts`` cut points, picked by hash among the column's values, lie at or below the value; 0 for null."""
    values = rows.select(F.col(column).alias("v")).filter("v IS NOT NULL").distinct().orderBy(F.xxhash64("v"), "v").limit(cuts).collect()
    if not values:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(r["v"]) for r in values]), lambda cut: cut <= F.col(column))), F.lit(0))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """row_id from 0 in a total order of the rows, sorted range by range of the first column."""
    return _placed(rows, "row_id", _range_bucket(rows, order[0]), *order)


def chained(tables: list[DataFrame], key: str) -> DataFrame:
    """Inner joins of tables on one key."""
    return reduce(lambda a, b: a.join(b, key), tables)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of the left table that the right one lacks; empty when a join keeps every row."""
    return left.select(key).join(right.select(key), key, "left_anti")


def mutation_status(samples: DataFrame, genes: DataFrame, hits: DataFrame, panel: DataFrame) -> DataFrame:
    """sample, gene, status: 1 with a hit, 0 without, NULL where the gene is not on the sample's panel.

    samples (sample, panel), genes (gene; a few), hits (sample, gene), panel
    (panel, gene); a sample without a panel was sequenced in full.
    """
    grid = samples.crossJoin(genes)
    hit = hits.select("sample", "gene").distinct().withColumn("_hit", F.lit(1))
    on = panel.select("panel", "gene").distinct().withColumn("_on", F.lit(1))
    found = grid.join(hit, ["sample", "gene"], "left").join(on, ["panel", "gene"], "left")
    status = F.when(F.col("_on").isNull() & F.col("panel").isNotNull(), None).when(F.col("_hit") == 1, 1.0).otherwise(0.0)
    return found.select("sample", "gene", status.alias("status"))


def shuffled_jointly(rows: DataFrame, key: str, columns: list[str], seed: int) -> DataFrame:
    """Moves the given columns together to other rows, by the order of a hash of seed and key; both orders are taken range by range."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    place = _placed(rows.drop(*columns), "_place", _range_bucket(rows, key), key)
    moved = _placed(rows.select(key, *columns).withColumn("_h", digest), "_place", F.substring("_h", 1, 2), "_h", key)
    return place.join(moved.select("_place", *columns), "_place").drop("_place")


def cohort_summary(rows: DataFrame, key: str, numbers: list[str]) -> DataFrame:
    """One row: rows, distinct keys, and the median and missing count of each number."""
    aggs = [F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys")]
    aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"missing_{c}") for c in numbers]
    medians = [exact_quantiles(rows, [], c, [0.5]).select(F.round(F.get("q", 0), 6).alias(f"median_{c}")) for c in numbers]
    return reduce(DataFrame.crossJoin, medians, rows.agg(*aggs)).select("n_rows", "n_keys", *[x for c in numbers for x in (f"median_{c}", f"missing_{c}")])


def screen(rows: DataFrame, columns: list[str], least: int = 10) -> DataFrame:
    """column, n_zero, n_one, keep: a 0/1 column stays if both values occur at least ``least`` times."""
    counts = rows.agg(*[f for c in columns for f in (F.count(F.when(F.col(c) == 0, 1)).alias(f"{c}_0"), F.count(F.when(F.col(c) == 1, 1)).alias(f"{c}_1"))])
    parts = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}_0").alias("n_zero"), F.col(f"{c}_1").alias("n_one")) for c in columns])
    long = counts.select(F.explode(parts).alias("p")).select("p.*")
    return long.withColumn("keep", F.least("n_zero", "n_one") >= least)
