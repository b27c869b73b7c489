"""Input tables and the views that the queries work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def null_for_nan(df: DataFrame) -> DataFrame:
    """Missing floating-point values are NULL, never NaN: aggregates then skip them."""
    kinds = dict(df.dtypes)
    return df.select(*[F.nanvl(c, F.lit(None).cast(kinds[c])).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns])


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Points of ten images: image, cell_id, x, y, class (0 to 5)."""
    e = table(spark, folder, "embeddings")
    at = lambda i: F.get("embedding", i).cast("double")
    return e.select((F.col("vec_id") % 10).alias("image"), F.col("vec_id").alias("cell_id"), at(0).alias("x"), at(1).alias("y"), (F.col("label") % 6).cast("long").alias("class"))


CELLS_SQL = "cells AS (SELECT vec_id % 10 AS image, vec_id AS cell_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, (label % 6)::BIGINT AS class FROM embeddings)"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def cells_big(spark: SparkSession, folder: str) -> DataFrame:
    """Points of as many images as there are users: value against time of day, class by event type."""
    return points(table(spark, folder, "events"))


def points(e: DataFrame) -> DataFrame:
    """The points of an ``events`` table."""
    y = (micros(F.col("ts")) % 86_400_000_000) / F.lit(86_400_000_000.0) * 100
    return e.select(F.col("user_id").alias("image"), F.col("event_id").alias("cell_id"), F.col("value").alias("x"), y.alias("y"), F.col("event_type").alias("class"))


CELLS_BIG_SQL = "cells AS (SELECT user_id AS image, event_id AS cell_id, value AS x, (epoch_us(ts) % 86400000000) / 86400000000.0e0 * 100 AS y, event_type AS class FROM events)"


def survival(spark: SparkSession, folder: str) -> DataFrame:
    """One subject per user: event (a purchase over 150), time in days to the first one or the last event, risk, group."""
    return outcomes(table(spark, folder, "events"))


def exact_mean(value: str, digits: int) -> Column:
    """The mean to so many digits, halves up, whatever the order of the rows: a sum of doubles depends on it, and so does the way that a half is rounded.

    Sums are of decimals with ten digits behind the point; means of values that are none (NaN, infinite, from 1e18 on) are those of doubles.
    """
    exact = F.col(value).try_cast("decimal(28,10)")
    mean = F.round(F.try_divide(F.sum(exact), F.count(value).cast("decimal(18,0)")), digits).cast("double")
    return F.when(F.count(exact) == F.count(value), mean).otherwise(F.round(F.avg(value), digits))


def outcomes(e: DataFrame) -> DataFrame:
    """The subjects of an ``events`` table."""
    e = e.withColumn("us", micros(F.col("ts")))
    mean = exact_mean("value", 6)
    hit = (F.col("event_type") == "purchase") & (F.col("value") > 150)
    by = e.groupBy("user_id").agg(F.min("us").alias("t0"), F.min(F.when(hit, F.col("us"))).alias("t1"), F.max("us").alias("t2"), mean.alias("risk"))
    days = (F.coalesce("t1", "t2") - F.col("t0")) / F.lit(86_400_000_000.0)
    return by.select("user_id", F.col("t1").isNotNull().alias("event"), F.round(days, 6).alias("time"), "risk")


SURVIVAL_SQL = """subjects0 AS (SELECT user_id, min(epoch_us(ts)) AS t0, min(CASE WHEN event_type = 'purchase' AND value > 150 THEN epoch_us(ts) END) AS t1, max(epoch_us(ts)) AS t2, avg(value) AS risk FROM events GROUP BY user_id),
subjects AS (SELECT user_id, t1 IS NOT NULL AS event, round((coalesce(t1, t2) - t0) / 86400000000.0e0, 6) AS time, round(risk, 6) AS risk FROM subjects0)"""


def expression(spark: SparkSession, folder: str, markers: int = 6) -> DataFrame:
    """Long marker values of the points: cell_id, image, marker (m0..), value >= 0."""
    e = table(spark, folder, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, markers)).alias("p", "v"))
    return e.select(F.col("vec_id").alias("cell_id"), (F.col("vec_id") % 10).alias("image"), F.concat(F.lit("m"), F.col("p").cast("string")).alias("marker"), F.abs(F.col("v").cast("double")).alias("value"))


EXPRESSION_SQL = "expression AS (SELECT vec_id AS cell_id, vec_id % 10 AS image, 'm' || (p - 1)::VARCHAR AS marker, abs(embedding[p]::DOUBLE) AS value FROM embeddings, range(1, 7) r(p))"
