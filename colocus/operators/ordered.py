"""Order statistics and running totals of groups of any size, without a window or a buffer over a whole group.

Scans cut the order into ranges: rows are ordered inside a range only, and a
small table carries totals from range to range. Quantiles narrow down on the
bins that hold the wanted ranks, pass by pass.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, TimestampNTZType, TimestampType

#: Rows of a range, and the most ranges; beyond that ranges grow and their windows spill.
RANGE_ROWS, MOST_RANGES = 100_000, 4096
#: Values of a group up to which its quantiles are taken from one buffer, and bins of a narrowing pass.
BUFFER_ROWS, BINS = 200_000, 1024


def _same(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join on the columns ``by``, NULL equal to NULL; the right side's copies go."""
    if not by:
        return left.crossJoin(right)
    names = {c: f"_r_{c}" for c in by}
    right = right.withColumnsRenamed(names)
    on = reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[n]) for c, n in names.items()])
    return left.join(right, on, how).drop(*names.values())


def in_ranges(rows: DataFrame, order: str, range_rows: int = RANGE_ROWS) -> DataFrame | None:
    """Adds _range, which rises with the number in column ``order``: equal values share a range, of some ``range_rows`` rows. None if one range would hold all."""
    n = rows.count()
    if n <= range_rows:
        return None
    number = F.col(order).cast("double") + F.lit(0.0)  # no minus zero, which would sort before zero
    parts = min(MOST_RANGES, -(-n // range_rows))
    cuts = sorted(set(rows.agg(F.percentile_approx(number, [i / parts for i in range(1, parts)], 20_000)).first()[0] or []))
    if not cuts:
        return None
    splits = [float("-inf"), *cuts, float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_number", outputCol="_place", handleInvalid="keep").transform(rows.withColumn("_number", number))
    return placed.withColumn("_range", F.coalesce(F.col("_place"), F.lit(-1.0)).cast("int")).drop("_number", "_place")


def by_hash(rows: DataFrame, digest: str, range_rows: int = RANGE_ROWS) -> DataFrame | None:
    """Adds _range from the first digits of a hexadecimal digest, in whose order it rises. None if one range would hold all."""
    parts = min(MOST_RANGES, -(-rows.count() // range_rows))
    if parts <= 1:
        return None
    return rows.withColumn("_range", F.floor(F.conv(F.substring(digest, 1, 4), 16, 10).cast("long") * parts / 65536).cast("int"))


def _carried(ranged: DataFrame, by: list[str], parts: dict[str, Column], back: bool, smallest: bool = False) -> DataFrame:
    """by, _range and what the ranges before (``back``: after) add up to for each name; one row a group and range."""
    total = F.min if smallest else F.sum
    sums = ranged.groupBy(*by, "_range").agg(*[total(c).alias(name) for name, c in parts.items()])
    w = Window.partitionBy(*by).orderBy(F.col("_range").desc() if back else F.col("_range").asc()).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "_range", *[total(F.col(name)).over(w).alias(name) for name in parts])


def running(rows: DataFrame, by: list[str], order: str, sums: dict[str, Column], back: bool = False, smallest: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds the running sum of each expression over its group up to the row's value of ``order`` (a number), equal values included.

    ``back`` runs from the largest value down; ``smallest`` takes minima in place of sums. NULL adds nothing.
    """
    ranged = in_ranges(rows, order, range_rows)
    own = Window.partitionBy(*by, *([] if ranged is None else ["_range"])).orderBy(F.col(order).desc() if back else F.col(order).asc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inner = {n: (F.min if smallest else F.sum)(c).over(own) for n, c in sums.items()}
    if ranged is None:
        return rows.select("*", *[(c if smallest else F.coalesce(c, F.lit(0))).alias(n) for n, c in inner.items()])
    carried = _carried(ranged, by, {f"_c_{n}": c for n, c in sums.items()}, back, smallest)
    t = _same(ranged.withColumns({f"_o_{n}": c for n, c in inner.items()}), carried, [*by, "_range"])
    both = {n: F.least(f"_o_{n}", f"_c_{n}") if smallest else F.coalesce(f"_o_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) for n in sums}
    return t.select(*rows.columns, *[c.alias(n) for n, c in both.items()])


def numbered_by(rows: DataFrame, by: list[str], digest: str, *ties: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds _number from 1 within each group, in the order of a hexadecimal digest and ``ties``."""
    ranged = by_hash(rows, digest, range_rows)
    own = F.row_number().over(Window.partitionBy(*by, *([] if ranged is None else ["_range"])).orderBy(digest, *ties))
    if ranged is None:
        return rows.withColumn("_number", own.cast("long"))
    carried = _carried(ranged, by, {"_before": F.lit(1)}, False)
    t = _same(ranged.withColumn("_own", own), carried, [*by, "_range"])
    return t.select(*rows.columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("long").alias("_number"))


def with_ranks(rows: DataFrame, by: list[str], value: str, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds the rank from 1 of a number in its group; equal values share the mean of their places. Values are counted before they are ordered."""
    at = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    at = running(at, by, value, {"_upto": F.col("_n")}, range_rows=range_rows)
    ranks = at.select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return _same(rows, ranks, [*by, value])


def driver_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table of the JVM: no Python process reads them on executors."""
    kinds = StructType.fromDDL(schema)
    if any(isinstance(f.dataType, (TimestampType, TimestampNTZType)) for f in kinds):
        return spark.createDataFrame(rows, kinds)
    columns = to_arrow_schema(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(columns)], schema=columns), kinds)


def exact_quantiles(rows: DataFrame, by: list[str], value: str, at: list[float], buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """by and q, an array with the interpolated quantile of ``value`` for each share of ``at``; NULL values do not count, a group without any has NULL.

    Groups of up to ``buffer_rows`` values take one buffer each. For larger ones
    (at most rows / buffer_rows groups) every pass counts values in BINS equal
    bins between the ends that are left for a rank and keeps the bin that holds
    it, with its own ends; a pass keeps at least two values apart, and a rank is
    found when both ends are equal.
    """
    v = F.col(value).cast("double")
    t = rows.select(*by, v.alias("_v")).filter("_v IS NOT NULL")
    sizes = t.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    large = sizes.filter(F.col("_n") > buffer_rows).collect()
    plain = rows.groupBy(*by).agg(F.percentile(v, F.array(*map(F.lit, at))).alias("q"))
    if not large:
        return plain
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    key = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    names = [*by, "_rank", "_low", "_high", "_before"]
    schema = f"{key + ', ' if by else ''}_rank long, _low double, _high double, _before long"
    wanted = [(*(r[c] for c in by), rank, r["_low"], r["_high"], 0) for r in large for rank in sorted({int(p * (r["_n"] - 1)) + i for p in at for i in (0, 1)} & set(range(r["_n"])))]
    found: list[tuple] = []
    while wanted:
        found += [w for w in wanted if w[-3] == w[-2]]
        wanted = [w for w in wanted if w[-3] < w[-2]]
        if not wanted:
            break
        open_ = F.broadcast(driver_rows(spark, wanted, schema))  # a row for each rank of a large group
        bin_ = F.least(F.floor((F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * BINS), F.lit(BINS - 1)).cast("int")
        near = _same(t, open_, by).filter(F.col("_v").between(F.col("_low"), F.col("_high"))).withColumn("_bin", bin_)
        bins = near.groupBy(*by, "_rank", "_before", "_bin").agg(F.count("*").alias("_m"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        w = Window.partitionBy(*by, "_rank").orderBy("_bin")  # at most BINS rows
        upto = bins.withColumn("_upto", F.col("_before") + F.sum("_m").over(w))
        hit = upto.filter((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_m") <= F.col("_rank")))
        kept = hit.select(*by, "_rank", F.col("_least").alias("_low"), F.col("_most").alias("_high"), (F.col("_upto") - F.col("_m")).alias("_before"))
        wanted = [tuple(r) for r in kept.select(*names).collect()]
    of = {(*f[: len(by)], f[len(by)]): f[-3] for f in found}
    done = []
    for r in large:
        k = tuple(r[c] for c in by)
        q = []
        for p in at:
            place = p * (r["_n"] - 1)
            low = int(place)
            a, b = of[(*k, low)], of[(*k, min(low + 1, r["_n"] - 1))]
            q.append(a if a == b else a + (place - low) * (b - a))
        done.append((*k, q))
    big = driver_rows(spark, done, f"{key + ', ' if by else ''}q array<double>")
    if not by:
        return big
    names = {c: f"_b_{c}" for c in by}
    gone = big.select(*by).withColumnsRenamed(names)
    on = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(gone[n]) for c, n in names.items()])
    rest = rows.join(F.broadcast(gone), on, "left_anti")
    return rest.groupBy(*by).agg(F.percentile(v, F.array(*map(F.lit, at))).alias("q")).unionByName(big)
