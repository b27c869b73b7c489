"""Linear models per group: coefficients, partial F-tests, label permutations, replication."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colocus.functions import special
from colocus.operators.digests import Digests
from colocus.operators.ordered import MOST_RANGES, running
from colocus.sources.files import scratch


def _types(rows: DataFrame, keys: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def centred(rows: DataFrame, keys: list[str], y: str, factor: str | None, levels: list[str], covariates: list[str]) -> DataFrame:
    """The complete rows with z_0, z_1, ... (covariates, then y) less their group's means m_0, m_1, ..., and level, the factor's place among ``levels`` (0 for any other value)."""
    values = [*covariates, y]
    t = rows.dropna(subset=[*values, *([factor] if factor else [])])
    means = t.groupBy(*keys).agg(*[F.avg(v).alias(f"m_{i}") for i, v in enumerate(values)])
    level = F.lit(0)
    for k, name in enumerate(levels[1:] if factor else [], 1):
        level = F.when(F.col(factor) == name, k).otherwise(level)
    return t.join(means, keys).withColumns({f"z_{i}": F.col(v) - F.col(f"m_{i}") for i, v in enumerate(values)} | {"level": level})


def products(rows: DataFrame, by: list[str], count: int, levels: int, squares: bool = True) -> DataFrame:
    """One row per group: sums by level (n_k, s_k_i), and the means and sums of products (q_i_j) of all its rows. Nothing else of the rows moves."""
    hit = lambda k: F.col("level") == k
    sums = [x for k in range(levels) for x in (F.count(F.when(hit(k), 1)).alias(f"n_{k}"), *[F.coalesce(F.sum(F.when(hit(k), F.col(f"z_{i}"))), F.lit(0.0)).alias(f"s_{k}_{i}") for i in range(count)])]
    whole = [F.first(f"m_{i}").alias(f"m_{i}") for i in range(count)] + [F.sum(F.col(f"z_{i}") * F.col(f"z_{j}")).alias(f"q_{i}_{j}") for i in range(count) for j in range(i, count)]
    return rows.groupBy(*by).agg(*sums, *(whole if squares else []))


def normal_equations(row: dict, levels: int, count: int) -> tuple[np.ndarray, np.ndarray, float, int, np.ndarray]:
    """X'X, X'y, y'y, n and the means, of intercept, levels but the first, covariates; covariates and y less their means."""
    n = np.array([row[f"n_{k}"] for k in range(levels)], float)
    s = np.array([[row[f"s_{k}_{i}"] for i in range(count)] for k in range(levels)], float)
    q = np.array([[row[f"q_{min(i, j)}_{max(i, j)}"] for j in range(count)] for i in range(count)], float)
    d, c = levels, count - 1
    g, b = np.zeros((d + c, d + c)), np.zeros(d + c)
    g[0, 0], b[0] = n.sum(), s[:, c].sum()
    for k in range(1, levels):
        g[k, k] = g[0, k] = g[k, 0] = n[k]
        b[k] = s[k, c]
    g[0, d:] = g[d:, 0] = s[:, :c].sum(axis=0)
    g[1:d, d:], g[d:, 1:d] = s[1:, :c], s[1:, :c].T
    g[d:, d:], b[d:] = q[:c, :c], q[:c, c]
    return g, b, float(q[c, c]), int(n.sum()), np.array([row[f"m_{i}"] for i in range(count)], float)


def solved(g: np.ndarray, b: np.ndarray, yy: float, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], float]:
    """Coefficients (NaN for columns that repeat earlier ones), the inverse over the others, those others, residual sum of squares.

    ``size`` are the columns' own squares: one of which less than 1e-12 is left beside the columns before it repeats them.
    """
    used: list[int] = []
    for j in range(len(b)):
        left = g[j, j] - (g[j, used] @ np.linalg.solve(g[np.ix_(used, used)], g[used, j]) if used else 0.0)
        if left > 1e-12 * size[j]:
            used.append(j)
    beta = np.full(len(b), np.nan)
    inverse = np.linalg.inv(g[np.ix_(used, used)]) if used else np.zeros((0, 0))
    beta[used] = inverse @ b[used]
    return beta, inverse, used, max(0.0, yy - float(beta[used] @ b[used]))


def _sizes(g: np.ndarray, n: int, mean: np.ndarray, levels: int) -> np.ndarray:
    """The squares of the columns before their means were taken off."""
    return g.diagonal() + np.r_[np.zeros(levels), n * mean[:-1] ** 2]


def coefficients(row: dict, levels: list[str], covariates: list[str], least: int) -> pd.DataFrame | None:
    """term, estimate, se, low, high, p, n of a group's model, from its sums."""
    d = max(1, len(levels))
    g, b, yy, n, mean = normal_equations(row, d, len(covariates) + 1)
    if n < least:
        return None
    beta, inverse, used, rss = solved(g, b, yy, _sizes(g, n, mean, d))
    turn = np.eye(len(b))[:, used]
    turn[0] -= np.r_[np.zeros(d), mean[:-1]][used]  # the intercept at covariates of 0
    var = np.full(len(b), np.nan)
    var[[0, *used[1:]]] = ((turn @ inverse) * turn).sum(axis=1)[[0, *used[1:]]]
    beta[0] = mean[-1] + turn[0] @ beta[used]
    df = n - len(used)
    se = np.sqrt(var * rss / df) if df > 0 else np.full(len(beta), np.nan)
    t = special.t_quantile(0.975, df) if df > 0 else np.nan
    p = [special.t_two_sided(e / s, df) if s > 0 else np.nan for e, s in zip(beta, se, strict=True)]
    return pd.DataFrame({"term": ["intercept", *levels[1:], *covariates], "estimate": beta, "se": se, "low": beta - t * se, "high": beta + t * se, "p": p, "n": n})


def partial_f(row: dict, levels: int, count: int) -> dict:
    """F-test of the factor's columns against the model without them, from a group's sums."""
    g, b, yy, n, mean = normal_equations(row, levels, count)
    size = _sizes(g, n, mean, levels)
    _, _, used, full = solved(g, b, yy, size)
    less = [0, *range(levels, len(b))]
    _, _, used0, rest = solved(g[np.ix_(less, less)], b[less], yy, size[less])
    df1, df2 = len(used) - len(used0), n - len(used)
    f = ((rest - full) / df1) / (full / df2) if df1 > 0 and df2 > 0 and full > 0 else np.nan
    return {"n": n, "f": f, "df1": df1, "df2": df2, "p": special.f_tail(f, df1, df2) if np.isfinite(f) else np.nan}


def model_by_group(rows: DataFrame, keys: list[str], y: str, factor: str | None, levels: list[str], covariates: list[str], least: int = 50) -> DataFrame:
    """Coefficients of every group with at least ``least`` complete rows; groups are summed up where their rows lie."""
    names = levels if factor else []
    sums = products(centred(rows, keys, y, factor, names, covariates), keys, len(covariates) + 1, max(1, len(names)))

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in stream:
            for row in pdf.to_dict("records"):
                out = coefficients(row, names, covariates, least)
                if out is not None:
                    for i, k in enumerate(keys):
                        out.insert(i, k, row[k])
                    yield out

    schema = f"{_types(rows, keys)}, term string, estimate double, se double, low double, high double, p double, n long"
    return sums.mapInPandas(run, schema)


def f_test_by_group(rows: DataFrame, keys: list[str], y: str, factor: str, levels: list[str], covariates: list[str], least: int = 50) -> DataFrame:
    """n, f, df1, df2, p of every group with at least ``least`` complete rows."""
    return _tested(products(centred(rows, keys, y, factor, levels, covariates), keys, len(covariates) + 1, len(levels)), keys, _types(rows, keys), len(levels), len(covariates) + 1, least)


def _tested(sums: DataFrame, keys: list[str], types: str, levels: int, count: int, least: int) -> DataFrame:
    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in stream:
            found = [{k: row[k] for k in keys} | partial_f(row, levels, count) for row in pdf.to_dict("records") if sum(row[f"n_{k}"] for k in range(levels)) >= least]
            if found:
                yield pd.DataFrame(found)

    return sums.mapInPandas(run, f"{types}, n long, f double, df1 long, df2 long, p double")


def one_way(rows: DataFrame, keys: list[str], y: str, factor: str) -> DataFrame:
    """The F statistic without covariates, from sums of squares alone."""
    g = rows.groupBy(*keys, factor).agg(F.count("*").alias("_n"), F.sum(y).alias("_s"), F.sum(F.col(y) * F.col(y)).alias("_q"))
    t = g.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count("*").alias("_k"), F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("_b"), F.sum("_s").alias("_t"), F.sum("_q").alias("_q"))
    between, within = F.col("_b") - F.col("_t") * F.col("_t") / F.col("n"), F.col("_q") - F.col("_b")
    return t.select(*keys, "n", (F.try_divide(between, (F.col("_k") - 1).cast("double")) / (within / (F.col("n") - F.col("_k")))).alias("f"))


#: Draws (subjects times permutations) to a range of digests in one round, which one task sorts, and to a round; places to a range at most.
RANGE_DRAWS, ROUND_DRAWS, RANGE_PLACES = 4_000_000, 512_000_000, 65_536
#: Permutations and subjects that are packed together.
BLOCK_PERMUTATIONS, CHUNK_SUBJECTS = 64, 50_000
#: Set, a query removes its shuffle files when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _drawn(batches: Iterator[pa.RecordBatch], seed: int, permutations: range, bits: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each chunk and block of permutations the first of these, and for each of them the first 64 bits of the md5 of seed, permutation and id, the last ``bits`` replaced by the subject's level."""
    whole = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    for low in range(0, whole.num_rows if whole else 0, CHUNK_SUBJECTS):
        chunk = whole.slice(low, CHUNK_SUBJECTS)
        level = chunk.column("level").to_numpy().astype(np.uint64)
        digests = Digests(chunk.column("id").to_pylist())
        for first in range(permutations.start, permutations.stop, BLOCK_PERMUTATIONS):
            yield first, [digests.after(f"{seed}-{b}-") >> np.uint64(bits) << np.uint64(bits) | level for b in range(first, min(first + BLOCK_PERMUTATIONS, permutations.stop))]


def bits_of(level: np.ndarray, bits: int) -> bytes:
    """Levels as bytes, ``bits`` bits each."""
    return np.packbits((level.astype(np.uint16)[:, None] >> np.arange(bits, dtype=np.uint16)).astype(np.uint8) & 1).tobytes()


def levels_of(raw: bytes, bits: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits).reshape(n, bits) @ (1 << np.arange(bits, dtype=np.uint16))


def permuted_sums(base: DataFrame, keys: list[str], id_: str, count: int, levels: int, permutations: int, seed: int, folder: str, range_draws: int = RANGE_DRAWS, round_draws: int = ROUND_DRAWS) -> DataFrame:
    """(keys, permutation, n_k, s_k_i) of rows with ``level`` and z_i, the levels dealt anew to the subjects in each permutation.

    Digests are dealt out by range, eight packed bytes for each subject and
    permutation, in rounds of permutations with some ``round_draws`` of them: a
    round's files go when it ends, so that the disk in use does not grow with
    the permutations. A task sorts one range for all permutations of the round
    and keeps the levels in this order, a few bits each. A range takes nearly
    the same places of every permutation's order, so at the end a task meets the
    rows of these places only. Digests of one permutation that agree in the
    first 64 bits less the few of the level (below 1 in 300 runs of 1,000
    permutations of four million subjects) stand in the order of levels.
    """
    spark = base.sparkSession
    bits = max(1, (levels - 1).bit_length())
    subjects = running(base.select(id_, "level").distinct(), [], id_, {"_place": F.lit(1)})
    subjects.select(id_, "_place", "level").write.parquet(f"{folder}/places")
    places = spark.read.parquet(f"{folder}/places")
    n = places.count()
    at_once = max(1, min(permutations, round_draws // max(n, 1)))
    q = min(16, max(0, (n * at_once // range_draws).bit_length(), (n // RANGE_PLACES).bit_length()))
    parts = 1 << q
    shift = np.uint64(63 - q)
    range_of = lambda k: (k >> np.uint64(1) >> shift).astype(np.uint16)
    chunks = min(MOST_RANGES, max(spark.sparkContext.defaultParallelism, -(-n // CHUNK_SUBJECTS)))
    ids = places.select(F.col(id_).cast("string").alias("id"), "level").repartition(chunks)
    kinds = "range int, first int, sizes binary, levels binary"

    def ordered(these: range) -> DataFrame:
        """range, first permutation, the number of digests of each of these permutations in the range and the levels in their order."""

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for first, own in _drawn(batches, seed, these, bits):
                digests, size = np.concatenate(own), len(own)
                which = range_of(digests)
                digests = digests[np.argsort(which, kind="stable")]
                sizes = np.bincount(which.astype(np.int64) * size + np.repeat(np.arange(size), len(own[0])), minlength=parts * size).reshape(parts, size)
                ends = np.cumsum(sizes.sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array(np.full(parts, first, np.int32)), pa.array([r.astype(np.int32).tobytes() for r in sizes]), pa.array([k.tobytes() for k in np.split(digests, ends[:-1])])], names=["range", "first", "sizes", "draws"])

        def sorted_(own: pd.DataFrame) -> pd.DataFrame:
            of: list[list[np.ndarray]] = [[] for _ in these]
            for first, sizes, raw in own[["first", "sizes", "draws"]].itertuples(index=False):
                for b, k in enumerate(np.split(np.frombuffer(raw, np.uint64), np.cumsum(np.frombuffer(sizes, np.int32))[:-1]), int(first) - these.start):
                    of[b].append(k)
            level = [np.sort(np.concatenate(k)) & np.uint64((1 << bits) - 1) if k else np.zeros(0, np.uint64) for k in of]
            sizes = np.array([len(k) for k in level], np.int32)
            return pd.DataFrame({"range": own["range"].iloc[:1].to_numpy(), "first": np.array([these.start], np.int32), "sizes": [sizes.tobytes()], "levels": [bits_of(np.concatenate(level), bits)]})

        return ids.mapInArrow(packed, "range int, first int, sizes binary, draws binary").groupBy("range").applyInPandas(sorted_, kinds)

    rounds = [range(first, min(first + at_once, permutations)) for first in range(0, permutations, at_once)]
    with _without_leftovers(spark):
        for these in rounds:
            ordered(these).write.parquet(f"{folder}/levels-{these.start}")
    drawn = spark.read.schema(kinds).parquet(*[f"{folder}/levels-{these.start}" for these in rounds])
    width = n / parts

    def before(own: pd.DataFrame) -> pd.DataFrame:
        """What lies before each range in each permutation's order, and how far that strays from the range's share of the places."""
        own = own.sort_values("range")
        sizes = np.array([np.frombuffer(r, np.int32) for r in own["sizes"]], np.int64)
        start = np.cumsum(sizes, axis=0) - sizes
        drift = np.abs(start - own["range"].to_numpy()[:, None] * width).max(axis=1)
        return pd.DataFrame({"range": own["range"], "first": own["first"], "before": [r.tobytes() for r in start], "drift": drift})

    drawn.select("range", "first", "sizes").groupBy("first").applyInPandas(before, "range int, first int, before binary, drift double").write.parquet(f"{folder}/before")
    starts = spark.read.parquet(f"{folder}/before")
    drift = starts.agg(F.max("drift")).first()[0] or 0.0  # how far a range's places stray between permutations
    both = drawn.unionByName(starts.drop("drift"), allowMissingColumns=True)
    at = lambda c: F.least(F.greatest(F.floor(c / F.lit(width)), F.lit(0)), F.lit(parts - 1)).cast("int")
    names = [f"z_{i}" for i in range(count)]
    place = F.col("_place") - 1
    near = base.select(id_, *keys, *names).join(places.select(id_, place.alias("place")), id_).select(F.explode(F.sequence(at(F.col("place") - drift - 1), at(F.col("place") + drift + 1))).alias("range"), "place", *keys, *names)
    sums = [x for k in range(levels) for x in (f"n_{k}", *[f"s_{k}_{i}" for i in range(count)])]
    wide = count + 1

    def summed(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=[*keys, "permutation", *sums])
        start = {int(first): np.frombuffer(raw, np.int64) for first, raw in own.loc[own["before"].notna(), ["first", "before"]].itertuples(index=False)}
        low = int(rows["place"].min())
        groups = rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(rows), int)
        heads = rows[keys].iloc[np.unique(groups, return_index=True)[1]].reset_index(drop=True)
        g = len(heads) if keys else 1
        values = np.zeros((int(rows["place"].max()) - low + 1, g, wide))
        np.add.at(values, (rows["place"].to_numpy() - low, groups), np.c_[np.ones(len(rows)), rows[names].to_numpy(float)])
        values = values.reshape(len(values), g * wide)
        out = np.zeros((permutations, levels, g * wide))
        kinds = np.arange(levels)[:, None]
        for first, sizes, raw in own.loc[own["before"].isna(), ["first", "sizes", "levels"]].itertuples(index=False):
            sizes = np.frombuffer(sizes, np.int32)
            level = np.split(levels_of(raw, bits, int(sizes.sum())), np.cumsum(sizes)[:-1])
            for b, (k, begin) in enumerate(zip(level, start[int(first)] - low, strict=True), int(first)):
                out[b] = (k == kinds).astype(float) @ values[begin : begin + len(k)]
        out = out.reshape(permutations, levels, g, wide).transpose(2, 0, 1, 3).reshape(g * permutations, levels * wide)
        found = pd.DataFrame(out, columns=sums).astype({f"n_{k}": np.int64 for k in range(levels)})
        for i, k in enumerate(keys):
            found.insert(i, k, heads[k].repeat(permutations).to_numpy())
        found.insert(len(keys), "permutation", np.tile(np.arange(permutations), g))
        return found

    schema = f"{_types(base, keys)}, permutation int, " + ", ".join(f"{c} {'long' if c[0] == 'n' else 'double'}" for c in sums)
    found = both.groupBy("range").cogroup(near.groupBy("range")).applyInPandas(summed, schema.removeprefix(", "))
    return found.groupBy(*keys, "permutation").agg(*[F.sum(c).alias(c) for c in sums])


def label_permutations(rows: DataFrame, keys: list[str], id_: str, y: str, factor: str, levels: list[str], covariates: list[str], permutations: int, seed: int, least: int = 50, range_draws: int = RANGE_DRAWS, round_draws: int = ROUND_DRAWS) -> DataFrame:
    """(keys, permutation, f, p): the factor permuted over subjects, alike in all groups; permutation -1 is the data.

    ``id_`` is a number. In permutation b the subject at a place of the order of
    ids gets the factor of the subject at that place of the order of the md5 of
    seed, b and id. A permutation needs the sums by level only, all else is
    summed up once per group.
    """
    spark, folder = rows.sparkSession, scratch(rows.sparkSession, "permutations")
    complete = rows.dropna(subset=[y, factor, *covariates])
    count, types = len(covariates) + 1, _types(rows, keys)
    names = [f"z_{i}" for i in range(count)]
    means = [f"m_{i}" for i in range(count)]
    centred(complete, keys, y, factor, levels, covariates).select(*keys, id_, "level", *names, *means).write.parquet(f"{folder}/base")
    base = spark.read.parquet(f"{folder}/base")
    whole = products(base, keys, count, 1).select(*keys, *means, *[f"q_{i}_{j}" for i in range(count) for j in range(i, count)])
    by_level = products(base.withColumn("permutation", F.lit(-1)), [*keys, "permutation"], count, len(levels), squares=False)
    if permutations:
        by_level = by_level.unionByName(permuted_sums(base, keys, id_, count, len(levels), permutations, seed, folder, range_draws, round_draws))
    tested = _tested(by_level.join(whole, keys), [*keys, "permutation"], f"{types}, permutation int", len(levels), count, least)
    tested.write.parquet(f"{folder}/tested")  # a row per group and permutation, which its readers would draw again
    return spark.read.parquet(f"{folder}/tested").select(*keys, F.col("permutation").cast("long").alias("permutation"), "f", "p")


def calibration(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: share of permutations with a discovery at a false discovery rate of 0.05, mean p under permutation, calibrated."""
    from colocus.operators.evaluate import benjamini_hochberg

    null = found.filter("permutation >= 0")
    q = benjamini_hochberg(null, "p", ["permutation"])
    per = q.groupBy("permutation").agg(F.max((F.col("q") < 0.05).cast("int")).alias("any"), F.sum("p").alias("s"), F.count("*").alias("n"))
    t = per.agg(F.avg("any").alias("share_any"), (F.sum("s") / F.sum("n")).alias("mean_p"))
    return t.withColumn("calibrated", (F.col("share_any") <= 0.10) & (F.abs(F.col("mean_p") - 0.5) <= 0.02))
