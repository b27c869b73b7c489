"""From marker values to classes: scaling, expression probabilities, signature scores, thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colocus.operators.ordered import exact_quantiles


@dataclass(frozen=True)
class Kind:
    """A class of a signature: the markers it has (1) and lacks (0), its round, and the class that it refines."""

    name: str
    levels: dict[str, int]
    round: int = 1
    parent: str | None = None


@dataclass(frozen=True)
class Signature:
    """Classes with their markers, checked when made. Each round refines one class of an earlier round."""

    kinds: tuple[Kind, ...]
    markers: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        names = [k.name for k in self.kinds]
        if len(set(names)) < len(names):
            raise ValueError("a class occurs twice")
        for k in self.kinds:
            if not k.levels:
                raise ValueError(f"{k.name}: no informative marker")
            if set(k.levels.values()) - {0, 1}:
                raise ValueError(f"{k.name}: a level is neither 0 nor 1")
            if k.parent is not None and not any(p.name == k.parent and p.round < k.round for p in self.kinds):
                raise ValueError(f"{k.name}: its parent {k.parent} is of no earlier round")
        for r in self.rounds():
            if len({k.parent for k in self.of_round(r)}) > 1:
                raise ValueError(f"round {r} refines more than one class")
        if not self.markers:
            object.__setattr__(self, "markers", tuple(sorted({m for k in self.kinds for m in k.levels})))

    def rounds(self) -> list[int]:
        return sorted({k.round for k in self.kinds})

    def of_round(self, r: int) -> list[Kind]:
        return [k for k in self.kinds if k.round == r]

    def parent_of(self, r: int) -> str | None:
        return self.of_round(r)[0].parent

    @classmethod
    def from_rows(cls, rows: list[dict]) -> Signature:
        """Rows with a class, ``round_parent_number`` in one text, and a level or nothing for each marker."""
        kinds, by_number = [], {}
        for r in rows:
            at, parent, number = (int(x) for x in str(r["level"]).split("_"))
            by_number[number] = r["class"]
            kinds.append((r["class"], at, parent, {m: int(v) for m, v in r.items() if m not in ("class", "level") and v is not None}))
        return cls(tuple(Kind(n, levels, at, by_number.get(parent)) for n, at, parent, levels in kinds))

    def table(self, spark: SparkSession) -> DataFrame:
        """class, class_index, round, parent, marker, level: one row for each informative marker."""
        rows = [(k.name, i, k.round, k.parent, m, v) for i, k in enumerate(self.kinds) for m, v in sorted(k.levels.items())]
        return spark.createDataFrame(rows, "class string, class_index int, round int, parent string, marker string, level int")


def arcsinh(value: Column, cofactor: float = 5.0) -> Column:
    """asinh(value / cofactor); a negative value is an error."""
    if cofactor <= 0:
        raise ValueError("the cofactor must be above 0")
    return F.when(value < 0, F.raise_error(F.lit("negative marker value")).cast("double")).otherwise(F.asinh(value / F.lit(float(cofactor))))


def scaled(rows: DataFrame, how: str) -> DataFrame:
    """rows (.., marker, value) with the value scaled over the whole cohort: none, zscore (sample sd), p99 (99th percentile to 10)."""
    if how == "none":
        return rows
    if how == "zscore":
        stats = rows.groupBy("marker").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
        value = (F.col("value") - F.col("_m")) / F.col("_s")
    elif how == "p99":
        stats = exact_quantiles(rows, ["marker"], "value", [0.99]).select("marker", F.get("q", 0).alias("_p"))
        value = F.col("value") / (F.col("_p") / 10.0)
    else:
        raise ValueError(f"unknown scaling {how}")
    return rows.join(F.broadcast(stats), "marker").withColumn("value", value).select(*rows.columns)


#: Cell ids that one bucket of the zero rule spans; only the bucket in which the rule stops is ranked by row.
ZERO_SPAN = 65_536


def without_some_zeros(rows: DataFrame) -> DataFrame:
    """Drops part of the exact zeros of each marker, by their share: under 0.1 none, under 0.2 all, under 0.5 all but a
    share of 0.05, up to 0.9 all but 0.02, beyond that all. Zeros go in the order of cell_id.

    Zeros are counted by ranges of cell_id first: whole ranges go or stay, and rows are ranked only within a range.
    """
    zero = F.col("value") == 0
    counts = rows.groupBy("marker", F.floor(F.col("cell_id") / ZERO_SPAN).alias("_span")).agg(F.count("*").alias("_n"), F.count_if(zero).alias("_z"))
    by = Window.partitionBy("marker")  # a row per marker and range
    n, z = F.sum("_n").over(by), F.sum("_z").over(by)
    share = z / n
    gone = F.when(share < 0.1, 0).when(share < 0.2, z).when(share < 0.5, F.floor(n * (share - 0.05))).when(share <= 0.9, F.ceil(n * (share - 0.02))).otherwise(z)
    before = F.sum("_z").over(by.orderBy("_span")) - F.col("_z")
    spans = counts.select("marker", "_span", (gone - before).alias("_quota"))
    own = Window.partitionBy("marker", "_span", zero).orderBy("cell_id")
    marked = rows.withColumn("_span", F.floor(F.col("cell_id") / ZERO_SPAN)).join(spans, ["marker", "_span"])
    kept = marked.withColumn("_place", F.row_number().over(own)).filter(~zero | (F.col("_place") > F.col("_quota")))
    return kept.select(*rows.columns)


def crossing(m1: Column, m2: Column, v1: Column, v2: Column) -> Column:
    """Where two equally weighted normal densities are equal: the root between the means, else the one nearest to their middle."""
    a = 0.5 / v2 - 0.5 / v1
    b = m1 / v1 - m2 / v2
    c = 0.5 * (m2 * m2 / v2 - m1 * m1 / v1) + 0.5 * F.ln(v2 / v1)
    mid, disc = 0.5 * (m1 + m2), b * b - 4 * a * c
    low, high = (-b - F.sqrt(disc)) / (2 * a), (-b + F.sqrt(disc)) / (2 * a)
    root = F.when(low.between(m1, m2), low).when(high.between(m1, m2), high).when(F.abs(low - mid) <= F.abs(high - mid), low).otherwise(high)
    return F.when(F.abs(a) < 1e-12, F.coalesce(-F.try_divide(c, b), mid)).when(disc < 0, mid).otherwise(root)


def sigmoid_probability(rows: DataFrame, models: DataFrame) -> DataFrame:
    """ep: the sigmoid of the distance to the marker's crossing point, rescaled to 0-1 per marker; 0 for a constant marker."""
    y = 1.0 / (1.0 + F.exp(F.col("_xc") - F.col("value")))
    t = rows.join(F.broadcast(models.select("marker", F.col("xc").alias("_xc"))), "marker").withColumn("_y", y)
    ends = t.groupBy("marker").agg(F.min("_y").alias("_low"), F.max("_y").alias("_high"))
    span = F.col("_high") - F.col("_low")
    return t.join(F.broadcast(ends), "marker").withColumn("ep", F.when(span > 0, (F.col("_y") - F.col("_low")) / span).otherwise(0.0)).select(*rows.columns, "ep")


def posterior_probability(rows: DataFrame, models: DataFrame) -> DataFrame:
    """ep: the chance of the high component, made monotone: running maximum above the crossing point, minimum below it.

    models: marker, m1, m2, v1, v2, xc. The log ratio of two normal densities is
    a quadratic that turns once, so a running extreme is the value itself, the
    one beside the crossing point, or the extreme of the whole side: one
    aggregation per marker in place of a sort of its cells.
    """
    t = rows.join(models.select("marker", *[F.col(c).alias(f"_{c}") for c in ("m1", "m2", "v1", "v2", "xc")]), "marker")
    x = F.col("value")
    ratio = (-0.5 * F.ln("_v2") - (x - F.col("_m2")) * (x - F.col("_m2")) / (2 * F.col("_v2"))) - (-0.5 * F.ln("_v1") - (x - F.col("_m1")) * (x - F.col("_m1")) / (2 * F.col("_v1")))
    bend = 0.5 / F.col("_v1") - 0.5 / F.col("_v2")
    turn = F.try_divide(F.col("_m1") / F.col("_v1") - F.col("_m2") / F.col("_v2"), 2 * bend)
    t = t.withColumns({"_p": 1.0 / (1.0 + F.exp(-F.greatest(F.least(ratio, F.lit(50.0)), F.lit(-50.0)))), "_right": x >= F.col("_xc"), "_bend": bend, "_turn": turn})
    right, left = F.when(F.col("_right"), F.col("_p")), F.when(~F.col("_right"), F.col("_p"))
    ends = t.groupBy("marker").agg(
        F.max(right).alias("_top"), F.min_by("_p", F.when(F.col("_right"), x)).alias("_after"),
        F.min(left).alias("_floor"), F.max_by("_p", F.when(~F.col("_right"), x)).alias("_before"),
    )
    up = F.when(F.col("_bend") < 0, F.when(x > F.col("_turn"), F.col("_top")).otherwise(F.col("_p"))).otherwise(F.greatest("_p", "_after"))
    down = F.when(F.col("_bend") > 0, F.when(x < F.col("_turn"), F.col("_floor")).otherwise(F.col("_p"))).otherwise(F.least("_p", "_before"))
    ep = F.when(F.col("_right"), F.greatest(up, F.lit(0.5))).otherwise(F.least(down, F.lit(0.5)))
    return t.join(ends, "marker").select(*[t[c] for c in rows.columns], ep.alias("ep"))


def artefacts(ep: DataFrame, high: float = 0.9, low: float = 0.4) -> DataFrame:
    """image, cell_id, artefact: all markers above ``high`` or all below ``low``."""
    return ep.groupBy("image", "cell_id").agg(((F.min("ep") > high) | (F.max("ep") < low)).alias("artefact"))


def scores(ep: DataFrame, signature: DataFrame) -> DataFrame:
    """image, cell_id, class, class_index, z, f: 1 less the mean squared distance to the signature, and its share of the cell's sum."""
    t = ep.join(F.broadcast(signature.select("class", "class_index", "marker", "level")), "marker")
    z = t.groupBy("image", "cell_id", "class", "class_index").agg((1 - F.avg((F.col("ep") - F.col("level")) * (F.col("ep") - F.col("level")))).alias("z"))
    cell = Window.partitionBy("image", "cell_id")
    total = F.sum("z").over(cell)
    return z.withColumn("f", F.when(total > 0, F.col("z") / total).otherwise(1.0 / F.count("*").over(cell)))


def best_class(found: DataFrame) -> DataFrame:
    """image, cell_id, class: the class with the largest f, the first of the signature on ties."""
    best = F.min_by(F.struct("class", "class_index"), F.struct((-F.col("f")).alias("x"), "class_index"))
    return found.groupBy("image", "cell_id").agg(best.alias("_b")).select("image", "cell_id", "_b.class", "_b.class_index")


def accepted(best: DataFrame, ep: DataFrame, signature: DataFrame, high: float, low: float) -> DataFrame:
    """image, cell_id, class: the best class where its present markers reach ``high`` and its absent ones stay within ``low``; else NULL."""
    t = best.join(F.broadcast(signature.select("class", "marker", "level")), "class").join(ep.select("image", "cell_id", "marker", "ep"), ["image", "cell_id", "marker"])
    good = F.when(F.col("level") == 1, F.col("ep") >= high).otherwise(F.col("ep") <= low)
    return t.groupBy("image", "cell_id", "class").agg(F.bool_and(good).alias("_ok")).select("image", "cell_id", F.when(F.col("_ok"), F.col("class")).alias("class"))


def decay(cells: DataFrame, assigned: DataFrame, bandwidth: float = 100.0, factor: float = 5.0) -> DataFrame:
    """image, cell_id, class, beta: factor * (1 - d / bandwidth) to the nearest assigned cell of the class; 0 beyond the bandwidth.

    Cells meet assigned cells of their own and adjacent grid squares of the bandwidth's size.
    """
    square = lambda df: df.withColumn("_bx", F.floor(F.col("x") / bandwidth)).withColumn("_by", F.floor(F.col("y") / bandwidth))
    near = F.sequence(F.lit(-1), F.lit(1))
    a = square(cells.select("image", "cell_id", "x", "y")).withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
    a = a.select("image", "cell_id", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("_bx") + F.col("_dx")).alias("_bx"), (F.col("_by") + F.col("_dy")).alias("_by"))
    b = square(assigned.filter("class IS NOT NULL")).select("image", "_bx", "_by", "class", F.col("x").alias("bx"), F.col("y").alias("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    d = a.join(b, ["image", "_bx", "_by"]).groupBy("image", "cell_id", "class").agg(F.min(F.sqrt(dx * dx + dy * dy)).alias("d")).filter(F.col("d") < bandwidth)
    grid = cells.select("image", "cell_id").crossJoin(assigned.filter("class IS NOT NULL").select("class").distinct())
    return grid.join(d, ["image", "cell_id", "class"], "left").select("image", "cell_id", "class", F.coalesce(factor * (1 - F.col("d") / bandwidth), F.lit(0.0)).alias("beta"))


def neighbour_update(scored: DataFrame, edges: DataFrame, settled: DataFrame, beta: DataFrame) -> DataFrame:
    """One mean-field step: image, cell_id, class, p, the softmax over classes of f + beta * (chances of the settled neighbours of the class).

    scored: image, cell_id, class, f of the cells still open; edges: image, src,
    dst; settled: image, cell_id, class, chance; beta: image, cell_id, class, beta.
    """
    heard = edges.join(settled.select("image", F.col("cell_id").alias("dst"), "class", "chance"), ["image", "dst"]).groupBy("image", F.col("src").alias("cell_id"), "class").agg(F.sum("chance").alias("_heard"))
    t = scored.select("image", "cell_id", "class", "f").join(heard, ["image", "cell_id", "class"], "left").join(beta, ["image", "cell_id", "class"], "left")
    t = t.withColumn("_u", F.col("f") + F.coalesce("beta", F.lit(0.0)) * F.coalesce("_heard", F.lit(0.0)))
    cell = Window.partitionBy("image", "cell_id")
    t = t.withColumn("_e", F.exp(F.col("_u") - F.max("_u").over(cell)))
    return t.select("image", "cell_id", "class", (F.col("_e") / F.sum("_e").over(cell)).alias("p"))


def moved_levels(ep: DataFrame, settled: DataFrame, signature: DataFrame) -> DataFrame:
    """The signature table with each level halfway to the mean probability of the class's settled cells; classes without any keep theirs."""
    mean = ep.join(settled.select("image", "cell_id", "class"), ["image", "cell_id"]).groupBy("class", "marker").agg(F.avg("ep").alias("_m"))
    return signature.join(mean, ["class", "marker"], "left").withColumn("level", (F.coalesce("_m", F.col("level").cast("double")) + F.col("level")) / 2).select(*signature.columns)


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A fixed sample of n rows: the first by the md5 of seed and key, the same however the rows lie.

    Rows are counted by the first four digits of the md5; all below the digits at
    which n is reached stay, and only those with them are put in order.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))).withColumn("_d", F.substring("_h", 1, 4))
    counts, left, last = hashed.groupBy("_d").agg(F.count("*").alias("n")).orderBy("_d").collect(), n, None  # 65,536 rows at most
    for r in counts:
        last = r["_d"]
        if r["n"] >= left:
            break
        left -= r["n"]
    below = hashed.filter(F.col("_d") < F.lit(last))
    return below.unionByName(hashed.filter(F.col("_d") == F.lit(last)).orderBy("_h", key).limit(max(0, left))).select(*rows.columns)
