"""Lineage typing over tables: images of any size spread over all executors.

The same rules as ``mixture.type_image``, whose unit is one image in one task.
Here every step works on the open cells of all images at once: cells that
settled in the step before speak to their listeners through the edge table and
shrink distances square by square; per image only a row of sums is kept. A step's
cells are written to the shared folder, which cuts the lineage of the plan.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colocus.operators import mixture
from colocus.operators.celltype import Kind, Signature
from colocus.operators.graph import knn_tiled, tiles
from colocus.operators.mixture import UNKNOWN, TypingConfig
from colocus.sources.files import scratch

#: Cells of a square; distances that are held at a time.
SQUARE, BLOCK = 256, 500_000
RECORDS = "image long, round int, parent string, candidates long, anchors long, iterations long, assigned long"


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def shares(kinds: list[Kind], markers: tuple[str, ...], level) -> list[Column]:
    """Each class's part of a cell's scores; ``level(k, i)`` is the class's level of its informative marker i."""
    z = []
    for k, kind in enumerate(kinds):
        told = [i for i, m in enumerate(markers) if kind.levels.get(m) in (0, 1)]
        gaps = [F.col(f"ep_{i}") - level(k, i) for i in told]
        z.append(F.lit(1.0) - _total([g * g for g in gaps]) / len(told))
    whole = _total(z)
    return [F.when(whole > 0, x / whole).otherwise(1.0 / len(kinds)) for x in z]


def first_largest(values: list[Column]) -> Column:
    """The place of the largest value, the first of equals."""
    top = F.greatest(*values) if len(values) > 1 else values[0]
    return F.coalesce(*[F.when(v == top, F.lit(k)) for k, v in enumerate(values)])


def permitted(kinds: list[Kind], markers: tuple[str, ...], limits: list[tuple[float, float]], best: Column) -> Column:
    """Whether the markers allow the class at place ``best``: none that it has below the high limit, none that it lacks above the low one."""
    allowed = F.lit(False)
    for k, (kind, (high, low)) in enumerate(zip(kinds, limits, strict=True)):
        rules = [F.col(f"ep_{i}") >= high if kind.levels[m] == 1 else F.col(f"ep_{i}") <= low for i, m in enumerate(markers) if kind.levels.get(m) in (0, 1)]
        allowed = F.when(best == k, reduce(lambda a, b: a & b, rules)).otherwise(allowed)
    return allowed


def in_squares(cells: DataFrame) -> DataFrame:
    """cells with sx and sy, the square of their image that they lie in; squares are so wide that one holds about SQUARE cells."""
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"_{c}0")) / F.col("_w")), F.col("_t") - 1)
    return tiles(cells, SQUARE).select(*cells.columns, at("x").alias("sx"), at("y").alias("sy"))


def reached(cells: DataFrame, settled: DataFrame, bandwidth: float) -> DataFrame:
    """image, kind, sx, sy, tx, ty: squares whose settled cells of a class may hold the nearest one of an open cell in square (tx, ty).

    That is, within the bandwidth and no farther, from box to box, than all of
    another square's cells are. A task sees the boxes of an image, a row for
    some SQUARE cells.
    """
    box = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    asked = cells.groupBy("image", F.lit(-1).alias("kind"), "sx", "sy").agg(*box)
    told = settled.groupBy("image", F.col("kind").cast("int").alias("kind"), "sx", "sy").agg(*box)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, place = pdf["kind"].to_numpy(), pdf[["sx", "sy"]].to_numpy()
        x0, x1, y0, y1 = (pdf[c].to_numpy() for c in ("x0", "x1", "y0", "y1"))
        rest, to, by = np.flatnonzero(kind < 0), [], []
        for k in np.unique(kind[kind >= 0]):
            at = np.flatnonzero(kind == k)
            step = max(1, BLOCK // len(at))
            for low in range(0, len(rest), step):
                own = rest[low : low + step, None]
                least = np.maximum(np.maximum(x0[at] - x1[own], x0[own] - x1[at]), 0) ** 2 + np.maximum(np.maximum(y0[at] - y1[own], y0[own] - y1[at]), 0) ** 2
                most = np.maximum(x1[at] - x0[own], x1[own] - x0[at]) ** 2 + np.maximum(y1[at] - y0[own], y1[own] - y0[at]) ** 2
                i, j = np.nonzero((least <= most.min(axis=1)[:, None]) & (np.sqrt(least) < bandwidth))
                to.append(rest[low + i])
                by.append(at[j])
        to, by = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (to, by))
        return pd.DataFrame({"image": np.full(len(to), pdf["image"].iloc[0], np.int64), "kind": kind[by], "sx": place[by, 0], "sy": place[by, 1], "tx": place[to, 0], "ty": place[to, 1]})

    return asked.unionByName(told).groupBy("image").applyInPandas(run, "image long, kind int, sx long, sy long, tx long, ty long")


def met(cells: DataFrame, settled: DataFrame, bandwidth: float) -> DataFrame:
    """image, cell_id, x, y, kind (-1: open), tx, ty: each square's open cells and the settled ones that may be their nearest."""
    own = cells.select("image", "cell_id", "x", "y", F.lit(-1).alias("kind"), F.col("sx").alias("tx"), F.col("sy").alias("ty"))
    spoken = settled.withColumn("kind", F.col("kind").cast("int")).join(reached(cells, settled, bandwidth), ["image", "kind", "sx", "sy"])
    return own.unionByName(spoken.select(*own.columns))


def distances(cells: DataFrame, settled: DataFrame, bandwidth: float, classes: int) -> DataFrame:
    """image, cell_id, near_<k>: distance to the nearest settled cell of class k within the bandwidth, for cells that have any.

    Both tables have the squares of ``in_squares``; a task takes a square's open
    cells and the settled ones of few squares, however wide the bandwidth is.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, x, y = (pdf[c].to_numpy() for c in ("kind", "x", "y"))
        rest = np.flatnonzero(kind < 0)
        gap = np.full((len(rest), classes), np.inf)
        for k in np.unique(kind[kind >= 0]):
            at = np.flatnonzero(kind == k)
            step = max(1, BLOCK // len(at))
            for low in range(0, len(rest), step):
                own = rest[low : low + step, None]
                dx, dy = x[own] - x[at], y[own] - y[at]
                gap[low : low + step, k] = np.sqrt((dx * dx + dy * dy).min(axis=1))
        heard = (gap < bandwidth).any(axis=1)
        out = pdf.iloc[rest[heard]][["image", "cell_id"]]
        return out.assign(**{f"near_{k}": np.where(gap[heard, k] < bandwidth, gap[heard, k], np.nan) for k in range(classes)})

    schema = "image long, cell_id long, " + ", ".join(f"near_{k} double" for k in range(classes))
    found = met(cells, settled, bandwidth).groupBy("image", "tx", "ty").applyInPandas(run, schema)
    return found.select("image", "cell_id", *[F.nanvl(f"near_{k}", F.lit(None).cast("double")).alias(f"near_{k}") for k in range(classes)])


def type_tables(cells: DataFrame, ep: DataFrame, signature: Signature, config: TypingConfig | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(image, cell_id, label, anchor, artefact, marker_only) and the record of each image and round.

    cells: image, cell_id, x, y; ep: image, cell_id, marker, ep (long). Labels,
    anchors, artefacts and records are those of ``type_image``, up to sums that
    differ in their last digit; a missing marker is an error.
    """
    spark, config = cells.sparkSession, config or TypingConfig()
    folder = folder or scratch(spark, "lineage")
    markers = signature.markers

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    values = [F.max(F.when(F.col("marker") == m, F.col("ep").cast("double"))) for m in markers]
    wide = ep.groupBy("image", "cell_id").agg(*[F.coalesce(v, F.raise_error(F.lit("a marker of the signature is missing")).cast("double")).alias(f"ep_{i}") for i, v in enumerate(values)])
    eps = [F.col(f"ep_{i}") for i in range(len(markers))]
    low, high = (F.least(*eps), F.greatest(*eps)) if len(eps) > 1 else (eps[0], eps[0])
    artefact = F.lit(False) if config.artefact is None else (low > config.artefact[0]) | (high < config.artefact[1])
    base = cells.select("image", "cell_id", "x", "y").join(wide, ["image", "cell_id"]).withColumn("artefact", artefact)
    base = saved(in_squares(base), "cells")
    edges = saved(knn_tiled(base, config.neighbours).select("image", F.col("src").alias("cell_id"), F.col("dst").alias("speaker")), "edges")
    label = base.select("image", "cell_id", F.lit(UNKNOWN).alias("label"), F.lit(False).alias("anchor"), F.lit(UNKNOWN).alias("marker_only"))
    records = []
    for r in signature.rounds():
        kinds, parent = signature.of_round(r), signature.parent_of(r)
        t = len(kinds)
        limits = [config.limits(k.name) for k in kinds]
        members = base.filter("NOT artefact").join(label.filter(F.lit(True) if parent is None else F.col("label") == parent).select("image", "cell_id"), ["image", "cell_id"])
        told = lambda k, i: F.lit(float(kinds[k].levels[markers[i]]))  # noqa: B023, E731
        own = [f"f_{k}" for k in range(t)]
        scored = members.select("image", "cell_id", "x", "y", "sx", "sy", *eps, *[c.alias(f) for c, f in zip(shares(kinds, markers, told), own, strict=True)])
        scored = scored.withColumn("alone", first_largest([F.col(f) for f in own]))
        ready = permitted(kinds, markers, [x[:2] for x in limits], F.col("alone"))
        scored = scored.withColumn("kind", F.when(ready, F.col("alone"))).withColumn("strength", F.when(ready, F.greatest(*own) if t > 1 else F.col(own[0])))
        scored = saved(scored, f"round-{r}/step-0")
        new = scored.filter("kind IS NOT NULL")
        rest = scored.filter("kind IS NULL").select("image", "cell_id", "x", "y", "sx", "sy", *eps, *own, *[F.lit(0.0).alias(f"heard_{k}") for k in range(t)], *[F.lit(None).cast("double").alias(f"gap_{k}") for k in range(t)])
        images = saved(scored.groupBy("image").agg(F.count("*").alias("members"), F.count("kind").alias("anchors")), f"round-{r}/images-0")
        active = images.filter("anchors > 0 AND anchors < members").select("image")
        sums = [F.sum(F.when(F.col("kind") == k, F.col(f"ep_{i}"))).alias(f"s_{k}_{i}") for k in range(t) for i in range(len(markers))]
        sizes = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in range(t)]
        settled, took, step = [new.select("image", "cell_id", "kind", F.lit(0).alias("step"))], [], 0
        sizes_so_far = saved(new.groupBy("image").agg(*sums, *sizes), f"round-{r}/sums-0")
        while step < config.iterations - 1 and active.limit(1).count():
            step += 1
            speak = new.join(active, "image", "left_semi")
            heard = edges.join(speak.select("image", F.col("cell_id").alias("speaker"), "kind", "strength"), ["image", "speaker"]).groupBy("image", "cell_id").agg(*[F.sum(F.when(F.col("kind") == k, F.col("strength"))).alias(f"more_{k}") for k in range(t)])
            listening = rest.join(active, "image", "left_semi")
            near = distances(listening, speak, config.bandwidth, t)
            now = listening.join(heard, ["image", "cell_id"], "left").join(near, ["image", "cell_id"], "left")
            now = now.withColumns({f"heard_{k}": F.col(f"heard_{k}") + F.coalesce(f"more_{k}", F.lit(0.0)) for k in range(t)} | {f"gap_{k}": F.least(f"gap_{k}", f"near_{k}") for k in range(t)})
            if step > 1:
                now = now.join(sizes_so_far, "image")
                moved = lambda k, i: F.when(F.col(f"n_{k}") > 0, (F.col(f"s_{k}_{i}") / F.col(f"n_{k}") + told(k, i)) / 2).otherwise(told(k, i))  # noqa: B023, E731
                now = now.withColumns(dict(zip(own, shares(kinds, markers, moved), strict=True)))
            pull = [F.coalesce(config.factor * (1 - F.col(f"gap_{k}") / config.bandwidth), F.lit(0.0)) * F.col(f"heard_{k}") for k in range(t)]
            now = now.withColumns({f"u_{k}": F.col(own[k]) + pull[k] for k in range(t)})
            u = [F.col(f"u_{k}") for k in range(t)]
            top = F.greatest(*u) if t > 1 else u[0]
            chance = 1.0 / _total([F.exp(x - top) for x in u])
            now = now.withColumn("best", first_largest(u))
            ready = permitted(kinds, markers, [x[2:] for x in limits], F.col("best"))
            now = saved(now.select("image", "cell_id", "x", "y", "sx", "sy", *eps, *own, *[f"heard_{k}" for k in range(t)], *[f"gap_{k}" for k in range(t)], F.when(ready, F.col("best")).alias("kind"), chance.alias("strength")), f"round-{r}/step-{step}")
            new, rest = now.filter("kind IS NOT NULL"), now.filter("kind IS NULL").drop("kind", "strength")
            settled.append(new.select("image", "cell_id", "kind", F.lit(step).alias("step")))
            took.append(active.withColumn("iterations", F.lit(step)))
            counts = now.groupBy("image").agg(F.count("kind").alias("fresh"), F.count_if(F.col("kind").isNull()).alias("open"), *sums, *sizes)
            counts = saved(counts, f"round-{r}/counts-{step}")
            add = [c for c in sizes_so_far.columns if c != "image"]
            both = sizes_so_far.unionByName(counts.select("image", *add))
            sizes_so_far = saved(both.groupBy("image").agg(*[F.sum(c).alias(c) for c in add]), f"round-{r}/sums-{step}")
            active = saved(counts.join(images, "image").filter((F.col("fresh") >= F.lit(config.least_change) * F.col("members")) & (F.col("open") > 0)).select("image"), f"round-{r}/active-{step}")
        found = reduce(DataFrame.unionByName, settled)
        names = F.array(*[F.lit(k.name) for k in kinds])
        update = scored.select("image", "cell_id", F.get(names, F.col("alone")).alias("_alone")).join(found, ["image", "cell_id"], "left").select("image", "cell_id", "_alone", F.get(names, F.col("kind")).alias("_label"), (F.col("step") == 0).alias("_anchor"))
        label = label.join(update, ["image", "cell_id"], "left").select("image", "cell_id", F.coalesce("_label", "label").alias("label"), F.when(F.col("_label").isNotNull(), F.col("_anchor")).otherwise(F.col("anchor")).alias("anchor"), F.coalesce("_alone", "marker_only").alias("marker_only"))
        label = saved(label, f"round-{r}/label")
        assigned = found.groupBy("image").agg(F.count("*").alias("assigned"))
        steps = reduce(DataFrame.unionByName, took).groupBy("image").agg(F.max("iterations").alias("iterations")) if took else images.select("image", F.lit(0).alias("iterations"))
        every = base.select("image").distinct().join(images, "image", "left").join(steps, "image", "left").join(assigned, "image", "left")
        zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
        records.append(every.select("image", F.lit(r).alias("round"), F.lit(parent).cast("string").alias("parent"), zero("members").alias("candidates"), zero("anchors"), zero("iterations"), zero("assigned")))
    typed = label.join(base.select("image", "cell_id", "artefact"), ["image", "cell_id"]).select("image", "cell_id", "label", "anchor", "artefact", "marker_only")
    return typed, reduce(DataFrame.unionByName, records)


def type_cells(cells: DataFrame, ep: DataFrame, signature: Signature, config: TypingConfig | None = None, least_cells: int = 0, most_cells: int = 100_000) -> DataFrame:
    """As ``mixture.type_cells``: images of up to ``most_cells`` cells one to a task, larger ones over tables."""
    sizes = cells.groupBy("image").agg(F.count("*").alias("_n"))
    large = sizes.filter(F.col("_n") > most_cells).select("image")
    if not large.limit(1).count():
        return mixture.type_cells(cells, ep, signature, config, least_cells)
    small = mixture.type_cells(cells.join(large, "image", "left_anti"), ep, signature, config, least_cells)
    own = cells.join(large, "image", "left_semi")
    return small.unionByName(type_tables(own, ep.join(large, "image", "left_semi"), signature, config)[0])
