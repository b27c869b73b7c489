"""Which classes sit next to each other: enrichment against label permutation, mixing, co-location quotients."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colocus.operators import graph


def with_classes(edges: DataFrame, cells: DataFrame, ends: dict[str, str]) -> DataFrame:
    """edges with the classes of its ends as columns (end: name); edges that have these columns need no join."""
    for end, name in ends.items():
        if name not in edges.columns:
            edges = edges.join(cells.select("image", F.col("cell_id").alias(end), F.col("class").alias(name)), ["image", end])
    return edges


def class_counts(cells: DataFrame) -> DataFrame:
    return cells.filter("class IS NOT NULL").groupBy("image", "class").agg(F.count("*").alias("n_class"))


def class_pairs(cells: DataFrame) -> DataFrame:
    """Every unordered class pair of an image with both class sizes: image, a <= b, n_a, n_b."""
    n = class_counts(cells)
    a = n.select("image", F.col("class").alias("a"), F.col("n_class").alias("n_a"))
    return a.join(n.select("image", F.col("class").alias("b"), F.col("n_class").alias("n_b")), "image").filter("a <= b")


def pair_counts(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges between classes, unordered: image, a <= b, observed (0 where a pair has none)."""
    seen = with_classes(pairs, cells, {"i": "ci", "j": "cj"}).groupBy("image", F.least("ci", "cj").alias("a"), F.greatest("ci", "cj").alias("b")).agg(F.count("*").alias("observed"))
    return class_pairs(cells).join(seen, ["image", "a", "b"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))


def graph_moments(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """image, n cells, m edges, k ordered pairs of edges with a common end."""
    n = cells.filter("class IS NOT NULL").groupBy("image").agg(F.count("*").alias("n"))
    d = graph.degrees(pairs).groupBy("image").agg((F.sum("degree") / 2).cast("long").alias("m"), F.sum(F.col("degree") * (F.col("degree") - 1)).alias("k"))
    return n.join(d, "image", "left").select("image", "n", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("k", F.lit(0)).alias("k"))


def _falling(x: Column, r: int) -> Column:
    out = x.cast("double")
    for i in range(1, r):
        out = out * (x - i)
    return out


def permutation_moments(counts: DataFrame, moments: DataFrame) -> DataFrame:
    """Adds mean and var of the edge count of each class pair when labels are permuted over a fixed graph (exact)."""
    t = counts.join(moments, "image")
    a, b, n, m, k = (F.col(c).cast("double") for c in ("n_a", "n_b", "n", "m", "k"))
    same = F.col("a") == F.col("b")
    ratio = lambda top, r: F.when(_falling(n, r) > 0, top / _falling(n, r)).otherwise(0.0)
    one = ratio(F.when(same, _falling(a, 2)).otherwise(2 * a * b), 2)
    two = ratio(F.when(same, _falling(a, 3)).otherwise(a * b * (a + b - 2)), 3)
    three = ratio(F.when(same, _falling(a, 4)).otherwise(4 * _falling(a, 2) * _falling(b, 2)), 4)
    mean = m * one
    return t.withColumn("mean", mean).withColumn("var", mean + k * two + (m * (m - 1) - k) * three - mean * mean)


def enrichment(cells: DataFrame, pairs: DataFrame, least: int = 5) -> DataFrame:
    """image, a, b, observed, mean, var, z, log_oe. z and log_oe are NULL for classes below ``least`` cells or without variance."""
    t = permutation_moments(pair_counts(cells, pairs), graph_moments(cells, pairs))
    enough = (F.col("n_a") >= least) & (F.col("n_b") >= least)
    z = F.when(enough & (F.col("var") > 1e-9), (F.col("observed") - F.col("mean")) / F.sqrt("var"))
    oe = F.when(enough, F.log2((F.col("observed") + 1) / (F.col("mean") + 1)))
    return t.select("image", "a", "b", "observed", "mean", "var", z.alias("z"), oe.alias("log_oe"))


#: Edges times permutations that one task counts, so that a larger image has more tasks.
TASK_EDGES = 20_000_000


def permuted_counts(cells: DataFrame, edges: DataFrame, permutations: int, seed: int, task_edges: int = TASK_EDGES) -> DataFrame:
    """image, r, a, b, n: in each permutation the edges (p, q) of an image from class a to class b, zeros included; labels dealt by ``dealt``.

    A task takes one image's classes and edges for some of the permutations,
    fewer of them the more edges the image has.
    """
    sides = cells.select("image", F.lit(0).alias("kind"), F.col("cell_id").alias("p"), F.col("cell_id").alias("q"), F.col("class").cast("long").alias("v"))
    both = sides.union(edges.select("image", F.lit(1), "p", "q", F.lit(None).cast("long")))
    sizes = edges.groupBy("image").agg(F.count("*").alias("_m"))
    parts = F.greatest(F.least(F.ceil(F.coalesce("_m", F.lit(0)) * F.lit(permutations / task_edges)), F.lit(permutations)), F.lit(1)).cast("int")
    both = both.join(sizes, "image", "left").withColumn("_parts", parts).drop("_m").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image, block = int(pdf["image"].iloc[0]), -(-permutations // int(pdf["_parts"].iloc[0]))
        first = int(pdf["_block"].iloc[0]) * block
        points, links = pdf[pdf["kind"] == 0].sort_values("p"), pdf[pdf["kind"] == 1]
        ids, (names, label) = points["p"].to_numpy(), np.unique(points["v"].to_numpy(), return_inverse=True)
        i, j, t = np.searchsorted(ids, links["p"].to_numpy()), np.searchsorted(ids, links["q"].to_numpy()), len(names)
        draws = np.arange(first, min(first + block, permutations))
        found = np.empty((len(draws), t * t), np.int64)
        for k, r in enumerate(draws.tolist()):
            x = dealt(label, seed, r, image)
            found[k] = np.bincount(x[i] * t + x[j], minlength=t * t)
        names = names.astype(np.int64)
        return pd.DataFrame({"image": image, "r": np.repeat(draws, t * t), "a": np.tile(np.repeat(names, t), len(draws)), "b": np.tile(names, t * len(draws)), "n": found.reshape(-1)})

    return both.groupBy("image", "_block").applyInPandas(run, "image long, r long, a long, b long, n long")


def permuted_enrichment(cells: DataFrame, pairs: DataFrame, permutations: int, seed: int) -> DataFrame:
    """Monte Carlo mean and sd (ddof 1) of the counts per image and unordered class pair."""
    n = permuted_counts(cells, pairs.select("image", F.col("i").alias("p"), F.col("j").alias("q")), permutations, seed)
    n = n.groupBy("image", "r", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").cast("double").alias("n"))
    return n.groupBy("image", "a", "b").agg(F.avg("n").alias("perm_mean"), F.stddev_samp("n").alias("perm_sd"))


#: A prime below 2^31, so that squares of residues fit 64 bits.
PRIME = 2_147_483_647


def dealt(label: np.ndarray, seed: int, permutation: int, image: int) -> np.ndarray:
    """The labels of an image's cells (by id) in the order of (a x + b)^2 modulo PRIME, x the cell's place; a and b come from the md5 of seed, permutation and image.

    Whole-number arithmetic on places alone, so the draw does not depend on
    partitioning and any engine can repeat it.
    """
    digest = hashlib.md5(f"{seed}-{permutation}-{image}".encode()).hexdigest()
    a, b = 1 + int(digest[:8], 16) % (PRIME - 1), int(digest[8:16], 16) % PRIME
    at = (np.arange(len(label), dtype=np.int64) * a + b) % PRIME
    return label[np.argsort(at * at % PRIME, kind="stable")]


def neighbour_fraction(cells: DataFrame, edges: DataFrame, source: list, target: list) -> DataFrame:
    """image, fraction: of the directed neighbour slots of source cells, those that hold a target cell."""
    own = with_classes(edges, cells, {"src": "a"}).filter(F.col("a").isin(source))
    return with_classes(own, cells, {"dst": "b"}).groupBy("image").agg(F.avg(F.coalesce(F.col("b").isin(target), F.lit(False)).cast("double")).alias("fraction"))


def mixing(cells: DataFrame, pairs: DataFrame, source: list, target: list) -> DataFrame:
    """image, mixing: source-target edges over source-target plus target-target edges; NULL without any."""
    t = with_classes(pairs, cells, {"i": "ci", "j": "cj"})
    i_in, j_in = F.col("ci").isin(target), F.col("cj").isin(target)
    across = (F.col("ci").isin(source) & j_in) | (F.col("cj").isin(source) & i_in)
    n = t.groupBy("image").agg(F.count(F.when(across, 1)).alias("ti"), F.count(F.when(i_in & j_in, 1)).alias("ii"))
    return n.select("image", F.try_divide(F.col("ti").cast("double"), F.col("ti") + F.col("ii")).alias("mixing"))


def weighted_mean(rows: DataFrame, key: str, weight: str, values: list[str]) -> DataFrame:
    """Mean per key by weight over the rows where a value is defined; NULL where none is."""
    return rows.groupBy(key).agg(*[(F.sum(F.col(v) * F.col(weight)) / F.sum(F.when(F.col(v).isNotNull(), F.col(weight)))).alias(v) for v in values])


def clr(counts: DataFrame, key: str, name: str, n: str, pseudocount: float = 0.5) -> DataFrame:
    """Centred log-ratio of long counts: log of count plus pseudocount, less its mean per key."""
    log = F.ln(F.col(n) + F.lit(pseudocount))
    return counts.select(key, name, (log - F.avg(log).over(Window.partitionBy(key))).alias("clr"))


def full_grid(counts: DataFrame, key: str, name: str, names: list, n: str) -> DataFrame:
    """Long counts with a row for every key and name, 0 where there was none."""
    every = counts.select(key).distinct().withColumn(name, F.explode(F.array(*[F.lit(x) for x in names])))
    return every.join(counts, [key, name], "left").withColumn(n, F.coalesce(n, F.lit(0)))


def clq(cells: DataFrame, ks: list[int], least: int = 5, keep_unknown: bool = False, edges: DataFrame | None = None) -> DataFrame:
    """Co-location quotients of ordered class pairs: image, k, a, b, n_a, n_b, n_typed, count, clq, clq_k.

    clq is the mean count of b among the k neighbours of a over b's share of the
    other typed cells; clq_k is clq over k. Both are NULL where a class has
    ``least`` cells or fewer, and an image needs more than max(ks) cells. One
    graph at the largest k serves all. Untyped cells leave before the graph
    unless ``keep_unknown``, then they are neighbours only.
    """
    base = cells if keep_unknown else cells.filter("class IS NOT NULL")
    sizes = base.groupBy("image").agg(F.count("*").alias("n_all"), F.count("class").alias("n_typed")).filter(F.col("n_all") > max(ks))
    base = base.join(sizes.select("image"), "image", "left_semi")
    edges = graph.knn_tiled(base, max(ks)) if edges is None else edges
    t = with_classes(edges, base.filter("class IS NOT NULL"), {"src": "a", "dst": "b"}).filter("a IS NOT NULL AND b IS NOT NULL")
    # one pass: the rank counts for every k from it on
    t = t.groupBy("image", "a", "b").agg(*[F.count(F.when(F.col("rank") <= k, 1)).alias(f"c{k}") for k in ks])
    n = class_counts(base)
    grid = n.select("image", F.col("class").alias("a"), F.col("n_class").alias("n_a")).join(n.select("image", F.col("class").alias("b"), F.col("n_class").alias("n_b")), "image").join(sizes, "image")
    wide = grid.join(t, ["image", "a", "b"], "left")
    long = wide.select("image", "a", "b", "n_a", "n_b", "n_typed", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.coalesce(f"c{k}", F.lit(0)).alias("count")) for k in ks])).alias("p")).select("*", "p.k", "p.count").drop("p")
    enough = (F.col("n_a") > least) & (F.col("n_b") > least)
    others = F.col("n_b") - F.when(F.col("a") == F.col("b"), 1).otherwise(0)
    q = F.when(enough, (F.col("count") / F.col("n_a")) / (others / (F.col("n_typed") - 1)))
    return long.withColumn("clq", q).withColumn("clq_k", q / F.col("k"))


def permuted_clq(cells: DataFrame, k: int, permutations: int, seed: int, least: int = 5) -> DataFrame:
    """image, a, b, clq, perm_mean, perm_sd, percentile, significant, p_two_sided for typed cells, labels permuted per image.

    percentile is the share of permutations below the observed value, with the
    first rank among ties; significant at 0.05 in either tail. The graph is made
    once; tasks take one image and some permutations each, and the rest is sums.
    """
    typed = cells.filter("class IS NOT NULL").withColumn("class", F.col("class").cast("long"))
    seen = clq(typed, [k], least)
    edges = graph.knn_tiled(typed, k).select("image", F.col("src").alias("p"), F.col("dst").alias("q"))
    n = permuted_counts(typed.select("image", "cell_id", "class"), edges, permutations, seed).withColumnRenamed("n", "_n")
    others = F.col("n_b") - F.when(F.col("a") == F.col("b"), 1).otherwise(0)
    x = F.try_divide(F.col("_n").cast("double") / F.col("n_a"), others / (F.col("n_typed") - 1))
    null = n.join(seen.select("image", "a", "b", "n_a", "n_b", "n_typed", "clq"), ["image", "a", "b"]).filter("clq IS NOT NULL").select("image", "a", "b", "clq", x.alias("x"))
    means = null.groupBy("image", "a", "b").agg(F.avg("x").alias("perm_mean"), F.stddev_samp("x").alias("perm_sd"))
    far = F.abs(F.col("x") - F.col("perm_mean")) >= F.abs(F.col("clq") - F.col("perm_mean")) - 1e-12
    tails = null.join(means, ["image", "a", "b"]).groupBy("image", "a", "b").agg(F.avg((F.col("x") < F.col("clq")).cast("double")).alias("percentile"), ((1 + F.count_if(far)) / (1 + F.count("*"))).alias("p_two_sided"))
    t = seen.select("image", "a", "b", "clq").join(means, ["image", "a", "b"], "left").join(tails, ["image", "a", "b"], "left")
    return t.select("image", "a", "b", "clq", "perm_mean", "perm_sd", "percentile", ((F.col("percentile") <= 0.05) | (F.col("percentile") >= 0.95)).alias("significant"), "p_two_sided")
