"""Connected components of an edge table by contraction: every round merges neighbours, so the edges shrink geometrically."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colocus.llm.common import drop, saved


def _upper(live: DataFrame) -> DataFrame:
    """(node, up): of each node's neighbourhood the node of least hash, and of that one's neighbourhood again."""
    both = live.union(live.select("b", "a")).toDF("node", "other")
    key = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("own"))
    least = both.groupBy("node").agg(F.min(key("other")).alias("near"))
    near = least.select("node", F.least("near", key("node"))["own"].alias("up"))
    return near.join(near.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label): every node of the edges (a, b) with the smallest node that it reaches.

    Each round replaces a node by the one of least hash two steps around it and
    drops the edges that become loops: no edge is met again once its ends are
    one. The order of hashes is the same in all rounds, so a node with very many
    neighbours is gone after two. Each round's replacements stay under
    ``folder`` until they are looked up backwards, the last step of which is
    left for the reader. Null ends are left out; loops and repeated edges do no
    harm; no edges give no rows.
    """
    spark = edges.sparkSession
    ends = edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = saved(ends.distinct(), f"{folder}/edges-0")
    loops = live.filter("a = b").select("a")
    live, ups = live.filter("a <> b"), []
    while live.limit(1).count():
        step = len(ups)
        ups.append(saved(_upper(live), f"{folder}/up-{step}"))
        of = lambda c: ups[-1].select(F.col("node").alias(c), F.col("up").alias(f"up_{c}"))  # noqa: B023, E731
        moved = live.join(of("a"), "a").join(of("b"), "b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b"))
        live = saved(moved.filter("a <> b").distinct(), f"{folder}/edges-{step + 1}")
        if step:
            drop(spark, f"{folder}/edges-{step}")
    roots = ups[-1].withColumnRenamed("up", "root") if ups else None
    for up in reversed(ups[:-1]):
        roots = up.join(roots.withColumnRenamed("node", "up"), "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("label"))
    if roots is not None:
        roots = saved(roots, f"{folder}/roots")
        least = roots.groupBy("root").agg(F.min("node").alias("label"))
        alone = roots.join(least, "root").select("node", "label").union(alone.join(roots, "node", "left_anti"))
    labels = saved(alone, f"{folder}/labels")
    drop(spark, *(f"{folder}/{x}" for x in ("edges-0", f"edges-{len(ups)}", "roots", *(f"up-{i}" for i in range(len(ups))))))
    return labels
