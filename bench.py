"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

The points are the ``events`` table: an image per user, a class per event type.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colocus import plans
from colocus.operators import assoc, coloc, graph
from colocus.plans import models
from colocus.sources.tables import cells_big

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))


def enrichment(spark: SparkSession, d: str) -> DataFrame:
    cells = cells_big(spark, d)
    return coloc.enrichment(cells, graph.undirected(graph.knn_grouped(cells, 8)))


def enrichment_tiled(spark: SparkSession, d: str) -> DataFrame:
    cells = cells_big(spark, d)
    return coloc.enrichment(cells, graph.undirected(graph.knn_tiled(cells, 8)))


def one_image(spark: SparkSession, d: str) -> DataFrame:
    """All cells in one image, which tiles spread over the tasks."""
    cells = cells_big(spark, d).withColumn("image", F.lit(0).cast("long"))
    return coloc.enrichment(cells, graph.undirected(graph.knn_tiled(cells, 8)))


def label_permutations_50(spark: SparkSession, d: str) -> DataFrame:
    """f08 with 50 of its 1,000 permutations, as in earlier rounds."""
    found = assoc.label_permutations(models.analysis(spark, d), ["pair"], "id", "y", "segment", models.SEGMENTS, ["age", "grade"], 50, 20261020)
    return assoc.calibration(found, ["pair"])


def quotients(spark: SparkSession, d: str) -> DataFrame:
    cells = cells_big(spark, d)
    return coloc.clq(cells, [10, 20, 40], edges=graph.knn_grouped(cells, 40))


def quotients_permuted(spark: SparkSession, d: str) -> DataFrame:
    cells = cells_big(spark, d).withColumn("class", F.ascii(F.substring("class", 1, 1)).cast("long"))
    return coloc.permuted_clq(cells, 20, 100, 20261019)


HEADLINES = {
    "enrichment": enrichment, "enrichment_tiled": enrichment_tiled, "one_image": one_image, "label_permutations_50": label_permutations_50, "quotients": quotients, "quotients_permuted": quotients_permuted,
    **{name: plans.QUERIES[name] for name in ("a09_pivot_first", "a18_chained_joins", "a37_crosstab", "b10_image_features", "c10_scores", "c21_typing", "e04_boot_ci", "e12_logrank", "f06_bh_whole")},
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "4g")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    took = {}
    for name, query in HEADLINES.items():
        began = time.time()
        query(spark, FOLDER).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    n = spark.read.parquet(f"{FOLDER}/events.parquet").count()
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(FOLDER.rstrip("/")), "cells": n, "cells_per_sec_enrichment": round(n / took["enrichment"])}))


if __name__ == "__main__":
    main()
