"""The feature store of the survival models: a batch job from cells to one long table of features.

    python -m jobs.spatial_features --events PATH --target PATH [--config FILE]

Reads the ``events`` table (a cell each; its user is the image), keeps images with
enough cells and a cell of the required class, builds their neighbour graph once
and writes

* ``target/cells``: the cells of these images, made anew by each run;
* ``target/edges``: the directed neighbours with the classes of both ends, partitioned by ``part`` of the images;
* ``target/features``: image, feature, value, partitioned by ``block``.

Each block is written by itself and replaces its own partition only, so a run
with fewer ``blocks`` renews those and leaves the rest, and a repeated run gives
the same rows. A feature without a value (a class too rare, no pair of the kind)
has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colocus.functions.columns import censored_event, censored_time
from colocus.operators import coloc, graph
from colocus.operators.cohort import crosstab
from colocus.operators.provenance import Run
from colocus.sources.tables import outcomes, points
from jobs.common import command_line, config_of, session

PARTS = 16


def eligible(cells: DataFrame, config: dict) -> DataFrame:
    """The cells of images with at least ``least_cells`` of them and any of the required class."""
    n = cells.groupBy("image").agg(F.count("*").alias("n"), F.count(F.when(F.col("class") == config["required_class"], 1)).alias("required"))
    return cells.join(n.filter((F.col("n") >= config["least_cells"]) & (F.col("required") > 0)).select("image"), "image", "left_semi")


def long(df: DataFrame, features: dict) -> DataFrame:
    """image, feature, value: a row for each expression that has a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), c.cast("double").alias("value")) for name, c in features.items()])).alias("p")
    return df.select("image", pairs).select("image", "p.*").filter("value IS NOT NULL")


def outcome(events: DataFrame, cells: DataFrame, edges: DataFrame, config: dict) -> DataFrame:
    """Time and event of each eligible image, censored at the horizon; images without time under observation have none."""
    own = outcomes(events).withColumnRenamed("user_id", "image").join(cells.select("image").distinct(), "image", "left_semi").filter("time > 0")
    return long(own, {"time": censored_time(F.col("time"), config["horizon"]), "event": censored_event(F.col("event"), F.col("time"), config["horizon"])})


def composition(events: DataFrame, cells: DataFrame, edges: DataFrame, config: dict) -> DataFrame:
    """Centred log-ratios of the class counts, and the number of cells."""
    names = config["classes"]
    counts = crosstab(cells, "image", "class", names)
    log = {c: F.ln(F.col(f"`{c}`") + F.lit(0.5)) for c in names}
    mean = sum(log.values(), F.lit(0.0)) / len(names)
    ratios = long(counts, {f"clr_{c}": log[c] - mean for c in names})
    return ratios.unionByName(long(cells.groupBy("image").agg(F.count("*").alias("n")), {"n_cells": F.col("n")}))


def enrichment(events: DataFrame, cells: DataFrame, edges: DataFrame, config: dict) -> DataFrame:
    """z of each unordered class pair against labels permuted over the graph (exact moments)."""
    z = coloc.enrichment(cells, graph.once(edges, config["neighbours"]))
    return z.select("image", F.concat_ws("_", F.lit("z"), "a", "b").alias("feature"), F.col("z").alias("value")).filter("value IS NOT NULL")


def quotient(events: DataFrame, cells: DataFrame, edges: DataFrame, config: dict) -> DataFrame:
    """Co-location quotient over k of each ordered class pair."""
    q = coloc.clq(cells, [config["quotient_neighbours"]], edges=edges.filter(F.col("rank") <= config["quotient_neighbours"]))
    return q.select("image", F.concat_ws("_", F.lit("clq"), "a", "b").alias("feature"), F.col("clq_k").alias("value")).filter("value IS NOT NULL")


def mixing(events: DataFrame, cells: DataFrame, edges: DataFrame, config: dict) -> DataFrame:
    """How much of the source cells' surroundings is target, by directed slots and by undirected edges."""
    near = F.col("rank") <= config["neighbours"]
    share = long(coloc.neighbour_fraction(cells, edges.filter(near), config["source"], config["target"]), {"fraction": F.col("fraction")})
    return share.unionByName(long(coloc.mixing(cells, graph.once(edges, config["neighbours"]), config["source"], config["target"]), {"mixing": F.col("mixing")}))


BLOCKS = {"outcome": outcome, "composition": composition, "enrichment": enrichment, "quotient": quotient, "mixing": mixing}


def run(spark: SparkSession, events: str, target: str, config: dict) -> Run:
    """Builds the edges and the configured blocks; returns the record of what was read and written."""
    done = Run(spark, "spatial_features")
    table = spark.read.parquet(events).select("event_id", "ts", "user_id", "event_type", "value")
    k = max(config["neighbours"], config["quotient_neighbours"])
    cells = eligible(points(table).filter("image IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"), config)
    cells.write.mode("overwrite").parquet(f"{target}/cells")
    cells = spark.read.schema(cells.schema).parquet(f"{target}/cells")
    edges = graph.knn_tiled(cells, k, label="class").withColumn("part", F.pmod("image", F.lit(PARTS)))

    def put(name: str, by: str):
        return lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{target}/{name}")

    done.write(edges, "edges", f"{target}/edges", lambda df: df.write.mode("overwrite").partitionBy("part").parquet(f"{target}/edges"), digest=False)
    edges = spark.read.schema(edges.schema).parquet(f"{target}/edges")
    for block in config["blocks"]:
        counted = done.read(table, f"events for {block}", events, digest=False) if block == "outcome" else table
        rows = BLOCKS[block](counted, cells, edges, config).withColumn("block", F.lit(block))
        done.write(rows, block, f"{target}/features", put("features", "block"))
    return done


def features(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("image long, feature string, value double, block string").parquet(f"{target}/features")


def main() -> None:
    given = command_line(__doc__.split("\n")[0], "events", "target")
    spark = session("spatial_features")
    try:
        run(spark, given.events, given.target, config_of(__file__, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
