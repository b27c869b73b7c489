"""Class counts per image, kept up while cells arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CELLS = "image long, cell_id long, x double, y double, class long"


def arriving_cells(spark: SparkSession, folder: str, files_each: int = 16) -> DataFrame:
    """A stream of the Parquet files of cells that arrive in a folder."""
    return spark.readStream.schema(CELLS).option("maxFilesPerTrigger", files_each).parquet(folder)


def arrivals(spark: SparkSession, path: str, files_each: int = 16) -> DataFrame:
    """A stream of the Parquet files under a path, which may also be a single file; the schema is that of the files that are there."""
    there = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", files_each)
    alone = [f.rpartition("/")[2] for f in there.inputFiles()] == [name]
    return stream.option("pathGlobFilter", name).parquet(folder) if alone else stream.parquet(path)


def class_counts(cells: DataFrame, classes: list[int]) -> DataFrame:
    """Counts of each class per image over all cells so far; the state is one row per image."""
    return cells.groupBy("image").agg(*[F.count(F.when(F.col("class") == c, 1)).alias(f"class_{c}") for c in classes], F.count("*").alias("n"))


def keep_counts(counts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's changed images to ``target/batch=<n>``; a repeated batch replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, target: str) -> DataFrame:
    """The last counts of each image from all batches."""
    rows = spark.read.parquet(target)
    values = [c for c in rows.columns if c not in ("image", "batch")]
    return rows.groupBy("image").agg(F.max_by(F.struct(*values), "batch").alias("v")).select("image", "v.*")
