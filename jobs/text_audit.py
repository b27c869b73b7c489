"""Audit of arriving documents: class composition of each source and agreement with published labels, kept up to date.

    python -m jobs.text_audit --documents PATH --labels PATH --target PATH --checkpoint PATH [--config FILE]

A file stream takes the documents that are new since the last run (its
checkpoint remembers which files it has had). Each batch types its documents by
threshold rules, first match wins, and writes

* ``target/classified``: doc_id, source, lang, class, n_words, by ``batch``;
* ``target/counts``: documents and words by source, lang and class, by ``batch``;
* ``target/against``: counts by published quality and by what the rules say, by ``batch``.

A batch that is repeated after a failure replaces its own partitions. From the
counts of all batches, which are small and add up, the run then renews

* ``target/composition``: each source's share and centred log-ratio of every
  class, partitioned by ``class``;
* ``target/agreement``: coverage, agreement and kappa of the rules on labelled
  documents (``toxic`` plays no part; documents without words are unassigned).

A run without new files renews the two from the same counts: the same rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colocus.functions.columns import first_match
from colocus.operators.agreement import agreement_of
from colocus.operators.provenance import Run
from colocus.streaming.composition import arrivals
from jobs.common import command_line, config_of, session

CLASSES = ["empty", "short", "marked", "long", "prose"]
CLASSIFIED = "doc_id long, source string, lang string, class string, n_words long"
COUNTS = "source string, lang string, class string, n long, n_words long, batch long"
AGAINST = "t string, p string, n long, batch long"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def typed(documents: DataFrame, config: dict) -> DataFrame:
    """doc_id, source, lang, class, n_words. A null text has no words."""
    counted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", n_words(F.col("text")).alias("n_words"), F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).alias("n_symbols"))
    n = F.col("n_words")
    rules = [(n == 0, "empty"), (n < config["short_words"], "short"), (100 * F.col("n_symbols") > config["symbol_percent"] * n, "marked"), (n >= config["long_words"], "long"), (F.lit(True), "prose")]
    return counted.select("doc_id", "source", "lang", first_match(rules).alias("class"), "n_words")


def against(classified: DataFrame, labels: DataFrame, config: dict) -> DataFrame:
    """t, p, n: published quality and what the rules say, over labelled documents."""
    both = classified.join(labels.filter("quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("t")), "doc_id")
    said = F.when(F.col("class") == "empty", "unassigned").when(F.col("class").isin(config["accepted"]), "good").otherwise("poor")
    return both.groupBy("t", said.alias("p")).agg(F.count("*").alias("n"))


def composition(counts: DataFrame, least: int) -> DataFrame:
    """A row for every source, lang and class: n, n_words, share, clr (half a document added to each class), eligible."""
    sums = counts.groupBy("source", "lang").agg(*[F.coalesce(F.sum(F.when(F.col("class") == c, F.col(v))), F.lit(0)).alias(f"{v}_{c}") for c in CLASSES for v in ("n", "n_words")])
    total = sum((F.col(f"n_{c}") for c in CLASSES), F.lit(0))
    mean = sum((F.ln(F.col(f"n_{c}") + F.lit(0.5)) for c in CLASSES), F.lit(0.0)) / len(CLASSES)
    cells = [F.struct(F.lit(c).alias("class"), F.col(f"n_{c}").alias("n"), F.col(f"n_words_{c}").alias("n_words"), (F.col(f"n_{c}") / total).alias("share"), (F.ln(F.col(f"n_{c}") + F.lit(0.5)) - mean).alias("clr"), (total >= least).alias("eligible")) for c in CLASSES]
    return sums.select("source", "lang", F.explode(F.array(*cells)).alias("x")).select("source", "x.*", "lang")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows under a path; none where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run(spark: SparkSession, documents: str, labels: str, target: str, checkpoint: str, config: dict) -> Run:
    """Takes the new documents, then renews the two summaries; returns the record of what was read and written."""
    done = Run(spark, "text_audit")

    def put(name: str, by: str):
        return lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{target}/{name}")

    def take(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        new = done.read(batch.select("doc_id", "source", "lang", "text"), f"documents of batch {number}", documents, digest=False)
        done.write(typed(new, config).withColumn("batch", F.lit(number)), "classified", f"{target}/classified", put("classified", "batch"))
        kept = own.read.schema(CLASSIFIED + ", batch long").parquet(f"{target}/classified").filter(F.col("batch") == number)
        counts = kept.groupBy("source", "lang", "class").agg(F.count("*").alias("n"), F.sum("n_words").alias("n_words"))
        done.write(counts.withColumn("batch", F.lit(number)), "counts", f"{target}/counts", put("counts", "batch"))
        published = done.read(own.read.parquet(labels).select("doc_id", "quality"), "labels", labels, digest=False)
        done.write(against(kept, published, config).withColumn("batch", F.lit(number)), "against", f"{target}/against", put("against", "batch"))

    stream = arrivals(spark, documents, config["files_each"])
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take).trigger(availableNow=True).start()
    query.awaitTermination()
    counts = stored(spark, f"{target}/counts", COUNTS)
    done.write(composition(counts, config["least_documents"]), "composition", f"{target}/composition", lambda df: df.write.mode("overwrite").partitionBy("class").parquet(f"{target}/composition"))
    table = stored(spark, f"{target}/against", AGAINST).groupBy("t", "p").agg(F.sum("n").alias("n"))
    done.write(agreement_of(table, "unassigned"), "agreement", f"{target}/agreement", lambda df: df.write.mode("overwrite").parquet(f"{target}/agreement"))
    return done


def summary(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("source string, lang string, n long, n_words long, share double, clr double, eligible boolean, class string").parquet(f"{target}/composition")


def main() -> None:
    given = command_line(__doc__.split("\n")[0], "documents", "labels", "target", "checkpoint")
    spark = session("text_audit")
    try:
        run(spark, given.documents, given.labels, given.target, given.checkpoint, config_of(__file__, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
