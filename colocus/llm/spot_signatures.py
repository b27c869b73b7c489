"""Fingerprints from spot signatures: chains of content words that follow common-word anchors.

Everything is a column expression. A text's fingerprint is the set of hashes of
(anchor, next three content words); the start of a text is an anchor too, so
that texts without common words have one. Fingerprints are compared by Jaccard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colocus.llm.common import SPACE_CLASS, range_bounds, range_search, text_of
from colocus.llm.quality_rules import EDGE, STOP_WORDS, bound_to

CHAIN = 3
ROWS_EACH, MOST_BUCKETS = 2_000, 20_000


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct 32-bit signatures of a text as longs; linear in the number of words."""
    words = F.filter(F.transform(F.split(F.lower(text), f"{SPACE_CLASS}+", -1), lambda w: F.btrim(w, F.lit(EDGE))), lambda w: w != "")

    def of_words(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.when(~x.isin(STOP_WORDS), i)), lambda i: i.isNotNull())

        def of_places(p: Column) -> Column:
            def at(i: Column, j: Column) -> Column:
                before = F.coalesce(F.get(p, j - 1), F.lit(-1))
                content = [F.coalesce(F.get(w, F.get(p, j + k)), F.lit("")) for k in range(chain)]
                anchors = F.slice(w, before + 2, i - before - 1)
                anchors = F.when(j == 0, F.concat(F.array(F.lit("^")), anchors)).otherwise(anchors)
                return F.transform(anchors, lambda a: F.xxhash64(a, *content).bitwiseAND(F.lit(0xFFFFFFFF)))

            return F.flatten(F.transform(p, at))

        none = F.when(F.size(w) > 0, F.array(F.xxhash64(F.lit("$"), F.concat_ws(" ", w)).bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(F.array().cast("array<bigint>"))
        return bound_to(places, lambda p: F.when(F.size(p) == 0, none).otherwise(of_places(p)))

    return F.sort_array(F.array_distinct(bound_to(words, of_words)))


def fingerprint(sigs: Column) -> Column:
    """The set as a string: eight hexadecimal digits for each signature, ascending."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets, 1 for two empty ones. Sets whose sizes alone keep it at 0 are not intersected."""
    shared = F.size(F.array_intersect(a, b))
    ratio = shared / (F.size(a) + F.size(b) - shared)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(ratio.cast("double"))


def similar_pairs(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of different fingerprints at or above the threshold; rows has doc_id and sigs.

    Equal fingerprints are one class, named by its smallest doc_id, so copies
    do not multiply pairs. Sets lie in partitions by length, each partition as
    wide as the threshold allows; a set meets its own partition and the next
    shorter one. Only its rarest signatures, as many as pigeonhole asks for,
    are looked up, and a pair is intersected only if the lengths allow it.
    Empty fingerprints pair with nothing.
    """
    classes = rows.filter(F.size("sigs") > 0).groupBy("sigs").agg(F.min("doc_id").alias("doc_id"))
    classes = classes.withColumn("n", F.size("sigs")).withColumn("part", F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold)).cast("int"))
    single = classes.select("doc_id", "n", "part", F.explode("sigs").alias("sig"))
    common = single.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = single.join(common, "sig").groupBy("doc_id", "n", "part").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("by"))
    look = F.col("n") - F.ceil(F.col("n") * F.lit(threshold)).cast("int") + 1
    prefix = ranked.select("doc_id", "n", "part", F.explode(F.slice("by", F.lit(1), look)).alias("x")).select("doc_id", "n", "part", F.col("x.sig").alias("sig"))
    left = prefix.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"))
    right = prefix.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "sig", "part")
    low = F.when(F.col("na") < F.col("nb"), F.col("na")).otherwise(F.col("nb"))
    pairs = left.join(right, ["sig", "part"]).filter((F.col("a") != F.col("b")) & (low >= F.lit(threshold) * (F.col("na") + F.col("nb") - low)))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = classes.select("doc_id", "sigs")
    found = pairs.join(sets.withColumnsRenamed({"doc_id": "a", "sigs": "sa"}), "a").join(sets.withColumnsRenamed({"doc_id": "b", "sigs": "sb"}), "b")
    return found.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).filter(F.col("likeness") >= threshold)


def with_next(rows: DataFrame, key: str, columns: list[str], made: dict[str, Column]) -> DataFrame:
    """Adds the columns ``made`` and next_<column> of all of them, from the row that follows in descending order of ``key``; the first row follows the last.

    Ranges of the key are dealt out and each is ordered by itself; the first row
    of each range also goes, as a guest, to the end of the range before it, by a
    table with a row for each range. The driver knows only the cut points. Nulls are
    last; rows with equal keys follow by their first column. Columns are made once
    for each row and guest, after the guests are found.
    """
    n = rows.count()
    bounds = range_bounds(rows, key, max(1, min(MOST_BUCKETS, -(-n // ROWS_EACH))))
    bucket = range_search(F.col(key), bounds)
    placed = rows.withColumn("_bucket", bucket).withColumn("_guest", F.lit(0))
    order = [F.col(key).desc_nulls_last(), F.col(columns[0]).asc()]
    heads = rows.groupBy(bucket.alias("_home")).agg(F.max(key).alias("_head"))  # a row for each range, MOST_BUCKETS at most
    goes = F.coalesce(F.lead("_home").over(Window.orderBy("_home")), F.min("_home").over(Window.partitionBy()))  # the first of all follows the last
    heads = F.broadcast(heads.withColumn("_goes", goes))
    guests = placed.join(heads, (F.col("_bucket") == F.col("_home")) & F.col(key).eqNullSafe(F.col("_head")))
    guests = guests.select(*rows.columns, F.col("_goes").alias("_bucket"), F.lit(1).alias("_guest"))
    window = Window.partitionBy("_bucket").orderBy(F.col("_guest"), *order)
    both = placed.unionByName(guests).withColumns(made)
    following = both.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in [*columns, *made]])
    return following.filter("_guest = 0")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and their likenesses.

    docs needs doc_id and text; other columns are left out. A null text is
    empty, with an empty fingerprint. Equal rows stay. A single document is its
    own next. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    pairs = with_next(rows, "doc_id", ["text"], {"sigs": signatures(F.col("text"))})
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - cut), F.left(F.col("next_text"), cut))
    made = pairs.select("doc_id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    made = made.select("doc_id", "n_chars", "sigs", "next_sigs", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), signatures(F.col("edited")).alias("edited_sigs"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def op4_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
