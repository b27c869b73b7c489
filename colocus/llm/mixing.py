"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source asks for the same number of copies, target over
source size. The whole part is granted; the fractional parts are rounded in
pairs: words move from one document to the other, in a random direction whose
odds keep each expectation, until one of the two is whole. Words are conserved
in every move, so a source misses its target by less than one document; the root of the tree
then offsets most of that by turning a few documents. Groups
are settled apart; the one document of each group that stays fractional goes up
a reduction tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colocus.llm.common import SPACE_CLASS, drop, saved, shared_folder, text_of

WEIGHTS = (3, 1, 2)
#: Documents that one group settles, and residuals that meet in a node of the tree.
GROUP, FAN_IN = 2_000, 32
_STATE = "doc_id long, _h long, _k int, _s int, size long, share double, copies long, _b long, _r long, done boolean"


def water_fill(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Targets by weight that sum to ``total``, none above ``most`` times its size; the excess is shared anew."""
    caps = [most * s for s in sizes]
    target, capped, left = [0.0] * len(sizes), [s == 0 for s in sizes], float(total)
    while True:
        free = [i for i, c in enumerate(capped) if not c]
        weight = sum(weights[i] for i in free)
        if not free:
            return target
        over = [i for i in free if left * weights[i] / weight > caps[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            return target
        for i in over:
            target[i], capped[i] = caps[i], True
        left -= sum(caps[i] for i in over)


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, f"{SPACE_CLASS}+", -1), "")).cast("long")


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the key and the salt alone."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) / 2.0**53


def settle(size: list[int], share: list[float], chance: list[float], last: bool) -> tuple[list[int], int, float]:
    """Whole shares (0 or 1) of a group, the position that stays fractional (-1: none) and its share."""
    whole = [0] * len(size)
    hold, held = -1, 0.0
    for i, f in enumerate(share):
        if f <= 1e-12 or f >= 1 - 1e-12:
            whole[i] = int(f > 0.5)
            continue
        if size[i] == 0:
            whole[i] = int(chance[i] < f)
            continue
        if hold < 0:
            hold, held = i, f
            continue
        a, b = size[hold], size[i]
        up, down = min((1 - held) * a, f * b), min(held * a, (1 - f) * b)
        move = up if chance[i] * (up + down) < down else -down
        x, y = held + move / a, f - move / b
        if x <= 1e-9 or x >= 1 - 1e-9:
            whole[hold] = int(x > 0.5)
            hold, held = (i, y) if 1e-9 < y < 1 - 1e-9 else (-1, 0.0)
            if hold < 0:
                whole[i] = int(y > 0.5)
        else:
            whole[i] = int(y > 0.5)
            held = x
    if last and hold >= 0:
        whole[hold] = int(chance[hold] < held)
        _balance(whole, size, share, hold, (whole[hold] - held) * size[hold])
        hold = -1
    return whole, hold, held


def _balance(whole: list[int], size: list[int], share: list[float], last: int, over: float, most: int = 64) -> None:
    """Offsets the words that rounding the last document gains or loses: turns other rounded documents,
    the one that helps most each time, while that brings the sum nearer to its target."""
    free = {i for i, f in enumerate(share) if i != last and 1e-12 < f < 1 - 1e-12 and size[i]}
    for _ in range(most):
        turn = lambda i: size[i] if not whole[i] else -size[i]
        best = min(free, key=lambda i: (abs(over + turn(i)), i), default=None)
        if best is None or abs(over + turn(best)) >= abs(over) - 1e-6:
            return
        over += turn(best)
        whole[best] = 1 - whole[best]
        free.discard(best)


def _settled(level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_r", "size"], kind="stable").reset_index(drop=True)
        chance = _uniform(pdf["_r"].to_numpy(), level)
        whole, hold, held = settle(pdf["size"].tolist(), pdf["share"].tolist(), chance.tolist(), last)
        pdf["copies"] += np.array(whole, np.int64)
        pdf["done"] = True
        if hold >= 0:
            pdf.loc[hold, ["share", "done"]] = [held, False]
        return pdf

    return run


def _row_hash() -> Column:
    """Of what the mix depends on; other columns may be of any type."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


def mix(docs: DataFrame, folder: str, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per input row: doc_id, _h (hash of the row), _k (which of equal rows), size, source_size, target, copies, taken.

    docs needs doc_id, source and text. A null text has size 0 and is not
    taken; null is a source of its own, the last. Rows equal in these three are told apart by
    ``_k``; other columns are left out. An empty table gives no rows. The
    driver gets one row per source; all else stays distributed, in groups of
    about GROUP documents however large a source is. The result depends on the
    rows alone, not on their order or partitions.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash().alias("_h"), F.col("source").cast("string").alias("source"), word_count(text_of(docs)).alias("size"))
    rows = saved(sized, f"{folder}/sizes")
    sources = [(r["source"], r["s"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()]
    sources.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    weight = [float(weights[i % len(weights)]) for i in range(len(sources))]
    target = water_fill([s for _, s, _ in sources], weight, share * sum(s for _, s, _ in sources), most)
    plan = spark.createDataFrame(
        [(name, i, s, t, t / s if s else 0.0, max(1, -(-n // GROUP))) for i, ((name, s, n), t) in enumerate(zip(sources, target, strict=True))],
        "_name string, _s int, source_size long, target double, _x double, _g long",
    )
    equal = Window.partitionBy("doc_id", "_h").orderBy("size")
    keyed = rows.withColumn("_k", F.row_number().over(equal)).join(plan, F.col("source").eqNullSafe(F.col("_name")))
    random = F.xxhash64("doc_id", "_h", "_k")
    state = keyed.select(
        "doc_id", "_h", "_k", "_s", "size", (F.col("_x") - F.floor("_x")).alias("share"), F.floor("_x").cast("long").alias("copies"),
        F.pmod(F.shiftright(random, 20), F.col("_g")).cast("long").alias("_b"), random.alias("_r"), F.lit(False).alias("done"),
    )
    groups, level, done = max([1, *(-(-n // GROUP) for _, _, n in sources)]), 0, []
    while True:
        last = groups == 1
        state = saved(state.groupBy("_s", "_b").applyInPandas(_settled(level, last), _STATE), f"{folder}/level-{level}")
        done.append(state.filter("done"))
        if not level:
            drop(spark, f"{folder}/sizes")
        if last:
            break
        state = state.filter("not done").withColumn("_b", F.floor(F.col("_b") / FAN_IN).cast("long"))
        groups, level = -(-groups // FAN_IN), level + 1
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.join(plan.select("_s", "source_size", "target"), "_s").select(
        "doc_id", "_h", "_k", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_rows(docs: DataFrame, folder: str, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs.

    Which of rows that are equal in doc_id, source and text is taken depends on their other columns, but for maps.
    """
    own = [F.coalesce("_id", F.lit(0)).alias("_d"), F.col("_id").isNull().alias("_none"), "_h"]
    chosen = mix(docs, folder, **options).filter("copies > 0").withColumnRenamed("doc_id", "_id").select(*own, "_k", "copies")
    chosen = saved(chosen.groupBy("_d", "_none", "_h").agg(F.array_sort(F.collect_list(F.struct("_k", "copies"))).alias("_c")), f"{folder}/chosen")
    drop(docs.sparkSession, *(f"{folder}/level-{i}" for i in range(32)))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(whole, _row_hash().alias("_h"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(*plain).alias("_o")).select("_row", "_o", *own)
    # the window and the join deal the rows out alike, so they move once
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_d", "_none", "_h").orderBy("_o")))
    found = numbered.join(chosen, ["_d", "_none", "_h"])
    copies = F.aggregate(F.filter("_c", lambda x: x["_k"] == F.col("_k")), F.lit(0).cast("long"), lambda a, x: a + x["copies"])
    taken = found.withColumn("_n", copies).filter("_n > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, shared_folder(spark, "op7")).select("doc_id", "size", "source_size", "target", "taken", "copies")
