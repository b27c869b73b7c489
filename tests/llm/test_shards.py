"""How much of the jaccard join one task holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from colocus.llm import jaccard_join as J


def test_a_shard_of_keys_has_its_own_task(spark):
    """Two shards in one task held the keys of both, which took the executor over its memory."""
    shards = 17
    blob = bytearray(J._write_index(np.array([1 << 20, 1 << 20], np.uint64), np.array([0, 1]), np.array([5, 7]), np.array([9, 9])))
    index = spark.createDataFrame([(s, blob) for s in range(shards)] * 2, "shard int, blob binary")
    found = J._twins(index, shards, shards).select("home", F.spark_partition_id().alias("task")).distinct().collect()
    assert sorted(r["home"] for r in found) == list(range(shards))
    assert len({r["task"] for r in found}) == shards


def test_small_shards_of_keys():
    """A shard of keys travels as one Arrow batch, so it is a third of what one of the second round is."""
    assert J.KEYS_EACH * 3 <= J.ROUND_EACH <= J.HOME_EACH


def near_copies(spark, pairs: int):
    """Documents 2i and 2i + 1 differ in one of 400 words."""
    words = [[f"w{i}x{j}" for j in range(400)] for i in range(pairs)]
    rows = [(2 * i + k, " ".join(w[:200] + [f"own{k}"] + w[201:])) for i, w in enumerate(words) for k in (0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_near_copy_goes_to_few_homes(spark):
    """A set went to every home where it had a common key, so more shards and homes made more rows of the same sets."""
    docs = near_copies(spark, 30)
    for parts in (8, 48):
        index = J._indexed(docs, 5, J.Bands(80), parts).filter("shard IS NOT NULL").select("shard", "blob")
        led = J._led(J._twins(index, parts, parts), parts)
        met = [(r["home"], r["node"]) for r in led.filter("node IS NOT NULL").select("home", "node").collect()]
        assert len(met) == len(set(met)) == len({node for _, node in met}) == 60


def test_a_large_group_is_shared_out_and_loses_no_set(spark):
    """500 sets with 40 keys in common and one more each pair: several homes, each with all sets of its keys."""
    common, own = np.repeat(np.arange(40, dtype=np.uint64), 500), np.repeat(np.arange(100, 350, dtype=np.uint64), 2)
    owner = np.concatenate([np.tile(np.arange(500), 40), np.arange(500)])
    # one set fewer in each of the common keys: equal groups would be one
    keep = np.ones(len(owner), bool)
    keep[np.arange(40) * 500 + np.arange(40) + 1] = False
    keys = np.concatenate([common, own])[keep]
    names = np.arange(500, dtype=np.int64) * 7919 + 3
    blob = bytearray(J._write_index(keys << np.uint64(40), owner[keep], names, np.full(500, 9)))
    twins = J._twins(spark.createDataFrame([(0, blob)], "shard int, blob binary"), 1, 1)
    rows = J._led(twins, 16).filter("blob IS NOT NULL").collect()
    found = {}
    for r in rows:
        k, nodes, _ = J._read_index(bytes(r["blob"]))
        for key in np.unique(k):
            assert key not in found
            found[key] = (r["home"], set(nodes[k == key].tolist()))
    sizes = sorted(len(nodes) for _, nodes in found.values())
    assert sizes == [2] * 250 + [499] * 40
    assert len({home for home, nodes in found.values() if len(nodes) > 2}) > 3
