"""Results kept by what they were made from."""

from __future__ import annotations

import hashlib
import json
import logging
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from colocus.sources.store import hadoop, listing

log = logging.getLogger("colocus.cache")


def key_of(spark: SparkSession, name: str, params: dict, inputs: list[str]) -> str:
    """A hash of the name, the parameters (in any order) and path, size and time of every input file."""
    facts = [listing(spark, path) for path in inputs]
    return hashlib.sha256(json.dumps([name, params, facts], sort_keys=True).encode()).hexdigest()[:32]


def cached(spark: SparkSession, root: str, name: str, params: dict, inputs: list[str], build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The rows of ``build()`` and whether they were there already.

    A result lies in ``root/name/<key>`` as Parquet. It is written under a
    private name and moved when whole, so a reader never sees half of it; of two
    writers of one key the second drops its copy. Changed parameters or inputs
    make another key; older results stay until someone deletes them.
    """
    place = f"{root.rstrip('/')}/{name}/{key_of(spark, name, params, inputs)}"
    fs, path = hadoop(spark, place)
    _, whole = hadoop(spark, f"{place}/_SUCCESS")
    hit = fs.exists(whole)
    if not hit:
        _, part = hadoop(spark, f"{root.rstrip('/')}/{name}/_making-{uuid.uuid4().hex[:12]}")
        build().write.parquet(part.toString())
        try:
            moved = not fs.exists(path) and fs.rename(part, path)
        except Py4JJavaError:
            moved = False
        if not moved and not fs.exists(whole):
            raise OSError(f"{part.toString()} could not be moved to {place}")
        fs.delete(part, True)
        _, inside = hadoop(spark, f"{place}/{part.getName()}")  # where a store moved it into the other writer's folder
        fs.delete(inside, True)
    log.info("%s %s: %s", name, params, "found" if hit else "made")
    return spark.read.parquet(place), hit
