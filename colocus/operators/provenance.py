"""What a run reads and writes, counted in the run itself.

Counts, missing values and a digest ride along with the rows (Spark's observed
metrics), so a record costs no second pass. The digest is the sum of 32 bits of
each row's md5: it depends on the rows, not on their order or partitions, and any
engine can repeat it.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from colocus.functions.columns import md5_uniform

log = logging.getLogger("colocus.provenance")
SCHEMA = "run string, role string, name string, place string, files long, rows long, nulls map<string,long>, digest decimal(38,0)"


def row_text(columns: list[str]) -> Column:
    """A row as one string: values between unit separators, NULL as a record separator."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in columns])


def metrics(columns: list[str], digest: bool = True) -> list[Column]:
    """Aggregates over rows: ``rows``, ``null_<i>`` for the i-th column, and ``digest``."""
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(columns)]]
    return [*counts, F.coalesce(F.sum(md5_uniform(row_text(columns)).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("digest")] if digest else counts


@dataclass
class Run:
    """The reads and writes of one run. A repeated task may count its rows again.

    ``read`` looks at the columns that it is given, so narrow a table first:
    observed columns are read from the files.
    """

    spark: SparkSession
    name: str
    records: list[dict] = field(default_factory=list)
    waiting: list[tuple[dict, Observation, list[str]]] = field(default_factory=list)

    def read(self, df: DataFrame, name: str, place: str = "", digest: bool = True) -> DataFrame:
        """df, with its rows counted as they are read."""
        columns, seen = df.columns, Observation(f"{self.name}-{name}-{uuid.uuid4().hex[:8]}")
        record = {"run": self.name, "role": "read", "name": name, "place": place, "files": len(df.inputFiles()) if not df.isStreaming else None}
        self.waiting.append((record, seen, columns))
        return df.observe(seen, *metrics(columns, digest))

    def write(self, df: DataFrame, name: str, place: str, put: Callable[[DataFrame], None], digest: bool = True) -> dict:
        """Runs ``put`` (one action) on df and records what went through, and the reads since the last write, all of which df must be made from."""
        columns, seen = df.columns, Observation(f"{self.name}-{name}-{uuid.uuid4().hex[:8]}")
        put(df.observe(seen, *metrics(columns, digest)))
        for record, observed, own in self.waiting:
            self._settle(record, observed, own)
        self.waiting = []
        return self._settle({"run": self.name, "role": "write", "name": name, "place": place, "files": None}, seen, columns)

    def _settle(self, record: dict, seen: Observation, columns: list[str]) -> dict:
        try:
            found = seen.get
        except Py4JJavaError:  # Spark knew that there were no rows, and left plan and metrics out
            found = {}
        record |= {"rows": found.get("rows", 0), "nulls": {c: found.get(f"null_{i}", 0) for i, c in enumerate(columns)}, "digest": found.get("digest", 0)}
        self.records.append(record)
        log.info("%s %s %s: %s rows, digest %s, nulls %s", self.name, record["role"], record["name"], record["rows"], record["digest"], {c: n for c, n in record["nulls"].items() if n})
        return record

    def table(self) -> DataFrame:
        """The records so far, a row each."""
        from decimal import Decimal

        names = [c.split()[0] for c in SCHEMA.replace("map<string,long>", "map").replace("decimal(38,0)", "decimal").split(", ")]
        return self.spark.createDataFrame([tuple(Decimal(r[c]) if c == "digest" else r[c] for c in names) for r in self.records], SCHEMA)
