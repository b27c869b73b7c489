"""Sources and sinks of family A and the record of family F: sniffed scans, kept results, archives, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from colocus.operators.provenance import Run
from colocus.plans.registry import query
from colocus.sources import archives
from colocus.sources.cache import cached
from colocus.sources.files import read_sniffed, scratch
from colocus.sources.tables import table

CUSTOMER = "c_custkey long, c_name string, c_nationkey long, c_mktsegment string"


@query("a02_sniffed_scan", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM customer")
def a02(spark, d):
    """Customers written with three separators, one of them compressed, and read back as one table."""
    c, folder = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), scratch(spark, "a02")
    for i, (sep, packed) in enumerate(((";", "none"), (",", "gzip"), ("\t", "none"))):
        c.filter(F.col("c_custkey") % 3 == i).write.mode("append").csv(folder, header=True, sep=sep, compression=packed)
    return read_sniffed(spark, folder, CUSTOMER)


@query("a47_result_cache", "SELECT k.call, k.call = 2 AS found, o_orderpriority, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY 1), (VALUES (1::BIGINT), (2::BIGINT)) k(call)")
def a47(spark, d):
    """Orders over a price by priority, asked for twice: made, then found."""
    root, params, parts = scratch(spark, "a47"), {"price": 50_000}, []
    for call in (1, 2):
        build = lambda: table(spark, d, "orders").filter(F.col("o_totalprice") > params["price"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))
        rows, hit = cached(spark, root, "orders-by-priority", params, [f"{d}/orders.parquet"], build)
        parts.append(rows.select(F.lit(call).cast("long").alias("call"), F.lit(hit).alias("found"), "o_orderpriority", "n"))
    return parts[0].unionByName(parts[1])


@query("a48_archive_members", "SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n_bytes, md5(coalesce(html, '')) AS digest, TRUE AS sound FROM pages")
def a48(spark, d):
    """Pages in zip archives: directories listed, members read by range and held to their checksums."""
    rows = table(spark, d, "pages").select(F.format_string("page-%d.html", "page_id").alias("member"), F.encode("html", "UTF-8").alias("content"))
    folder = scratch(spark, "a48")
    made = archives.write_archives(rows.repartition(8), folder, 1 << 20)
    made.write.parquet(f"{folder}/made")
    got = archives.contents(archives.members(spark.read.parquet(f"{folder}/made")))
    number = F.regexp_extract("member", r"page-(-?\d+)\.html", 1).cast("long")
    return got.select(number.alias("page_id"), F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"), F.col("fault").isNull().alias("sound"))


_TEXT = "concat_ws(chr(31), coalesce({}::VARCHAR, chr(30)), coalesce({}::VARCHAR, chr(30)))"
_SUM = "coalesce(sum(('0x' || substr(md5({}), 1, 8))::BIGINT), 0)::BIGINT"


@query("f20_provenance", f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN user_id END AS user_id FROM events), c AS (SELECT c_custkey AS user_id, c_mktsegment AS segment FROM customer),
s AS (SELECT segment, count(*) AS n FROM e LEFT JOIN c USING (user_id) GROUP BY 1)
SELECT 'read' AS role, 'events' AS name, count(*) AS rows, count(*) FILTER (WHERE user_id IS NULL) AS missing, {_SUM.format(_TEXT.format('event_id', 'user_id'))} AS digest FROM e
UNION ALL SELECT 'read', 'customers', count(*), 0, {_SUM.format(_TEXT.format('user_id', 'segment'))} FROM c
UNION ALL SELECT 'write', 'segments', count(*), count(*) FILTER (WHERE segment IS NULL), {_SUM.format(_TEXT.format('segment', 'n'))} FROM s""")
def f20(spark, d):
    """Rows, missing values and digests of two reads and the sink that is made from them, counted as they pass."""
    done, folder = Run(spark, "segments"), scratch(spark, "f20")
    e = done.read(table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("user_id")).alias("user_id")), "events", d)
    c = done.read(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment")), "customers", d)
    done.write(e.join(c, "user_id", "left").groupBy("segment").agg(F.count("*").alias("n")), "segments", folder, lambda df: df.write.parquet(folder))
    missing = F.aggregate(F.map_values("nulls"), F.lit(0).cast("long"), lambda a, b: a + b)
    return done.table().select("role", "name", "rows", missing.alias("missing"), F.col("digest").cast("long").alias("digest"))
