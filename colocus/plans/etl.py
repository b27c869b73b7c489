"""Family A: scans, look-ups, pivots, eligibility and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from colocus.functions import columns as C
from colocus.operators import cohort
from colocus.plans.registry import query
from colocus.sources.files import read_csv, scratch, write_csv
from colocus.sources.tables import table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
TYPES = ["click", "error", "purchase", "signup", "view"]
SEGMENTS = {"BUILDING": 1, "MACHINERY": 2, "FURNITURE": 3}
GROUPS = {"west": [0, 1, 2, 3, 17, 24], "east": [8, 9, 12, 18, 21], "north": [6, 7, 19, 22, 23]}
REGION_CASE = "CASE WHEN {c} IN (0, 1, 2, 3, 17, 24) THEN 'west' WHEN {c} IN (8, 9, 12, 18, 21) THEN 'east' WHEN {c} IN (6, 7, 19, 22, 23) THEN 'north' END"


@query("a01_csv_columns", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def a01(spark, d):
    path = scratch(spark, "a01")
    write_csv(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return read_csv(spark, path, "n_nationkey long, n_name string, n_regionkey long", ["n_nationkey", "n_name"])


@query("a03_gzip_csv", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 5000e0")
def a03(spark, d):
    path = scratch(spark, "a03")
    write_csv(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), path, "gzip")
    return read_csv(spark, path, "c_custkey long, c_mktsegment string, c_acctbal double").filter("c_acctbal > 5000").drop("c_acctbal")


@query("a04_typed_scan", "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_acctbal >= 0e0 THEN c_mktsegment END AS segment FROM customer")
def a04(spark, d):
    path = scratch(spark, "a04")
    write_csv(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment")), path)
    return read_csv(spark, path, "id string, segment string")


@query("a05_json_map", "SELECT 'k' AS key, (json_extract_string(props, '$.k'))::BIGINT AS value, count(*)::BIGINT AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 2")
def a05(spark, d):
    pairs = table(spark, d, "events").select(F.explode(F.from_json("props", T.MapType(T.StringType(), T.LongType()))).alias("key", "value"))
    return pairs.groupBy("key", "value").agg(F.count("*").alias("n"))


def _wide_sql(function: str, key: str, name: str, value: str, order: str, names: list[str], source: str) -> str:
    parts = ", ".join(f"{function}({value}, {order}) FILTER (WHERE {name} = '{n}') AS \"{n}\"" for n in names)
    return f"SELECT {key}, {parts} FROM {source} GROUP BY {key}"


@query("a06_eav_to_row", _wide_sql("arg_max", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderkey", PRIORITIES, "orders"))
def a06(spark, d):
    return cohort.last_value_wide(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderkey", PRIORITIES)


@query("a07_scan_filter", "SELECT event_id, event_type, value FROM events WHERE regexp_matches(event_type, 'i.k|ew')")
def a07(spark, d):
    return table(spark, d, "events").filter(F.col("event_type").rlike("i.k|ew")).select("event_id", "event_type", "value")


@query("a08_regex_extract", "SELECT c_custkey, regexp_extract(c_name, '([A-Z][a-z]+)#0*([1-9][0-9]*)', 2) AS number, CASE regexp_extract(c_name, '([A-Z][a-z]+)#', 1) WHEN 'Customer' THEN 'person' END AS kind FROM customer")
def a08(spark, d):
    word = F.regexp_extract("c_name", "([A-Z][a-z]+)#", 1)
    return table(spark, d, "customer").select("c_custkey", F.regexp_extract("c_name", "([A-Z][a-z]+)#0*([1-9][0-9]*)", 2).alias("number"), C.recoded(word, {"Customer": "person"}).alias("kind"))


@query("a09_pivot_first", _wide_sql("arg_min", "user_id", "event_type", "value", "event_id", TYPES, "events"))
def a09(spark, d):
    return cohort.first_value_wide(table(spark, d, "events"), "user_id", "event_type", "value", "event_id", TYPES)


@query("a10_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000e0 AND o_orderpriority <> '5-LOW'")
def a10(spark, d):
    o = table(spark, d, "orders")
    return o.filter((o.o_orderstatus == "F") & (o.o_totalprice > 100000) & (o.o_orderpriority != "5-LOW")).select("o_orderkey", "o_custkey")


@query("a11_semi", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def a11(spark, d):
    wanted = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(wanted, "o_custkey", "left_semi").select("o_orderkey")


@query("a12_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def a12(spark, d):
    return cohort.unmatched(table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("a13_inner_join", "SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0e0")
def a13(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, d, "orders").join(c, "o_custkey").select("o_orderkey", "c_mktsegment", "o_totalprice")


@query("a14_left_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey")
def a14(spark, d):
    n = table(spark, d, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(n, "c_nationkey", "left").select("c_custkey", "n_name")


@query("a15_two_key_join", """SELECT a.user_id, a.event_type, a.n, b.last_id FROM (SELECT user_id, event_type, count(*)::BIGINT AS n FROM events WHERE value > 50e0 GROUP BY 1, 2) a
JOIN (SELECT user_id, event_type, max(event_id) AS last_id FROM events WHERE value < 50e0 GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def a15(spark, d):
    e = table(spark, d, "events")
    a = e.filter("value > 50").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    b = e.filter("value < 50").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last_id"))
    return a.join(b, ["user_id", "event_type"])


_BY_USER = "(SELECT user_id, count(*)::BIGINT AS {n} FROM events WHERE event_type = '{t}' GROUP BY 1)"


def _by_user(spark, d, kind, name):
    return table(spark, d, "events").filter(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias(name))


@query("a16_full_outer", f"SELECT coalesce(a.user_id, b.user_id) AS user_id, a.n_error, b.n_signup FROM {_BY_USER.format(n='n_error', t='error')} a FULL JOIN {_BY_USER.format(n='n_signup', t='signup')} b ON a.user_id = b.user_id")
def a16(spark, d):
    return _by_user(spark, d, "error", "n_error").join(_by_user(spark, d, "signup", "n_signup"), "user_id", "full")


@query("a17_left_join", f"SELECT a.user_id, a.n_view, b.n_signup FROM {_BY_USER.format(n='n_view', t='view')} a LEFT JOIN {_BY_USER.format(n='n_signup', t='signup')} b ON a.user_id = b.user_id")
def a17(spark, d):
    return _by_user(spark, d, "view", "n_view").join(_by_user(spark, d, "signup", "n_signup"), "user_id", "left")


@query("a18_chained_joins", f"SELECT a.user_id, n_view, n_click, n_purchase FROM {_BY_USER.format(n='n_view', t='view')} a JOIN {_BY_USER.format(n='n_click', t='click')} b ON a.user_id = b.user_id JOIN {_BY_USER.format(n='n_purchase', t='purchase')} c ON a.user_id = c.user_id")
def a18(spark, d):
    return cohort.chained([_by_user(spark, d, k, f"n_{k}") for k in ("view", "click", "purchase")], "user_id")


@query("a19_aligned_by_key", "SELECT count(*)::BIGINT AS n, true AS aligned FROM customer")
def a19(spark, d):
    c = table(spark, d, "customer")
    a, b = c.select("c_custkey", F.col("c_acctbal").alias("x")), c.select("c_custkey", (F.col("c_acctbal") + 1e-9).alias("y"))
    return a.join(b, "c_custkey").agg(F.count("*").alias("n"), F.bool_and(F.abs(F.col("x") - F.col("y")) <= 1e-6).alias("aligned"))


@query("a20_row_id", "SELECT n_name, (row_number() OVER (ORDER BY n_name) - 1)::BIGINT AS row_id FROM nation")
def a20(spark, d):
    return cohort.numbered(table(spark, d, "nation").select("n_name"), "n_name")


@query("a21_first_non_null", "SELECT user_id, arg_min(CASE WHEN value > 60e0 THEN value END, event_id) FILTER (WHERE value > 60e0) AS first_high, arg_min(event_type, event_id) FILTER (WHERE event_type <> 'view') AS first_type FROM events GROUP BY user_id")
def a21(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("value") > 60, F.col("value")).alias("high"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"))
    return e.groupBy("user_id").agg(C.first_known("high", "event_id").alias("first_high"), C.first_known("kind", "event_id").alias("first_type"))


@query("a22_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def a22(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus").distinct()


@query("a23_coerce", "SELECT o_orderkey, try_cast(replace(o_orderpriority, '-LOW', '.5') AS DOUBLE) AS number FROM orders")
def a23(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.coerced(F.replace("o_orderpriority", F.lit("-LOW"), F.lit(".5"))).alias("number"))


@query("a24_recode", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'FURNITURE' THEN 3 END::BIGINT AS code FROM customer")
def a24(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.recoded(F.col("c_mktsegment"), SEGMENTS, "long").alias("code"))


@query("a25_inverted_map", f"SELECT n_name, {REGION_CASE.format(c='n_nationkey')} AS side FROM nation")
def a25(spark, d):
    return table(spark, d, "nation").select("n_name", C.recoded(F.col("n_nationkey"), C.inverted(GROUPS)).alias("side"))


@query("a26_override", f"SELECT c_custkey, CASE WHEN c_acctbal < 0e0 THEN 'debtor' ELSE coalesce({REGION_CASE.format(c='c_nationkey')}, 'other') END AS class FROM customer")
def a26(spark, d):
    side = F.coalesce(C.recoded(F.col("c_nationkey"), C.inverted(GROUPS)), F.lit("other"))
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, "debtor").otherwise(side).alias("class"))


@query("a27_fine_override", f"SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0e0 THEN CASE c_mktsegment WHEN 'BUILDING' THEN 'builder' END END, {REGION_CASE.format(c='c_nationkey')}) AS fine FROM customer")
def a27(spark, d):
    fine = F.when(F.col("c_acctbal") >= 0, C.recoded(F.col("c_mktsegment"), {"BUILDING": "builder"}))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(fine, C.recoded(F.col("c_nationkey"), C.inverted(GROUPS))).alias("fine"))


@query("a28_banding", "SELECT o_custkey, CASE WHEN count(*) = 0 THEN 0 WHEN count(*) <= 3 THEN 1 WHEN count(*) <= 9 THEN 2 ELSE 3 END::BIGINT AS band FROM orders GROUP BY o_custkey")
def a28(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", C.banded(F.col("n")).alias("band"))


@query("a29_branches", "SELECT c_custkey, CASE WHEN c_acctbal > 9000e0 THEN 'rich' WHEN c_mktsegment = 'MACHINERY' AND c_nationkey < 10 THEN 'maker' WHEN c_acctbal < 0e0 THEN 'debtor' END AS kind FROM customer")
def a29(spark, d):
    b, s, n = F.col("c_acctbal"), F.col("c_mktsegment"), F.col("c_nationkey")
    return table(spark, d, "customer").select("c_custkey", C.first_match([(b > 9000, "rich"), ((s == "MACHINERY") & (n < 10), "maker"), (b < 0, "debtor")]).alias("kind"))


@query("a30_strings", "SELECT c_custkey, 'MB_' || lpad(trim(c_nationkey::VARCHAR), 2, '0') || replace(c_mktsegment, 'HOUSEHOLD', 'HOME') AS name, starts_with(c_mktsegment, 'B') AS is_b FROM customer")
def a30(spark, d):
    name = F.concat(F.lit("MB_"), F.lpad(F.trim(F.col("c_nationkey").cast("string")), 2, "0"), F.replace("c_mktsegment", F.lit("HOUSEHOLD"), F.lit("HOME")))
    return table(spark, d, "customer").select("c_custkey", name.alias("name"), F.col("c_mktsegment").startswith("B").alias("is_b"))


@query("a31_slug", "SELECT DISTINCT trim(regexp_replace('(' || o_orderpriority || ') + ' || o_orderstatus || '!', '[^0-9A-Za-z]+', '_', 'g'), '_') AS slug FROM orders")
def a31(spark, d):
    return table(spark, d, "orders").select(C.slug(F.concat(F.lit("("), "o_orderpriority", F.lit(") + "), "o_orderstatus", F.lit("!"))).alias("slug")).distinct()


@query("a32_split", "SELECT DISTINCT split_part(o_orderpriority, '-', 1) AS level, split_part(o_orderpriority, '-', 2) AS word FROM orders")
def a32(spark, d):
    return table(spark, d, "orders").select(*[F.split_part("o_orderpriority", F.lit("-"), F.lit(i)).alias(n) for i, n in ((1, "level"), (2, "word"))]).distinct()


@query("a33_endpoints", "SELECT o_orderkey, coalesce(o_orderstatus IN ('F', 'P'), false) AS event_any, coalesce(o_orderstatus = 'F', false) AS event_cause FROM orders")
def a33(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(s.isin("F", "P"), F.lit(False)).alias("event_any"), F.coalesce(s == "F", F.lit(False)).alias("event_cause"))


@query("a34_censoring", "SELECT event_id, least(value, 60e0) AS time, event_type = 'purchase' AND NOT (value > 60e0) AS event FROM events")
def a34(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", C.censored_time(v, 60).alias("time"), C.censored_event(F.col("event_type") == "purchase", v, 60).alias("event"))


@query("a35_eligible_groups", "SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 60 AND max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) = 1)")
def a35(spark, d):
    e = table(spark, d, "events")
    good = e.groupBy("user_id").agg(F.count("*").alias("n"), F.max((F.col("event_type") == "signup").cast("int")).alias("s")).filter("n >= 60 AND s = 1")
    return e.join(good, "user_id", "left_semi").select("user_id", "event_id")


@query("a36_eligible_rows", "SELECT c_custkey FROM customer WHERE c_mktsegment IS NOT NULL AND c_acctbal > 0e0")
def a36(spark, d):
    return table(spark, d, "customer").filter("c_mktsegment IS NOT NULL AND c_acctbal > 0").select("c_custkey")


def _counts_sql(key: str, name: str, names: list[str], source: str, prefix: str = "") -> str:
    return f"SELECT {key}, " + ", ".join(f"(count(*) FILTER (WHERE {name} = '{n}'))::BIGINT AS \"{prefix}{n}\"" for n in names) + f" FROM {source} GROUP BY {key}"


@query("a37_crosstab", _counts_sql("o_custkey", "o_orderpriority", PRIORITIES, "orders"))
def a37(spark, d):
    return cohort.crosstab(table(spark, d, "orders"), "o_custkey", "o_orderpriority", PRIORITIES)


@query("a38_dcast", _counts_sql("l_returnflag", "l_linestatus", ["F", "O"], "lineitem", "n_"))
def a38(spark, d):
    return cohort.crosstab(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], "n_")


@query("a39_melt", f"SELECT o_custkey, name, n FROM ({_counts_sql('o_custkey', 'o_orderstatus', ['F', 'O', 'P'], 'orders')}) UNPIVOT (n FOR name IN (\"F\", \"O\", \"P\"))")
def a39(spark, d):
    wide = cohort.crosstab(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])
    return wide.unpivot(["o_custkey"], ["F", "O", "P"], "name", "n")


@query("a40_roll_up", "SELECT o_custkey, (count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')))::BIGINT AS fast, (count(*) FILTER (WHERE o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')))::BIGINT AS slow FROM orders GROUP BY 1")
def a40(spark, d):
    mapping = C.inverted({"fast": PRIORITIES[:2], "slow": PRIORITIES[2:]})
    return cohort.rolled_up(table(spark, d, "orders"), "o_custkey", "o_orderpriority", mapping, ["fast", "slow"])


@query("a41_mutation_status", """SELECT s.user_id AS sample, g.gene, CASE WHEN s.panel IS NOT NULL AND p.gene IS NULL THEN NULL WHEN h.gene IS NOT NULL THEN 1e0 ELSE 0e0 END AS status
FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 3 = 0 THEN 'small' WHEN user_id % 3 = 1 THEN 'large' END AS panel FROM events) s
CROSS JOIN (SELECT unnest(['click', 'error', 'signup']) AS gene) g
LEFT JOIN (SELECT DISTINCT user_id, event_type AS gene FROM events WHERE value > 80e0) h ON h.user_id = s.user_id AND h.gene = g.gene
LEFT JOIN (SELECT 'small' AS panel, 'click' AS gene UNION ALL SELECT 'large', unnest(['click', 'error', 'signup'])) p ON p.panel = s.panel AND p.gene = g.gene""")
def a41(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("user_id") % 3 == 0, "small").when(F.col("user_id") % 3 == 1, "large")
    samples = e.select(F.col("user_id").alias("sample"), kind.alias("panel")).distinct()
    genes = spark.createDataFrame([("click",), ("error",), ("signup",)], "gene string")
    hits = e.filter("value > 80").select(F.col("user_id").alias("sample"), F.col("event_type").alias("gene"))
    panel = spark.createDataFrame([("small", "click"), ("large", "click"), ("large", "error"), ("large", "signup")], "panel string, gene string")
    return cohort.mutation_status(samples, genes, hits, panel)


@query("a42_union", "SELECT c_custkey AS id, c_acctbal AS balance, NULL::BIGINT AS nation FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey::BIGINT FROM supplier")
def a42(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


@query("a43_frequencies", f"SELECT {REGION_CASE.format(c='c_nationkey')} AS side, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def a43(spark, d):
    return table(spark, d, "customer").groupBy(C.recoded(F.col("c_nationkey"), C.inverted(GROUPS)).alias("side")).agg(F.count("*").alias("n"))


@query("a44_summary", "SELECT count(*)::BIGINT AS n_rows, count(DISTINCT o_custkey)::BIGINT AS n_keys, round(quantile_cont(o_totalprice, 0.5), 6) AS median_o_totalprice, (count(*) FILTER (WHERE o_totalprice IS NULL))::BIGINT AS missing_o_totalprice FROM orders")
def a44(spark, d):
    return cohort.cohort_summary(table(spark, d, "orders"), "o_custkey", ["o_totalprice"])


@query("a45_screen", """WITH t AS (SELECT CASE WHEN c_acctbal > 9990e0 THEN 1 ELSE 0 END AS rich, CASE WHEN c_nationkey < 12 THEN 1 ELSE 0 END AS low FROM customer)
SELECT 'rich' AS name, (count(*) FILTER (WHERE rich = 0))::BIGINT AS n_zero, (count(*) FILTER (WHERE rich = 1))::BIGINT AS n_one, least(count(*) FILTER (WHERE rich = 0), count(*) FILTER (WHERE rich = 1)) >= 10 AS keep FROM t
UNION ALL SELECT 'low', (count(*) FILTER (WHERE low = 0))::BIGINT, (count(*) FILTER (WHERE low = 1))::BIGINT, least(count(*) FILTER (WHERE low = 0), count(*) FILTER (WHERE low = 1)) >= 10 FROM t""")
def a45(spark, d):
    flags = table(spark, d, "customer").select((F.col("c_acctbal") > 9990).cast("int").alias("rich"), (F.col("c_nationkey") < 12).cast("int").alias("low"))
    return cohort.screen(flags, ["rich", "low"])


@query("a46_sinks", "SELECT n_name, n_regionkey::BIGINT AS region FROM nation")
def a46(spark, d):
    path = scratch(spark, "a46")
    rows = table(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("long").alias("region"))
    rows.write.parquet(f"{path}/parquet")
    spark.read.parquet(f"{path}/parquet").write.json(f"{path}/json")
    return spark.read.schema("n_name string, region long").json(f"{path}/json")


@query("a49_joint_shuffle", """SELECT a.n_nationkey::BIGINT AS n_nationkey, b.n_name, b.n_regionkey::BIGINT AS n_regionkey FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS p FROM nation) a
JOIN (SELECT n_name, n_regionkey, row_number() OVER (ORDER BY md5('7-' || n_nationkey::VARCHAR), n_nationkey) AS p FROM nation) b ON a.p = b.p""")
def a49(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    return cohort.shuffled_jointly(n, "n_nationkey", ["n_name", "n_regionkey"], 7)
