"""Family B: neighbour graphs, enrichment, co-location."""

from __future__ import annotations

from pyspark.sql import functions as F

from colocus.operators import coloc, graph
from colocus.operators.ordered import exact_quantiles
from colocus.plans.registry import query, rounded
from colocus.sources.tables import CELLS_BIG_SQL, CELLS_SQL, cells, cells_big, table

K = 8


def knn_sql(k: int) -> str:
    return f"""knn AS (SELECT * FROM (SELECT a.image, a.cell_id AS src, b.cell_id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,
  row_number() OVER (PARTITION BY a.image, a.cell_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.cell_id) AS rank
  FROM cells a JOIN cells b ON a.image = b.image AND a.cell_id <> b.cell_id) WHERE rank <= {k})"""


GRAPH = f"WITH {CELLS_SQL}, {knn_sql(K)}, und AS (SELECT DISTINCT image, least(src, dst) AS i, greatest(src, dst) AS j FROM knn)"
MOMENTS = """deg AS (SELECT image, c, count(*) AS d FROM (SELECT image, i AS c FROM und UNION ALL SELECT image, j FROM und) GROUP BY 1, 2),
mk AS (SELECT image, sum(d) / 2 AS m, sum(d * (d - 1)) AS k FROM deg GROUP BY 1),
nn AS (SELECT image, count(*) AS n FROM cells GROUP BY 1),
cc AS (SELECT image, class, count(*) AS nc FROM cells GROUP BY 1, 2),
obs AS (SELECT und.image, least(p.class, q.class) AS a, greatest(p.class, q.class) AS b, count(*) AS o FROM und JOIN cells p ON p.image = und.image AND p.cell_id = i JOIN cells q ON q.image = und.image AND q.cell_id = j GROUP BY 1, 2, 3),
grid AS (SELECT x.image, x.class AS a, y.class AS b, x.nc AS na, y.nc AS nb, coalesce(o, 0) AS observed, n::DOUBLE AS n, m::DOUBLE AS m, k::DOUBLE AS k
  FROM cc x JOIN cc y ON x.image = y.image AND x.class <= y.class JOIN nn ON nn.image = x.image JOIN mk ON mk.image = x.image LEFT JOIN obs ON obs.image = x.image AND obs.a = x.class AND obs.b = y.class),
prob AS (SELECT *, CASE WHEN a = b THEN na::DOUBLE * (na - 1) ELSE 2.0e0 * na * nb END / (n * (n - 1)) AS e1,
  CASE WHEN a = b THEN na::DOUBLE * (na - 1) * (na - 2) ELSE na::DOUBLE * nb * (na + nb - 2) END / (n * (n - 1) * (n - 2)) AS e2,
  CASE WHEN a = b THEN na::DOUBLE * (na - 1) * (na - 2) * (na - 3) ELSE 4.0e0 * na * (na - 1) * nb * (nb - 1) END / (n * (n - 1) * (n - 2) * (n - 3)) AS e3 FROM grid),
mom AS (SELECT *, m * e1 AS mean, m * e1 + k * e2 + (m * (m - 1) - k) * e3 - m * e1 * m * e1 AS var FROM prob)"""


def dealt_sql(seed: int, permutations: int) -> str:
    """CTE ``lab`` (image, r, cell_id, class): the labels of ``cells`` as coloc.dealt deals them."""
    p = coloc.PRIME
    return f"""draw AS (SELECT image, r, 1 + ('0x' || substr(h, 1, 8))::BIGINT % {p - 1} AS ra, ('0x' || substr(h, 9, 8))::BIGINT % {p} AS rb FROM (SELECT image, r, md5('{seed}-' || r::VARCHAR || '-' || image::VARCHAR) AS h FROM (SELECT DISTINCT image FROM cells), range({permutations}) q(r))),
place AS (SELECT image, cell_id, class, row_number() OVER (PARTITION BY image ORDER BY cell_id) - 1 AS x FROM cells),
dealt AS (SELECT image, r, class, row_number() OVER (PARTITION BY image, r ORDER BY y * y % {p}, x) - 1 AS x FROM (SELECT image, r, class, x, (x * ra + rb) % {p} AS y FROM place JOIN draw USING (image))),
lab AS (SELECT image, r, cell_id, dealt.class FROM dealt JOIN place USING (image, x))"""


def _graph(spark, d):
    c = cells(spark, d)
    edges = graph.knn_tiled(c, K)
    return c, edges, graph.undirected(edges)


@query("b01_knn_edges", f"WITH {CELLS_SQL}, {knn_sql(K)} SELECT image, src, dst, rank, round(d2, 6) AS d2 FROM knn")
def b01(spark, d):
    return graph.knn_tiled(cells(spark, d), K).withColumn("d2", F.round("d2", 6))


@query("b01_knn_grouped", f"WITH {CELLS_BIG_SQL}, {knn_sql(K)} SELECT image, src, dst, rank, round(d2, 6) AS d2 FROM knn")
def b01_grouped(spark, d):
    return graph.knn_grouped(cells_big(spark, d), K).withColumn("d2", F.round("d2", 6))


@query("b02_undirected", f"{GRAPH} SELECT * FROM und")
def b02(spark, d):
    return _graph(spark, d)[2]


@query("b03_pair_counts", f"{GRAPH}, {MOMENTS} SELECT image, a, b, observed::BIGINT AS observed FROM mom")
def b03(spark, d):
    c, _, pairs = _graph(spark, d)
    return coloc.pair_counts(c, pairs).select("image", "a", "b", "observed")


NULL = f"""{GRAPH}, {dealt_sql(12345, 200)}, hits AS (SELECT und.image, p.r, least(p.class, q.class) AS a, greatest(p.class, q.class) AS b, count(*) AS n FROM und JOIN lab p ON p.image = und.image AND p.cell_id = i JOIN lab q ON q.image = und.image AND q.cell_id = j AND q.r = p.r GROUP BY 1, 2, 3, 4),
kinds AS (SELECT DISTINCT image, class FROM cells), cases AS (SELECT x.image, x.class AS a, y.class AS b, r FROM kinds x JOIN kinds y ON x.image = y.image AND x.class <= y.class, range(200) q(r))"""


@query("b04_permutation_null", f"{NULL} SELECT image, a::BIGINT AS a, b::BIGINT AS b, round(avg(coalesce(n, 0)), 6) AS perm_mean, round(stddev_samp(coalesce(n, 0)), 6) AS perm_sd FROM cases LEFT JOIN hits USING (image, a, b, r) GROUP BY 1, 2, 3")
def b04(spark, d):
    c, _, pairs = _graph(spark, d)
    return rounded(coloc.permuted_enrichment(c, pairs, 200, 12345))


@query("b05_exact_moments", f"{GRAPH}, {MOMENTS} SELECT image, a, b, round(mean, 6) AS mean, round(var, 6) AS var FROM mom")
def b05(spark, d):
    c, _, pairs = _graph(spark, d)
    return coloc.enrichment(c, pairs).select("image", "a", "b", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query("b06_enrichment_z", f"{GRAPH}, {MOMENTS} SELECT image, a, b, CASE WHEN na >= 5 AND nb >= 5 AND var > 1e-9 THEN round((observed - mean) / sqrt(var), 6) END AS z FROM mom")
def b06(spark, d):
    c, _, pairs = _graph(spark, d)
    return coloc.enrichment(c, pairs).select("image", "a", "b", F.round("z", 6).alias("z"))


@query("b07_log_oe", f"{GRAPH}, {MOMENTS} SELECT image, a, b, CASE WHEN na >= 5 AND nb >= 5 THEN round(log2((observed + 1) / (mean + 1)), 6) END AS log_oe FROM mom")
def b07(spark, d):
    c, _, pairs = _graph(spark, d)
    return coloc.enrichment(c, pairs).select("image", "a", "b", F.round("log_oe", 6).alias("log_oe"))


SOURCE, TARGET = [0], [1, 2, 3]
FRACTION = "frac AS (SELECT knn.image, round(avg(CASE WHEN q.class IN (1, 2, 3) THEN 1e0 ELSE 0e0 END), 6) AS fraction FROM knn JOIN cells p ON p.cell_id = src AND p.class = 0 JOIN cells q ON q.cell_id = dst GROUP BY 1)"
MIX = """mix AS (SELECT image, CASE WHEN ti + ii > 0 THEN round(ti::DOUBLE / (ti + ii), 6) END AS mixing FROM (SELECT und.image, count(*) FILTER (WHERE p.class = 0 AND q.class IN (1, 2, 3) OR q.class = 0 AND p.class IN (1, 2, 3)) AS ti,
count(*) FILTER (WHERE p.class IN (1, 2, 3) AND q.class IN (1, 2, 3)) AS ii FROM und JOIN cells p ON p.cell_id = i JOIN cells q ON q.cell_id = j GROUP BY 1))"""


@query("b08_neighbour_fraction", f"{GRAPH}, {FRACTION} SELECT * FROM frac")
def b08(spark, d):
    c, edges, _ = _graph(spark, d)
    return coloc.neighbour_fraction(c, edges, SOURCE, TARGET).withColumn("fraction", F.round("fraction", 6))


@query("b09_mixing", f"{GRAPH}, {MIX} SELECT * FROM mix")
def b09(spark, d):
    c, _, pairs = _graph(spark, d)
    return coloc.mixing(c, pairs, SOURCE, TARGET).withColumn("mixing", F.round("mixing", 6))


FEATURES = f"""{GRAPH}, {MOMENTS}, {FRACTION}, {MIX}, feat AS (SELECT nn.image, n::BIGINT AS n_cells, max(CASE WHEN a = 0 AND b = 1 THEN z END) AS z_0_1, max(CASE WHEN a = 1 AND b = 1 THEN z END) AS z_1_1, max(CASE WHEN a = 0 AND b = 1 THEN oe END) AS oe_0_1, max(fraction) AS fraction, max(mixing) AS mixing
FROM nn JOIN (SELECT image, a, b, CASE WHEN na >= 5 AND nb >= 5 AND var > 1e-9 THEN round((observed - mean) / sqrt(var), 6) END AS z, CASE WHEN na >= 5 AND nb >= 5 THEN round(log2((observed + 1) / (mean + 1)), 6) END AS oe FROM mom) e ON e.image = nn.image
LEFT JOIN frac ON frac.image = nn.image LEFT JOIN mix ON mix.image = nn.image GROUP BY 1, 2)"""


def features(spark, d):
    """Image features: enrichment of two class pairs, both ratios, number of cells."""
    c, edges, pairs = _graph(spark, d)
    e = coloc.enrichment(c, pairs).withColumn("z", F.round("z", 6)).withColumn("log_oe", F.round("log_oe", 6))
    at = lambda a, b, v: F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col(v)))
    wide = e.groupBy("image").agg(at(0, 1, "z").alias("z_0_1"), at(1, 1, "z").alias("z_1_1"), at(0, 1, "log_oe").alias("oe_0_1"))
    n = c.groupBy("image").agg(F.count("*").alias("n_cells"))
    fraction = coloc.neighbour_fraction(c, edges, SOURCE, TARGET).withColumn("fraction", F.round("fraction", 6))
    mix = coloc.mixing(c, pairs, SOURCE, TARGET).withColumn("mixing", F.round("mixing", 6))
    return n.join(wide, "image").join(fraction, "image", "left").join(mix, "image", "left")


@query("b10_image_features", f"{FEATURES} SELECT * FROM feat")
def b10(spark, d):
    return features(spark, d)


_MEAN = "round(sum({c} * n_cells) / sum(CASE WHEN {c} IS NOT NULL THEN n_cells END), 4) AS {c}"


@query("b11_patient_mean", f"{FEATURES} SELECT image // 2 AS patient, {_MEAN.format(c='z_0_1')}, {_MEAN.format(c='z_1_1')}, {_MEAN.format(c='fraction')} FROM feat GROUP BY 1")
def b11(spark, d):
    f = features(spark, d).withColumn("patient", F.floor(F.col("image") / 2))
    out = coloc.weighted_mean(f, "patient", "n_cells", ["z_0_1", "z_1_1", "fraction"])
    return out.select("patient", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


@query("b12_composition_counts", f"WITH {CELLS_SQL} SELECT image // 2 AS patient, " + ", ".join(f"(count(*) FILTER (WHERE class = {k}))::BIGINT AS class_{k}" for k in range(6)) + " FROM cells GROUP BY 1")
def b12(spark, d):
    from colocus.operators.cohort import crosstab

    return crosstab(cells(spark, d).withColumn("patient", F.floor(F.col("image") / 2)), "patient", "class", list(range(6)), "class_")


@query("b13_clr", "WITH c AS (SELECT o_custkey, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT k.o_custkey, q.p AS priority, coalesce(n, 0) AS n FROM (SELECT DISTINCT o_custkey FROM orders) k CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) q LEFT JOIN c ON c.o_custkey = k.o_custkey AND c.priority = q.p) SELECT o_custkey, priority, round(ln(n + 0.5e0) - avg(ln(n + 0.5e0)) OVER (PARTITION BY o_custkey), 6) + 0e0 AS clr FROM g")
def b13(spark, d):
    from colocus.plans.etl import PRIORITIES

    n = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return coloc.clr(coloc.full_grid(n, "o_custkey", "priority", PRIORITIES, "n"), "o_custkey", "priority", "n").withColumn("clr", F.round("clr", 6) + 0.0)


SYM = f"{GRAPH}, sym AS (SELECT image, src, dst, greatest(sqrt(min(d2)), 1e-12) AS dist FROM (SELECT image, src, dst, d2 FROM knn UNION ALL SELECT image, dst, src, d2 FROM knn) GROUP BY 1, 2, 3)"


@query("b14_symmetric_graph", f"{SYM} SELECT image, src, dst, round(dist, 6) AS dist FROM sym")
def b14(spark, d):
    return graph.symmetric(_graph(spark, d)[1]).withColumn("dist", F.round("dist", 6))


#: All triangles whose circle holds no other point: cubic in an image's cells, for small tables.
DELAUNAY = f"""WITH {CELLS_SQL}, tri AS (SELECT a.image, a.cell_id AS i, b.cell_id AS j, c.cell_id AS k, a.x AS x, a.y AS y, b.x - a.x AS ux, b.y - a.y AS uy, c.x - a.x AS vx, c.y - a.y AS vy
FROM cells a JOIN cells b ON a.image = b.image AND a.cell_id < b.cell_id JOIN cells c ON b.image = c.image AND b.cell_id < c.cell_id),
circle AS (SELECT image, i, j, k, x + (vy * (ux * ux + uy * uy) - uy * (vx * vx + vy * vy)) / (2 * (ux * vy - uy * vx)) AS ox, y + (ux * (vx * vx + vy * vy) - vx * (ux * ux + uy * uy)) / (2 * (ux * vy - uy * vx)) AS oy, x, y FROM tri WHERE abs(ux * vy - uy * vx) > 1e-14),
empty AS (SELECT image, i, j, k FROM circle t WHERE NOT EXISTS (SELECT 1 FROM cells p WHERE p.image = t.image AND p.cell_id NOT IN (t.i, t.j, t.k) AND pow(p.x - ox, 2) + pow(p.y - oy, 2) < (pow(t.x - ox, 2) + pow(t.y - oy, 2)) * (1 - 1e-9))),
side AS (SELECT image, i, j FROM empty UNION SELECT image, j, k FROM empty UNION SELECT image, i, k FROM empty)"""


@query("b15_delaunay", f"{DELAUNAY} SELECT side.image, i, j, round(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)), 6) AS dist FROM side JOIN cells p ON p.cell_id = i JOIN cells q ON q.cell_id = j WHERE sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 3e0")
def b15(spark, d):
    return rounded(graph.delaunay(cells(spark, d), 3.0))


@query("b16_edge_weights", f"{SYM} SELECT image, src, dst, round(1 / greatest(dist, 1e-12), 6) AS inverse, round(exp(-(dist * dist) / (2.0e0 * 0.5e0 * 0.5e0)), 6) AS gaussian FROM sym")
def b16(spark, d):
    s = graph.symmetric(_graph(spark, d)[1])
    both = graph.weighted(graph.weighted(s, "inverse").withColumnRenamed("weight", "inverse"), "gaussian", 0.5)
    return both.select("image", "src", "dst", F.round("inverse", 6).alias("inverse"), F.round("weight", 6).alias("gaussian"))


@query("b17_degree", f"{GRAPH}, {MOMENTS} SELECT image, c AS cell_id, d::BIGINT AS degree, list_sort(n)::VARCHAR AS neighbours FROM deg JOIN (SELECT src, list(dst) AS n FROM knn GROUP BY 1) l ON l.src = c")
def b17(spark, d):
    _, edges, pairs = _graph(spark, d)
    lists = graph.neighbour_lists(edges).select("image", "cell_id", F.concat(F.lit("["), F.array_join(F.col("neighbours").cast("array<string>"), ", "), F.lit("]")).alias("neighbours"))
    return graph.degrees(pairs).join(lists, ["image", "cell_id"])


@query("b18_nbr_composition", f"{SYM} SELECT c.image, c.cell_id, " + ", ".join(f"round(coalesce(sum(CASE WHEN q.class = {k} THEN 1 / dist ELSE 0e0 END) / sum(CASE WHEN q.class IS NOT NULL THEN 1 / dist END), 0e0), 6) AS share_{k}" for k in (0, 1, 2)) + " FROM cells c LEFT JOIN sym ON sym.image = c.image AND sym.src = c.cell_id LEFT JOIN (SELECT image, cell_id, CASE WHEN class < 3 THEN class END AS class FROM cells) q ON q.cell_id = sym.dst GROUP BY 1, 2")
def b18(spark, d):
    c = cells(spark, d).withColumn("class", F.when(F.col("class") < 3, F.col("class")))
    out = graph.neighbourhood_composition(c, graph.weighted(graph.symmetric(graph.knn_tiled(c, K)), "inverse"), [0, 1, 2], "weight")
    return out.select("image", "cell_id", *[F.round(f"share_{k}", 6).alias(f"share_{k}") for k in (0, 1, 2)])


def clq_sql(ks: list[int], cells_sql: str = CELLS_SQL, typed: str = "class IS NOT NULL") -> str:
    kk = ", ".join(f"({k})" for k in ks)
    return f"""WITH all_{cells_sql.replace('cells AS', 'cells AS', 1)}, cells AS (SELECT * FROM all_cells WHERE {typed}), {knn_sql(max(ks))}, ks AS (SELECT col0 AS k FROM (VALUES {kk})),
cc AS (SELECT image, class, count(*) AS nc FROM cells WHERE class IS NOT NULL GROUP BY 1, 2), nt AS (SELECT image, count(class) AS n FROM cells GROUP BY 1 HAVING count(*) > {max(ks)}),
cnt AS (SELECT knn.image, ks.k, p.class AS a, q.class AS b, count(*) AS c FROM knn JOIN ks ON knn.rank <= ks.k JOIN cells p ON p.image = knn.image AND p.cell_id = src JOIN cells q ON q.image = knn.image AND q.cell_id = dst GROUP BY 1, 2, 3, 4),
clq AS (SELECT x.image, ks.k::BIGINT AS k, x.class AS a, y.class AS b, x.nc AS n_a, y.nc AS n_b, nt.n AS n_typed, coalesce(c, 0)::BIGINT AS count,
CASE WHEN x.nc > 5 AND y.nc > 5 THEN (coalesce(c, 0)::DOUBLE / x.nc) / ((y.nc - CASE WHEN x.class = y.class THEN 1 ELSE 0 END)::DOUBLE / (nt.n - 1)) END AS clq
FROM cc x JOIN cc y ON x.image = y.image JOIN nt ON nt.image = x.image CROSS JOIN ks LEFT JOIN cnt ON cnt.image = x.image AND cnt.k = ks.k AND cnt.a = x.class AND cnt.b = y.class)"""


@query("b19_clq", f"{clq_sql([10])} SELECT image, k, a, b, n_a, n_b, n_typed, count, round(clq, 6) AS clq, round(clq / k, 6) AS clq_k FROM clq")
def b19(spark, d):
    return coloc.clq(cells(spark, d), [10]).withColumns({"clq": F.round("clq", 6), "clq_k": F.round("clq_k", 6)})


@query("b20_clq_many_k", f"{clq_sql([5, 10, 20])} SELECT image, k, a, b, count, round(clq / k, 6) AS clq_k FROM clq")
def b20(spark, d):
    return coloc.clq(cells(spark, d), [5, 10, 20]).select("image", "k", "a", "b", "count", F.round("clq_k", 6).alias("clq_k"))


_UNTYPED = CELLS_SQL.replace("(label % 6)::BIGINT AS class", "CASE WHEN label % 6 > 0 THEN (label % 6)::BIGINT END AS class")


@query("b21_clq_drop_unknown", f"{clq_sql([10], _UNTYPED)} SELECT image, a, b, count, round(clq / k, 6) AS clq_k FROM clq")
def b21_drop(spark, d):
    c = cells(spark, d).withColumn("class", F.when(F.col("class") > 0, F.col("class")))
    return coloc.clq(c, [10]).select("image", "a", "b", "count", F.round("clq_k", 6).alias("clq_k"))


@query("b21_clq_keep_unknown", f"{clq_sql([10], _UNTYPED, 'true')} SELECT image, a, b, count, round(clq / k, 6) AS clq_k FROM clq WHERE a IS NOT NULL AND b IS NOT NULL")
def b21_keep(spark, d):
    c = cells(spark, d).withColumn("class", F.when(F.col("class") > 0, F.col("class")))
    return coloc.clq(c, [10], keep_unknown=True).select("image", "a", "b", "count", F.round("clq_k", 6).alias("clq_k"))


QUOTIENTS = f"""{clq_sql([10])}, {dealt_sql(20261019, 500)}, hits AS (SELECT knn.image, p.r, p.class AS a, q.class AS b, count(*) AS n FROM knn JOIN lab p ON p.image = knn.image AND p.cell_id = src JOIN lab q ON q.image = knn.image AND q.cell_id = dst AND q.r = p.r GROUP BY 1, 2, 3, 4),
null_q AS (SELECT image, a, b, clq, (coalesce(n, 0)::DOUBLE / n_a) / ((n_b - CASE WHEN a = b THEN 1 ELSE 0 END)::DOUBLE / (n_typed - 1)) AS x FROM (SELECT * FROM clq, range(500) q(r)) LEFT JOIN hits USING (image, a, b, r)),
means AS (SELECT *, avg(x) OVER (PARTITION BY image, a, b) AS m FROM null_q),
found AS (SELECT image, a, b, any_value(clq) AS clq, any_value(m) AS m, stddev_samp(x) AS sd, count(*) FILTER (WHERE x < clq) / 500e0 AS share, (1 + count(*) FILTER (WHERE abs(x - m) >= abs(clq - m) - 1e-12)) / 501e0 AS p FROM means GROUP BY 1, 2, 3)"""


@query("b22_clq_permutation", f"""{QUOTIENTS} SELECT image, a::BIGINT AS a, b::BIGINT AS b, round(clq, 6) AS clq, CASE WHEN clq IS NOT NULL THEN round(m, 6) END AS perm_mean, CASE WHEN clq IS NOT NULL THEN round(sd, 6) END AS perm_sd, CASE WHEN clq IS NOT NULL THEN round(share, 6) END AS percentile,
CASE WHEN clq IS NOT NULL THEN share <= 0.05e0 OR share >= 0.95e0 END AS significant, CASE WHEN clq IS NOT NULL THEN round(p, 6) END AS p_two_sided FROM found""")
def b22(spark, d):
    return rounded(coloc.permuted_clq(cells(spark, d), 10, 500, 20261019))


@query("b23_patient_clq", f"{clq_sql([10])} SELECT image // 2 AS patient, a, b, round(sum(clq * n_typed) / sum(CASE WHEN clq IS NOT NULL THEN n_typed END), 4) AS clq, count(clq)::BIGINT AS n_images FROM clq GROUP BY 1, 2, 3")
def b23(spark, d):
    q = coloc.clq(cells(spark, d), [10]).withColumn("patient", F.floor(F.col("image") / 2))
    mean = F.sum(F.col("clq") * F.col("n_typed")) / F.sum(F.when(F.col("clq").isNotNull(), F.col("n_typed")))
    return q.groupBy("patient", "a", "b").agg(F.round(mean, 4).alias("clq"), F.count("clq").alias("n_images"))


@query("b24_grid_knn", f"WITH {CELLS_SQL}, {knn_sql(K)} SELECT image, src, dst, rank, round(d2, 6) AS d2 FROM knn")
def b24(spark, d):
    return graph.knn_grid(cells(spark, d), K).withColumn("d2", F.round("d2", 6))


@query("b25_model_composition", f"""WITH {CELLS_SQL}, c AS (SELECT image // 2 AS patient, class, count(*) AS n FROM cells GROUP BY 1, 2), g AS (SELECT p.patient, k.class, coalesce(n, 0) AS n FROM (SELECT DISTINCT patient FROM c) p CROSS JOIN (SELECT unnest(range(6)) AS class) k LEFT JOIN c ON c.patient = p.patient AND c.class = k.class)
SELECT patient, class, n::BIGINT AS n, round(ln(sum(n) OVER (PARTITION BY patient)), 6) AS log_n_typed, round(ln(n + 0.5e0) - avg(ln(n + 0.5e0)) OVER (PARTITION BY patient), 6) AS clr FROM g""")
def b25(spark, d):
    from pyspark.sql import Window

    n = cells(spark, d).groupBy(F.floor(F.col("image") / 2).alias("patient"), "class").agg(F.count("*").alias("n"))
    grid = coloc.full_grid(n, "patient", "class", list(range(6)), "n").withColumn("class", F.col("class").cast("long"))
    total = F.ln(F.sum("n").over(Window.partitionBy("patient")))
    ratio = coloc.clr(grid, "patient", "class", "n").withColumn("clr", F.round("clr", 6))
    return grid.withColumn("log_n_typed", F.round(total, 6)).join(ratio, ["patient", "class"])


@query("b26_null_acceptance", "WITH v AS (SELECT value / 50e0 AS r FROM events) SELECT round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high, round(avg(CASE WHEN r > 1e0 THEN 1e0 ELSE 0e0 END), 6) AS flagged, abs(quantile_cont(r, 0.5) - 1) <= 0.05e0 AS accepted FROM v")
def b26(spark, d):
    r = table(spark, d, "events").select((F.col("value") / 50.0).alias("r"))
    q = exact_quantiles(r, [], "r", [0.5, 0.025, 0.975]).crossJoin(r.agg(F.avg((F.col("r") > 1).cast("double")).alias("f")))
    return q.select(*[F.round(F.get("q", i), 6).alias(n) for i, n in enumerate(("median", "low", "high"))], F.round("f", 6).alias("flagged"), (F.abs(F.get("q", 0) - 1) <= 0.05).alias("accepted"))
