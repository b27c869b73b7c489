"""The jobs as queries: each runs twice into one new folder, and its output is read back."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from colocus.plans.registry import rounded
from colocus.plans.spatial import MOMENTS, knn_sql
from colocus.sources.files import scratch
from colocus.sources.tables import CELLS_BIG_SQL, SURVIVAL_SQL
from jobs import spatial_features, text_audit
from jobs.common import config_of

HERE = Path(__file__).parent


def job1_spatial_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, block, feature, value of the feature store after a second run."""
    target, config = scratch(spark, "job1"), config_of(str(HERE / "spatial_features.py"))
    for _ in range(2):
        spatial_features.run(spark, f"{sf_dir}/events.parquet", target, config)
    return rounded(spatial_features.features(spark, target))


CLASSES = config_of(str(HERE / "spatial_features.py"))["classes"]
_LOG = {c: f"ln((count(*) FILTER (WHERE class = '{c}')) + 0.5e0)" for c in CLASSES}
JOB1_SQL = f"""WITH all_{CELLS_BIG_SQL}, cells AS (SELECT * FROM all_cells WHERE image IN (SELECT image FROM all_cells GROUP BY image HAVING count(*) >= 40 AND count(*) FILTER (WHERE class = 'purchase') > 0)),
{knn_sql(10)}, und AS (SELECT DISTINCT image, least(src, dst) AS i, greatest(src, dst) AS j FROM knn WHERE rank <= 8), {MOMENTS}, {SURVIVAL_SQL},
own AS (SELECT user_id AS image, least(time, 180e0) AS time, event AND NOT time > 180e0 AS event FROM subjects WHERE time > 0 AND user_id IN (SELECT image FROM cells)),
logs AS (SELECT image, {', '.join(f"{e} AS {c}" for c, e in _LOG.items())} FROM cells GROUP BY image),
cnt AS (SELECT knn.image, p.class AS a, q.class AS b, count(*) AS c FROM knn JOIN cells p ON p.image = knn.image AND p.cell_id = src JOIN cells q ON q.image = knn.image AND q.cell_id = dst GROUP BY 1, 2, 3),
quo AS (SELECT x.image, x.class AS a, y.class AS b, CASE WHEN x.nc > 5 AND y.nc > 5 THEN (coalesce(c, 0)::DOUBLE / x.nc) / ((y.nc - CASE WHEN x.class = y.class THEN 1 ELSE 0 END)::DOUBLE / (n - 1)) / 10 END AS value
  FROM cc x JOIN cc y ON x.image = y.image JOIN nn ON nn.image = x.image LEFT JOIN cnt ON cnt.image = x.image AND cnt.a = x.class AND cnt.b = y.class),
frac AS (SELECT knn.image, avg(CASE WHEN q.class IN ('click', 'view') THEN 1e0 ELSE 0e0 END) AS value FROM knn JOIN cells p ON p.cell_id = src AND p.class = 'purchase' JOIN cells q ON q.cell_id = dst WHERE rank <= 8 GROUP BY 1),
mix AS (SELECT und.image, count(*) FILTER (WHERE p.class = 'purchase' AND q.class IN ('click', 'view') OR q.class = 'purchase' AND p.class IN ('click', 'view')) AS ti, count(*) FILTER (WHERE p.class IN ('click', 'view') AND q.class IN ('click', 'view')) AS ii
  FROM und JOIN cells p ON p.cell_id = i JOIN cells q ON q.cell_id = j GROUP BY 1),
found AS (SELECT image, 'outcome' AS block, 'time' AS feature, time AS value FROM own UNION ALL SELECT image, 'outcome', 'event', CASE WHEN event THEN 1e0 ELSE 0e0 END FROM own
UNION ALL SELECT image, 'composition', 'n_cells', n::DOUBLE FROM nn
{' '.join(f"UNION ALL SELECT image, 'composition', 'clr_{c}', {c} - ({' + '.join(CLASSES)}) / {len(CLASSES)} FROM logs" for c in CLASSES)}
UNION ALL SELECT image, 'enrichment', 'z_' || a || '_' || b, CASE WHEN na >= 5 AND nb >= 5 AND var > 1e-9 THEN (observed - mean) / sqrt(var) END FROM mom
UNION ALL SELECT image, 'quotient', 'clq_' || a || '_' || b, value FROM quo
UNION ALL SELECT image, 'mixing', 'fraction', value FROM frac UNION ALL SELECT image, 'mixing', 'mixing', CASE WHEN ti + ii > 0 THEN ti::DOUBLE / (ti + ii) END FROM mix)
SELECT image, block, feature, round(value, 6) AS value FROM found WHERE value IS NOT NULL"""


def job2_text_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, lang, class, n, n_words, share, clr, eligible after a second run, which finds nothing new."""
    target, config = scratch(spark, "job2"), config_of(str(HERE / "text_audit.py"))
    for _ in range(2):
        text_audit.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", target, f"{target}/checkpoint", config)
    return rounded(text_audit.summary(spark, target))


JOB2_SQL = r"""WITH d AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS s FROM documents),
t AS (SELECT source, lang, w, CASE WHEN w = 0 THEN 'empty' WHEN w < 50 THEN 'short' WHEN 100 * s > 2 * w THEN 'marked' WHEN w >= 1000 THEN 'long' ELSE 'prose' END AS class FROM d),
g AS (SELECT source, lang, count(*) AS total FROM t GROUP BY 1, 2),
x AS (SELECT g.source, g.lang, k.class, total, count(t.w) AS n, coalesce(sum(t.w), 0)::BIGINT AS n_words FROM g CROSS JOIN (VALUES ('empty'), ('short'), ('marked'), ('long'), ('prose')) k(class)
  LEFT JOIN t ON t.source IS NOT DISTINCT FROM g.source AND t.lang IS NOT DISTINCT FROM g.lang AND t.class = k.class GROUP BY 1, 2, 3, 4)
SELECT source, lang, class, n, n_words, round(n::DOUBLE / total, 6) AS share, round(ln(n + 0.5e0) - avg(ln(n + 0.5e0)) OVER (PARTITION BY source, lang), 6) AS clr, total >= 5 AS eligible FROM x"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_spatial_features": job1_spatial_features, "job2_text_audit": job2_text_audit}
ORACLES: dict[str, str] = {"job1_spatial_features": JOB1_SQL, "job2_text_audit": JOB2_SQL}
