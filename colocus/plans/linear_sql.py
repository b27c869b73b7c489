"""SQL of linear and Cox models with few columns, for the oracles of families D, E and F.

The factor is solved by centring within its levels, so the covariates are left
with a system of two equations at most, and everything else is closed form: the
level effects, all standard errors, the tail of t as its finite sum for whole
degrees of freedom, the tail of F for four levels' contrasts, and the quantile
of t as its expansion in 1 / df (exact to nine digits from df = 40 on).
"""

from __future__ import annotations

#: The response (mean order price) with segment, balance and nation band, as plans.models.analysis has it.
ANALYSIS = """a AS (SELECT o_custkey AS id, o_orderstatus AS pair, avg(o_totalprice) / 100000e0 AS y, c_mktsegment AS segment, c_acctbal / 1000e0 AS age, (c_nationkey % 3)::DOUBLE AS grade
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 4, 5, 6)"""


def _solved(name: str, rows: str, keys: str, level: str, u: str, v: str | None) -> str:
    """CTE ``name``: per group the two slopes, their unscaled covariance, rss, n and number of levels, centred within (keys, level)."""
    within = f"{keys}, {level}" if level else keys
    second = f"{v} - avg({v}) OVER (PARTITION BY {within})" if v else "0e0"
    sums = "sum(cu * cu) AS suu, sum(cu * cy) AS suy, sum(cy * cy) AS syy, " + ("sum(cv * cv) AS svv, sum(cu * cv) AS suv, sum(cv * cy) AS svy" if v else "1e0 AS svv, 0e0 AS suv, 0e0 AS svy")
    levels = f"count(DISTINCT {level})" if level else "1"
    return f"""{name}_c AS (SELECT *, {u} - avg({u}) OVER (PARTITION BY {within}) AS cu, {second} AS cv, y - avg(y) OVER (PARTITION BY {within}) AS cy FROM {rows}),
{name}_s AS (SELECT {keys}, count(*) AS n, {levels} AS levels, {sums} FROM {name}_c GROUP BY {keys}),
{name} AS (SELECT {keys}, n, levels, (suy * svv - svy * suv) / (suu * svv - suv * suv) AS bu, (svy * suu - suy * suv) / (suu * svv - suv * suv) AS bv,
svv / (suu * svv - suv * suv) AS vu, suu / (suu * svv - suv * suv) AS vv, -suv / (suu * svv - suv * suv) AS vuv,
syy - (suy * suy * svv - 2 * suy * svy * suv + svy * svy * suu) / (suu * svv - suv * suv) AS rss, n - levels - {2 if v else 1} AS df FROM {name}_s)"""


def coefficients(name: str, rows: str, first: str, u: str, v: str | None, least: int = 50) -> str:
    """CTEs that end in ``name`` (pair, term, estimate, se, low, high, p, n): every term of the model by pair; ``first`` is the reference level."""
    w = f"avg({v})" if v else "0e0"
    slope = f" UNION ALL SELECT pair, '{v}', bv, vv, rss, df, n FROM {name}_m" if v else ""
    z = 1.959963984540054
    steps = (z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    quantile = "(" + " + ".join(f"{c:.12f}e0 / df ** {i}" for i, c in enumerate(steps)) + ")"
    return f"""{_solved(f"{name}_m", rows, "pair", "segment", u, v)},
{name}_l AS (SELECT pair, segment, count(*) AS nl, avg(y) AS my, avg({u}) AS mu, {w} AS mv FROM {rows} GROUP BY 1, 2),
{name}_f AS (SELECT * FROM {name}_l WHERE segment = '{first}'),
{name}_t AS (SELECT pair, 'intercept' AS term, my - bu * mu - bv * mv AS estimate, 1e0 / nl + mu * mu * vu + mv * mv * vv + 2 * mu * mv * vuv AS unscaled, rss, df, n FROM {name}_f JOIN {name}_m USING (pair)
UNION ALL SELECT l.pair, l.segment, l.my - f.my - bu * (l.mu - f.mu) - bv * (l.mv - f.mv), 1e0 / l.nl + 1e0 / f.nl + (l.mu - f.mu) ** 2 * vu + (l.mv - f.mv) ** 2 * vv + 2 * (l.mu - f.mu) * (l.mv - f.mv) * vuv, rss, df, n
FROM {name}_l l JOIN {name}_f f USING (pair) JOIN {name}_m USING (pair) WHERE l.segment <> '{first}'
UNION ALL SELECT pair, '{u}', bu, vu, rss, df, n FROM {name}_m{slope}),
{name}_e AS (SELECT pair, term, estimate, sqrt(unscaled * rss / df) AS se, df, n, atan(abs(estimate) / sqrt(unscaled * rss / df) / sqrt(df)) AS th FROM {name}_t WHERE n >= {least}),
{name}_k AS (SELECT k::DOUBLE AS k FROM range(0, (SELECT max(df) // 2 + 1 FROM {name}_e)) r(k)),
{name}_p AS (SELECT pair, term, CASE WHEN any_value(df) % 2 = 0 THEN 1 - sin(any_value(th)) * sum(CASE WHEN 2 * k < df THEN exp(lgamma(k + 0.5e0) - lgamma(k + 1e0) - lgamma(0.5e0) + 2 * k * ln(cos(th))) ELSE 0e0 END)
ELSE 1 - 2 / pi() * (any_value(th) + sin(any_value(th)) * sum(CASE WHEN 2 * k <= df - 3 THEN exp(lgamma(k + 1e0) + lgamma(1.5e0) - lgamma(k + 1.5e0) + (2 * k + 1) * ln(cos(th))) ELSE 0e0 END)) END AS p FROM {name}_e, {name}_k GROUP BY 1, 2),
{name} AS (SELECT pair, term, estimate, se, estimate - se * {quantile} AS low, estimate + se * {quantile} AS high, p, n FROM {name}_e JOIN {name}_p USING (pair, term))"""


def f_test(name: str, rows: str, keys: str, least: int = 50) -> str:
    """CTEs that end in ``name`` (keys, n, f, df1, df2, p): the factor against the covariates alone; five levels, so df1 is four and the tail a short sum."""
    return f"""{_solved(f"{name}_m", rows, keys, "segment", "age", "grade")}, {_solved(f"{name}_0", rows, keys, "", "age", "grade")},
{name}_f AS (SELECT {", ".join(f"m.{k.strip()}" for k in keys.split(","))}, m.n AS n, ((z.rss - m.rss) / (m.levels - 1)) / (m.rss / m.df) AS f, m.levels - 1 AS df1, m.df AS df2 FROM {name}_m m JOIN {name}_0 z USING ({keys}) WHERE m.n >= {least}),
{name} AS (SELECT *, (df2 / (df2 + df1 * f)) ** (df2 / 2e0) * (1 + df2 / 2e0 * (1 - df2 / (df2 + df1 * f))) AS p FROM {name}_f)"""


def permuted(seed: int, permutations: int) -> str:
    """CTE ``perm``: the rows with the segments moved to other subjects, alike in all pairs, by the order of the md5 of seed, permutation and id."""
    return f"""subj AS (SELECT DISTINCT id, segment FROM a), b AS (SELECT b::BIGINT AS permutation FROM range({permutations}) r(b)),
place AS (SELECT id, row_number() OVER (ORDER BY id) AS p FROM subj),
dealt AS (SELECT permutation, segment, row_number() OVER (PARTITION BY permutation ORDER BY md5('{seed}-' || permutation::VARCHAR || '-' || id::VARCHAR), id) AS p FROM subj, b),
perm AS (SELECT a.id, a.pair, a.y, a.age, a.grade, permutation, dealt.segment FROM a JOIN place USING (id) JOIN dealt USING (p))"""


def cox(name: str, rows: str, alpha: float, both: bool = True, steps: int = 12) -> str:
    """CTE ``name`` (bu, bv): Breslow's Cox model of rows (time, event, u, v) less alpha / 2 times the squares, by unrolled Newton steps from 0; without ``both`` v has no part."""
    out = [f"{name}_b0 AS (SELECT 0e0 AS bu, 0e0 AS bv)"]
    for i in range(steps):
        last = i == steps - 1
        out.append(f"""{name}_w{i} AS (SELECT time, bu, bv, count(*) FILTER (WHERE event) AS d, coalesce(sum(u) FILTER (WHERE event), 0) AS eu, coalesce(sum(v) FILTER (WHERE event), 0) AS ev,
sum(w) AS w, sum(w * u) AS wu, sum(w * v) AS wv, sum(w * u * u) AS wuu, sum(w * u * v) AS wuv, sum(w * v * v) AS wvv FROM (SELECT *, exp(bu * u + bv * v) AS w FROM {rows}, {name}_b{i}) GROUP BY 1, 2, 3),
{name}_t{i} AS (SELECT bu, bv, d, eu, ev, sum(w) OVER o AS s, sum(wu) OVER o AS su, sum(wv) OVER o AS sv, sum(wuu) OVER o AS suu, sum(wuv) OVER o AS suv, sum(wvv) OVER o AS svv FROM {name}_w{i} WINDOW o AS (ORDER BY time DESC)),
{name}_h{i} AS (SELECT bu, bv, sum(eu - d * su / s) - {alpha!r}e0 * bu AS gu, sum(ev - d * sv / s) - {alpha!r}e0 * bv AS gv, sum(d * (suu / s - su / s * su / s)) + {alpha!r}e0 AS huu,
sum(d * (suv / s - su / s * sv / s)) AS huv, {f"sum(d * (svv / s - sv / s * sv / s)) + {alpha!r}e0" if both else "1e0"} AS hvv FROM {name}_t{i} GROUP BY 1, 2),
{name if last else f"{name}_b{i + 1}"} AS (SELECT bu + (gu * hvv - gv * huv) / (huu * hvv - huv * huv) AS bu, bv + (gv * huu - gu * huv) / (huu * hvv - huv * huv) AS bv FROM {name}_h{i})""")
    return ",\n".join(out)
