"""Calibration and privacy queries."""

from pyspark.sql import functions as F

from portolan.functions.numeric import half_even, lenient_double
from portolan.operators import calibration as c
from portolan.operators import privacy as p
from portolan.operators.business import MISSING, truncated_categories
from portolan.plans.views import calibration_points, imports
from workload.catalog import HASH52, IMPORTS, VALUE, he, query
from workload.ranking import ppf_sql, rank_cte

_P = "greatest(0.01::DOUBLE, least(1::DOUBLE, value / 200::DOUBLE))"
POINTS = f"pts AS (SELECT event_id, (event_type IN ('error', 'purchase'))::INTEGER AS y, {_P} AS p FROM events)"
_EDGES = [1.0 if i == 15 else i * (1.0 / 15) for i in range(16)]
_BIN = "CASE " + " ".join(f"WHEN p >= {_EDGES[i]!r}::DOUBLE AND p < {_EDGES[i + 1]!r}::DOUBLE THEN {i}" for i in range(15)) + " END"
_CENTRE = "CASE b " + " ".join(f"WHEN {i} THEN {(_EDGES[i] + _EDGES[i + 1]) / 2!r}::DOUBLE" for i in range(15)) + " END"
BINS = f"""{POINTS}, binned AS (SELECT *, {_BIN} AS b FROM pts),
bins AS (SELECT b, count(*) AS n, avg(y) AS acc, avg(p) AS conf FROM binned WHERE b IS NOT NULL GROUP BY b)"""


@query("brier", f"WITH {POINTS} SELECT {he('avg((p - y) * (p - y))', 9)} AS brier FROM pts")
def brier(spark, d):
    return c.brier_score(calibration_points(spark, d)).select(half_even(F.col("brier"), 9).alias("brier"))


@query("ece", f"WITH {BINS} SELECT {he('sum(n * abs(acc - conf)) / (SELECT count(*) FROM pts)', 9)} AS ece FROM bins")
def ece(spark, d):
    return c.expected_calibration_error(calibration_points(spark, d)).select(half_even(F.col("ece"), 9).alias("ece"))


@query("mce", f"WITH {BINS} SELECT {he('max(abs(acc - conf))', 9)} AS mce FROM bins")
def mce(spark, d):
    return c.maximum_calibration_error(calibration_points(spark, d)).select(half_even(F.col("mce"), 9).alias("mce"))


@query(
    "reliability",
    f"""WITH {BINS} SELECT {he(_CENTRE, 9)} AS bin_center, {he("acc", 9)} AS accuracy, {he("conf", 9)} AS confidence, n AS "count" FROM bins""",
)
def reliability(spark, d):
    out = c.reliability(calibration_points(spark, d))
    return out.select(*[half_even(F.col(x), 9).alias(x) for x in ("bin_center", "accuracy", "confidence")], "count")


# Twins of the fits: Newton steps over weighted points as a recursion, one row for each step.
STEPS = 30
_SAFE = "greatest(1e-9::DOUBLE, least((1 - 1e-9)::DOUBLE, p::DOUBLE))"
_Q = "(1 / (1 + exp(-({})))::DOUBLE)"


def _newton_sql(name: str, points: str, features: list[str], by: str = "0") -> str:
    """CTE `name`(fold, it, a0, ...): Newton steps from zero; the equations are solved by Cramer's rule."""
    k = len(features)
    at = [f"a{i}" for i in range(k)]
    q = _Q.format(" + ".join(f"{a} * ({f})" for a, f in zip(at, features, strict=True)))
    sums = [f"sum(w * (q - y) * ({f})) AS g{i}" for i, f in enumerate(features)]
    sums += [f"sum(w * q * (1 - q) * ({features[i]}) * ({features[j]})) AS h{i}{j}" for i in range(k) for j in range(i, k)]
    cell = [[f"h{min(i, j)}{max(i, j)}" for j in range(k)] for i in range(k)]

    def det(m):
        if len(m) == 1:
            return m[0][0]
        return "(" + " + ".join(
            f"{'-' if j % 2 else ''}{m[0][j]} * {det([r[:j] + r[j + 1:] for r in m[1:]])}" for j in range(len(m))
        ) + ")"

    moved = [
        f"a{i} - {det([[f'g{r}' if c == i else cell[r][c] for c in range(k)] for r in range(k)])} / {det(cell)} AS a{i}" for i in range(k)
    ]
    start = ", ".join(f"0::DOUBLE AS {a}" for a in at)
    return f"""{name} AS (SELECT DISTINCT ({by})::BIGINT AS fold, 0 AS it, {start} FROM {points}
  UNION ALL SELECT fold, it + 1 AS it, {", ".join(moved)} FROM (
    SELECT fold, it, {", ".join(at)}, {", ".join(sums)} FROM (
      SELECT n.*, t.p, t.y, t.w, {q} AS q FROM {name} n JOIN {points} t ON ({by})::BIGINT = n.fold WHERE n.it < {STEPS})
    GROUP BY fold, it, {", ".join(at)}))"""


_WEIGHTED = "w AS (SELECT p, y::DOUBLE AS y, count(*)::DOUBLE AS w FROM pts GROUP BY p, y)"
_LOGS = [f"ln({_SAFE})", f"ln(1 - {_SAFE})", "1"]
_LOGIT = f"ln({_SAFE} / (1 - {_SAFE}))"
# The lower convex hull of (rows, positives) summed in order of p: from each vertex the flattest way on.
_HULL = """cum AS (SELECT p, row_number() OVER (ORDER BY p) AS i, sum(sum(w)) OVER (ORDER BY p) AS n, sum(sum(w * y)) OVER (ORDER BY p) AS s FROM w GROUP BY p),
hull AS (SELECT 0::BIGINT AS i, 0::DOUBLE AS n, 0::DOUBLE AS s, 0::BIGINT AS first, 0::DOUBLE AS slope
  UNION ALL SELECT * FROM (SELECT c.i, c.n, c.s, h.i + 1 AS first, (c.s - h.s) / (c.n - h.n) AS slope
    FROM hull h JOIN cum c ON c.i > h.i ORDER BY slope, c.i DESC LIMIT 1))"""
_FITS = {
    "platt": _newton_sql("platt", "w", ["p", "1"]),
    "isotonic": _HULL,
    "beta": _newton_sql("beta", "w", _LOGS),
    "temperature": _newton_sql("temp", "w", [_LOGIT]),
}
_LAST = f"(SELECT * FROM {{}} WHERE it = {STEPS})"
# (p, p_cal) of each method over the distinct probabilities.
_MAPS = {
    "platt": f"SELECT p, {_Q.format('a0 * p + a1')} AS p_cal FROM (SELECT DISTINCT p FROM w), {_LAST.format('platt')}",
    "isotonic": "SELECT p, slope AS p_cal FROM cum c JOIN hull h ON c.i BETWEEN h.first AND h.i AND h.i > 0",
    "beta": f"SELECT p, {_Q.format(' + '.join(f'a{i} * {f}' for i, f in enumerate(_LOGS)))} AS p_cal FROM (SELECT DISTINCT p FROM w), {_LAST.format('beta')}",
    "temperature": f"SELECT p, {_Q.format(f'a0 * {_LOGIT}')} AS p_cal FROM (SELECT DISTINCT p FROM w), {_LAST.format('temp')}",
}


def _calibrated(method):
    def run(spark, d):
        points = calibration_points(spark, d)
        out = c.FITTERS[method](points).apply(points, "p", "p_cal")
        return out.select("event_id", "y", "p", half_even(F.col("p_cal"), 9).alias("p_cal"))

    return run


for _method in c.METHODS:
    query(
        _method,
        f"""WITH RECURSIVE {POINTS}, {_WEIGHTED}, {_FITS[_method]}, m AS ({_MAPS[_method]})
        SELECT event_id, y, pts.p, {he("p_cal", 9)} AS p_cal FROM pts JOIN m ON pts.p = m.p""",
    )(_calibrated(_method))

_BIN_CAL = _BIN.replace("WHEN p >=", "WHEN p_cal >=").replace("AND p <", "AND p_cal <")
_TRIED = " UNION ALL ".join(
    f"SELECT {i} AS i, '{m}' AS method, w.y, w.w, p_cal FROM w JOIN ({_MAPS[m]}) m ON w.p = m.p" for i, m in enumerate(c.METHODS)
)


def _errors_sql(source: str) -> str:
    return f"""SELECT i, method, sum(e) / sum(n) AS brier, sum(gap) FILTER (b IS NOT NULL) / sum(n) AS ece, max(gap / n) FILTER (b IS NOT NULL) AS mce
    FROM (SELECT i, method, {_BIN_CAL} AS b, sum(w) AS n, abs(sum(w * y) - sum(w * p_cal)) AS gap, sum(w * (p_cal - y) * (p_cal - y)) AS e
      FROM {source} GROUP BY 1, 2, 3) GROUP BY i, method"""


@query(
    "auto_calibrate",
    f"""WITH RECURSIVE {POINTS}, {_WEIGHTED}, {", ".join(_FITS.values())}, tried AS ({_TRIED}), errs AS ({_errors_sql("tried")}),
    was AS ({_errors_sql("(SELECT 0 AS i, '' AS method, y, w, p AS p_cal FROM w)")}),
    best AS (SELECT * FROM errs ORDER BY round(ece, 12), i LIMIT 1)
    SELECT best.method, {", ".join(f"{he(f'was.{x}', 9)} AS {x}_before, {he(f'best.{x}', 9)} AS {x}_after" for x in ("brier", "ece", "mce"))},
    CASE WHEN best.method = 'temperature' THEN {he(f"(SELECT 1 / a0 FROM {_LAST.format('temp')})", 9)} ELSE 1 END::DOUBLE AS temperature FROM best, was""",
)
def auto(spark, d):
    report = c.fit_auto(calibration_points(spark, d)).report
    return report.select("method", *[half_even(F.col(x), 9).alias(x) for x in report.columns if x != "method"])


_SIDES = """ends AS (SELECT f.fold, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM pts, (SELECT DISTINCT event_id % 3 AS fold FROM pts) f
  WHERE event_id % 3 <> f.fold GROUP BY f.fold),
target AS (SELECT fold, p, CASE WHEN y = 1 THEN (pos + 1) / (pos + 2) ELSE 1 / (neg + 2) END::DOUBLE AS t, count(*) AS n
  FROM pts JOIN ends ON event_id % 3 <> fold GROUP BY ALL),
w AS (SELECT fold AS held, p, 1::DOUBLE AS y, t * n AS w FROM target UNION ALL SELECT fold, p, 0::DOUBLE, (1 - t) * n FROM target)"""


@query(
    "cross_fitted_sigmoid",
    f"""WITH RECURSIVE {POINTS}, {_SIDES}, {_newton_sql("fits", "w", ["p", "1"], "held")}
    SELECT event_id, event_id % 3 AS fold, y, p, {he(_Q.format("a0 * p + a1"), 9)} AS p_cal FROM pts JOIN {_LAST.format("fits")} f ON event_id % 3 = f.fold""",
)
def cross_fitted(spark, d):
    points = calibration_points(spark, d).withColumn("fold", F.col("event_id") % 3)
    out = c.cross_fitted_sigmoid(points)
    return out.select("event_id", "fold", "y", "p", half_even(F.col("p_cal"), 9).alias("p_cal"))


QUASI = ("pais_origem", "uf")


def _halves(spark, d, columns):
    df = imports(spark, d, (*columns, "l_linestatus"))
    return [df.where(F.col("l_linestatus") == s).drop("l_linestatus") for s in ("F", "O")]


def _k_sql(alias: str, status: str | None = None, source: str = "imports") -> str:
    where = f"WHERE l_linestatus = '{status}'" if status else ""
    return f"""{alias}_g AS (SELECT count(*) AS n FROM {source} {where} GROUP BY pais_origem, uf),
    {alias} AS (SELECT min(n) AS k_min, sum(n * n)::DOUBLE / sum(n)::DOUBLE AS k_medio, coalesce(sum(n) FILTER (n < 5), 0)::BIGINT AS rv,
      count(*) FILTER (n < 5) AS gv, sum(n)::BIGINT AS regs FROM {alias}_g)"""


_K_REPORT = f"""o.k_min AS k_min_original, s.k_min AS k_min_sintetico, {he("o.k_medio", 2)} AS k_medio_original, {he("s.k_medio", 2)} AS k_medio_sintetico,
    o.rv AS registros_violados_original, s.rv AS registros_violados_sintetico, o.gv AS grupos_violados_original, s.gv AS grupos_violados_sintetico,
    {he("s.rv::DOUBLE / s.regs * 100", 2)} AS registros_descartados_pct, s.k_min >= 5 AS passa_k"""


@query(
    "k_anonymity",
    f"""WITH {IMPORTS}, {_k_sql("o", "F")}, {_k_sql("s", "O")}
    SELECT {_K_REPORT} FROM o, s""",
)
def k_anonymity(spark, d):
    original, synthetic = _halves(spark, d, QUASI)
    return p.k_anonymity(original, synthetic, list(QUASI))


@query(
    "k_stats",
    f"""WITH {IMPORTS}, g AS (SELECT count(*) AS n FROM imports GROUP BY ncm, pais_origem, uf)
    SELECT min(n) AS k_min, {he("sum(n * n)::DOUBLE / sum(n)::DOUBLE", 6)} AS k_medio, coalesce(sum(n) FILTER (n < 5), 0)::BIGINT AS registros_violados,
    count(*) FILTER (n < 5) AS grupos_violados, sum(n)::BIGINT AS registros FROM g""",
)
def k_stats(spark, d):
    out = p.k_stats(imports(spark, d, ("ncm", "pais_origem", "uf")), ["ncm", "pais_origem", "uf"])
    return out.withColumn("k_medio", half_even(F.col("k_medio"), 6))


@query(
    "disclosure",
    f"""WITH {IMPORTS}, o AS (SELECT ncm, uf, count(*) AS n FROM imports WHERE l_linestatus = 'F' GROUP BY ALL),
    s AS (SELECT ncm, uf FROM imports WHERE l_linestatus = 'O')
    SELECT {he("sum((coalesce(n, 0) = 1)::INTEGER)::DOUBLE / count(*) * 100", 3)} AS taxa_divulgacao_pct
    FROM s LEFT JOIN o ON s.ncm IS NOT DISTINCT FROM o.ncm AND s.uf IS NOT DISTINCT FROM o.uf""",
)
def disclosure(spark, d):
    original, synthetic = _halves(spark, d, ("ncm", "uf"))
    return p.disclosure_rate(original, synthetic, ["ncm", "uf"])


def _numbers_sql(alias: str, status: str) -> str:
    return f"{alias} AS (SELECT {VALUE} AS v, peso_liquido AS w FROM imports WHERE l_linestatus = '{status}' AND {VALUE} IS NOT NULL)"


@query(
    "dcr",
    f"""WITH {IMPORTS}, {_numbers_sql("o", "F")}, {_numbers_sql("s", "O")},
    f AS (SELECT avg(v) AS mv, stddev_pop(v) + 1e-9::DOUBLE AS dv, avg(w) AS mw, stddev_pop(w) + 1e-9::DOUBLE AS dw FROM o),
    sn AS (SELECT row_number() OVER () AS i, (v - mv) / dv AS v, (w - mw) / dw AS w FROM s, f),
    onn AS (SELECT DISTINCT (v - mv) / dv AS v, (w - mw) / dw AS w FROM o, f),
    dist AS (SELECT i, sqrt(min((sn.v - onn.v) * (sn.v - onn.v) + (sn.w - onn.w) * (sn.w - onn.w))) AS d FROM sn CROSS JOIN onn GROUP BY i)
    SELECT {he("min(d)", 9)} AS dcr_min, {he("median(d)", 9)} AS dcr_med, {he("quantile_cont(d, 0.05)", 9)} AS dcr_p05 FROM dist""",
)
def dcr(spark, d):
    halves = _halves(spark, d, ("vmle_dolar", "peso_liquido"))
    original, synthetic = [h.withColumn("v", lenient_double("vmle_dolar")) for h in halves]
    out = p.closest_record_distance(original, synthetic, ["v", "peso_liquido"])
    return out.select(*[half_even(F.col(x), 9).alias(x) for x in ("dcr_min", "dcr_med", "dcr_p05")])


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    "copula_fit",
    " UNION ALL ".join(
        f"SELECT '{x}' AS \"column\", {he(f'avg({x})', 6)} AS mean, {he(f'stddev_samp({x})', 6)} AS std FROM lineitem" for x in _NUMERIC
    ),
)
def copula_fit(spark, d):
    from portolan.plans.views import table

    out = p.numeric_moments(table(spark, d, "lineitem"), list(_NUMERIC))
    return out.select("column", *[half_even(F.col(x), 6).alias(x) for x in ("mean", "std")])


@query(
    "copula_correlation",
    f"""WITH {", ".join(rank_cte(f"z{i}", "lineitem", x) for i, x in enumerate(_NUMERIC))},
    j AS (SELECT z0.z AS a, z1.z AS b, z2.z AS c FROM lineitem l JOIN z0 ON l.l_quantity = z0.value JOIN z1 ON l.l_extendedprice = z1.value
      JOIN z2 ON l.l_discount = z2.value)
    SELECT '{_NUMERIC[0]}' AS col_a, '{_NUMERIC[1]}' AS col_b, {he("corr(a, b)", 6)} AS corr FROM j
    UNION ALL SELECT '{_NUMERIC[0]}', '{_NUMERIC[2]}', {he("corr(a, c)", 6)} FROM j
    UNION ALL SELECT '{_NUMERIC[1]}', '{_NUMERIC[2]}', {he("corr(b, c)", 6)} FROM j""",
)
def copula_correlation(spark, d):
    from portolan.plans.views import table

    out = p.score_correlations(table(spark, d, "lineitem"), list(_NUMERIC))
    return out.withColumn("corr", half_even(F.col("corr"), 6))


@query(
    "copula_categories",
    f"""WITH {IMPORTS} SELECT pais_origem AS category, count(*) AS n, {he("count(*)::DOUBLE / (SELECT count(*) FROM imports)", 9)} AS share
    FROM imports GROUP BY pais_origem""",
)
def copula_categories(spark, d):
    return truncated_categories(imports(spark, d, ("pais_origem",)), "pais_origem").withColumn("share", half_even(F.col("share"), 9))


def _typed_imports(spark, d):
    df = imports(spark, d, ("ncm", "pais_origem", "uf", "vmle_dolar", "peso_liquido", "data_importacao"))
    return df.withColumn("vmle_dolar", lenient_double("vmle_dolar"))


SEED = 42


def _uniform_sql(column: str) -> str:
    return f"""({HASH52.format(f"'{SEED}|{column}|' || id")} + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE"""


def _categories_sql(column: str) -> str:
    """CTE <column>_r(category, low, high, total): the numbers that draw each category."""
    name, order = f"coalesce({column}, '{MISSING}')", f"ORDER BY {HASH52.format('category')} % 1024, category"
    return f"""{column}_c AS (SELECT {name} AS category, count(*) AS n FROM imports GROUP BY 1),
    {column}_r AS (SELECT category, coalesce(sum(n) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low,
      (sum(n) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS high FROM {column}_c),
    {column}_d AS (SELECT id, category AS {column} FROM (SELECT id, floor({_uniform_sql(column)} * (SELECT count(*) FROM imports))::BIGINT AS t FROM ids)
      JOIN {column}_r ON t >= low AND t < high)"""


IDS = "ids AS (SELECT range AS id FROM range((SELECT count(*) FROM imports)))"
_PAIR = ("vmle_dolar", "peso_liquido")


def _normals_sql() -> str:
    return ", ".join(
        f"u{i} AS (SELECT id, {_uniform_sql(x)} AS u FROM ids), g{i} AS (SELECT id, {ppf_sql('u')} AS z FROM u{i})" for i, x in enumerate(_PAIR)
    )


@query(
    "copula_sample",
    f"""WITH {IMPORTS}, typed AS (SELECT {VALUE} AS v, peso_liquido AS w FROM imports),
    {rank_cte("zv", "typed", "v")}, {rank_cte("zw", "typed", "w")},
    r AS (SELECT corr(zv.z, zw.z) AS r FROM typed JOIN zv ON v = zv.value JOIN zw ON w = zw.value),
    m AS (SELECT avg(v) AS mv, stddev_samp(v) AS dv, avg(w) AS mw, stddev_samp(w) AS dw FROM typed),
    {IDS}, {_normals_sql()}, {", ".join(_categories_sql(x) for x in ("ncm", "pais_origem", "uf"))},
    span AS (SELECT epoch_us(min(data_importacao)::TIMESTAMP) AS low, epoch_us(max(data_importacao)::TIMESTAMP) AS high FROM imports)
    SELECT {he("mv + dv * g0.z", 1)} AS vmle_dolar, {he("mw + dw * (r * g0.z + sqrt(1 - r * r) * g1.z)", 3)} AS peso_liquido, ncm, pais_origem, uf,
      make_timestamp(low + floor({_uniform_sql("data_importacao").replace("|| id", "|| g0.id")} * (high - low)::DOUBLE)::BIGINT)::DATE AS data_importacao
    FROM g0 JOIN g1 ON g0.id = g1.id JOIN ncm_d ON g0.id = ncm_d.id JOIN pais_origem_d ON g0.id = pais_origem_d.id JOIN uf_d ON g0.id = uf_d.id, m, r, span""",
)
def copula_sample(spark, d):
    out = p.sample_copula(spark, p.fit_copula(_typed_imports(spark, d)), seed=SEED)
    rounded = {"vmle_dolar": half_even(F.col("vmle_dolar"), 1), "peso_liquido": half_even(F.col("peso_liquido"), 3)}
    return out.withColumns({**rounded, "data_importacao": F.to_date("data_importacao")})


@query(
    "generate_and_validate",
    f"""WITH {IMPORTS}, {IDS}, {_categories_sql("pais_origem")}, {_categories_sql("uf")},
    synthetic AS (SELECT pais_origem, uf FROM pais_origem_d JOIN uf_d USING (id)),
    {_k_sql("o")}, {_k_sql("s", source="synthetic")},
    single AS (SELECT pais_origem, uf, count(*) AS n FROM imports GROUP BY ALL),
    rate AS (SELECT sum((coalesce(n, 0) = 1)::INTEGER)::DOUBLE / count(*) * 100 AS pct FROM synthetic t
      LEFT JOIN single g ON t.pais_origem IS NOT DISTINCT FROM g.pais_origem AND t.uf IS NOT DISTINCT FROM g.uf)
    SELECT {_K_REPORT}, NULL::DOUBLE AS dcr_min, NULL::DOUBLE AS dcr_med, NULL::DOUBLE AS dcr_p05, {he("pct", 3)} AS taxa_divulgacao_pct,
      (SELECT count(*) FROM imports) AS n_original, (SELECT count(*) FROM imports) AS n_sintetico FROM o, s, rate""",
)
def generate(spark, d):
    return p.generate_and_validate(spark, _typed_imports(spark, d), list(QUASI), seed=SEED)[1]
