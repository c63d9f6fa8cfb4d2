"""Rankings, samples, outliers, candidates and company reports."""

from pyspark.sql import functions as F

from portolan.functions.numeric import half_even
from portolan.operators import topk as t
from portolan.operators.candidates import RANKED, delivery, first_gate_delivery, select_candidates, validate_candidates
from portolan.operators.history import session_pattern
from portolan.operators.outliers import lof_scores, outliers_iqr
from portolan.operators.privacy import normal_scores
from portolan.operators.quantiles import average_rank, quantiles, value_ranks
from portolan.plans.company import company_report
from portolan.plans.views import cnpj_candidates, event_sessions, imports, table
from portolan.sinks.writers import company_report_lines
from workload.catalog import HASH52, IMPORTS, VALUE, VK, he, query
from workload.cleaning import CANDIDATES, W1, W2, NORMAL, dv_sql


@query(
    "topk_por_grupo",
    f"""WITH {IMPORTS} SELECT pais_origem, chave_item, score FROM imports
    QUALIFY row_number() OVER (PARTITION BY pais_origem ORDER BY score DESC NULLS LAST, chave_item) <= 50""",
)
def topk(spark, d):
    return t.topk_per_group(imports(spark, d, ("pais_origem", "chave_item", "score")), "pais_origem", "score", ["chave_item"], 50)


@query(
    "largest_ops",
    f"""WITH {IMPORTS} SELECT chave_item, ncm, pais_origem, descricao, vmle_dolar FROM imports
    ORDER BY {VALUE} DESC NULLS LAST, chave_item LIMIT 5""",
)
def largest(spark, d):
    df = imports(spark, d, ("chave_item", "ncm", "pais_origem", "descricao", "vmle_dolar"))
    return t.largest_operations(df, "vmle_dolar", ["chave_item"])


@query("longest_desc", "SELECT doc_id, length(text)::INTEGER AS tamanho_desc FROM documents ORDER BY 2 DESC, doc_id LIMIT 3")
def longest(spark, d):
    return t.longest_texts(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id", "tamanho_desc")


@query(
    "first_rows",
    f"WITH {IMPORTS} SELECT chave_item, cnpj FROM imports ORDER BY chave_item LIMIT 30000",
)
def first_rows(spark, d):
    return t.first_rows(imports(spark, d, ("chave_item", "cnpj")), ["chave_item"])


@query(
    "capped_sample",
    f"""WITH {IMPORTS}, h AS (SELECT uf, chave_item, {HASH52.format("chave_item")} AS h FROM imports)
    SELECT uf, chave_item FROM (SELECT *, row_number() OVER (PARTITION BY uf ORDER BY h, chave_item) AS rn FROM h)
    WHERE rn <= 200 ORDER BY h, chave_item LIMIT 30000""",
)
def capped(spark, d):
    return t.capped_sample(imports(spark, d, ("uf", "chave_item")), "uf", ["chave_item"])


@query(
    "strat_split",
    f"""WITH {IMPORTS}, h AS (SELECT pais_origem, chave_item, {HASH52.format("chave_item")} AS h FROM imports),
    r AS (SELECT *, row_number() OVER (PARTITION BY pais_origem ORDER BY h) AS rn, count(*) OVER (PARTITION BY pais_origem) AS n FROM h)
    SELECT chave_item, pais_origem, CASE WHEN rn <= ceil(0.2 * n) AND n >= 2 THEN 'test' ELSE 'train' END AS split FROM r""",
)
def split(spark, d):
    df = imports(spark, d, ("chave_item", "pais_origem"))
    return t.stratified_split(df, "pais_origem", ["chave_item"]).select("chave_item", "pais_origem", "split")


@query(
    "avg_rank",
    f"""WITH {IMPORTS}, v AS (SELECT {VALUE} AS v FROM imports WHERE {VALUE} IS NOT NULL),
    c AS (SELECT v, count(*) AS n FROM v GROUP BY v),
    r AS (SELECT v, n, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM c)
    SELECT v AS value, n, {he("(b::DOUBLE + (n + 1)::DOUBLE / 2) / t::DOUBLE", 9)} AS pct_rank FROM r""",
)
def avg_rank(spark, d):
    df = imports(spark, d, ("vmle_dolar",)).select(F.col("vmle_dolar").try_cast("double").alias("v"))
    return average_rank(df, F.col("v")).withColumn("pct_rank", half_even(F.col("pct_rank"), 9))


@query(
    "group_quantiles",
    f"""WITH {IMPORTS} SELECT uf, {he(f"quantile_cont({VK}, 0.25)", 6)} AS q1, {he(f"median({VK})", 6)} AS med,
    {he(f"quantile_cont({VK}, 0.75)", 6)} AS q3 FROM imports GROUP BY uf""",
)
def group_quantiles(spark, d):
    from portolan.operators.kpis import value_per_kg

    df = imports(spark, d, ("uf", "vmle_dolar", "peso_liquido"))
    out = quantiles(df, value_per_kg(), {"q1": 0.25, "med": 0.5, "q3": 0.75}, ["uf"])
    return out.select("uf", *[half_even(F.col(c), 6).alias(c) for c in ("q1", "med", "q3")])


@query(
    "outliers_iqr",
    f"""WITH s AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT event_id, value, {he("q3 - q1", 6)} AS iqr, {he("q3 + 1.5::DOUBLE * (q3 - q1)", 6)} AS limite_superior
    FROM events, s WHERE value > q3 + 1.5::DOUBLE * (q3 - q1) OR value < q1 - 1.5::DOUBLE * (q3 - q1)""",
)
def iqr(spark, d):
    out = outliers_iqr(table(spark, d, "events").select("event_id", "value"), "value")
    return out.withColumns({c: half_even(F.col(c), 6) for c in ("iqr", "limite_superior")})


@query(
    "outliers_iqr_imports",
    f"""WITH {IMPORTS}, v AS (SELECT chave_item, {VK} AS valor_kg FROM imports),
    s AS (SELECT quantile_cont(valor_kg, 0.25) AS q1, quantile_cont(valor_kg, 0.75) AS q3 FROM v)
    SELECT chave_item, {he("valor_kg", 6)} AS valor_kg FROM v, s
    WHERE valor_kg > q3 + 1.5::DOUBLE * (q3 - q1) OR valor_kg < q1 - 1.5::DOUBLE * (q3 - q1)""",
)
def iqr_imports(spark, d):
    from portolan.operators.kpis import value_per_kg

    df = imports(spark, d, ("chave_item", "vmle_dolar", "peso_liquido")).select("chave_item", value_per_kg().alias("valor_kg"))
    return outliers_iqr(df, "valor_kg").select("chave_item", half_even(F.col("valor_kg"), 6).alias("valor_kg"))


@query(
    "lof_scores",
    f"""WITH pts AS (SELECT p_partkey AS id, p_brand AS g, p_size::DOUBLE AS x, p_retailprice AS y FROM part),
    sizes AS (SELECT g, count(*) AS n FROM pts GROUP BY g),
    pairs AS (SELECT a.g, a.id, b.id AS nb, b.x AS bx, b.y AS bby, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
              FROM pts a JOIN pts b ON a.g = b.g AND a.id <> b.id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, bx, bby, nb) AS rn FROM pairs),
    near AS (SELECT g, id, nb, sqrt(d2) AS dist FROM ranked JOIN sizes USING (g) WHERE rn <= least(20, n - 1)),
    kd AS (SELECT id, max(dist) AS kdist FROM near GROUP BY id),
    dens AS (SELECT near.id, 1::DOUBLE / (avg(greatest(dist, kdist)) + 1e-10::DOUBLE) AS lrd
             FROM near JOIN kd ON near.nb = kd.id GROUP BY near.id),
    fac AS (SELECT near.g, near.id, avg(o.lrd) / m.lrd AS f FROM near JOIN dens o ON near.nb = o.id JOIN dens m ON near.id = m.id
            GROUP BY near.g, near.id, m.lrd),
    lim AS (SELECT g, min(f) AS lo, max(f) AS hi, quantile_cont(-f, 0.1) AS cut FROM fac GROUP BY g),
    sc AS (SELECT id, (f - lo) / (hi - lo + 1e-9::DOUBLE) AS s, -f < cut AS outlying FROM fac JOIN lim USING (g))
    SELECT p_partkey, {he("CASE WHEN n < 10 THEN 0 WHEN outlying THEN s ELSE s * 0.3::DOUBLE END", 6)} AS KPI_Outlier
    FROM part JOIN sizes ON p_brand = g LEFT JOIN sc ON p_partkey = id""",
)
def lof(spark, d):
    out = lof_scores(table(spark, d, "part"), ["p_size", "p_retailprice"], scope="p_brand")
    return out.select("p_partkey", half_even(F.col("KPI_Outlier"), 6).alias("KPI_Outlier"))


@query("lof_blocks")
def lof_blocks(spark, d):
    df = imports(spark, d, ("chave_item", "vmle_dolar", "peso_liquido", "score"))
    return lof_scores(df.withColumn("v", F.col("vmle_dolar").try_cast("double")), ["v", "peso_liquido", "score"]).select(
        "chave_item", "KPI_Outlier"
    )


# Predictions for candidate rules: one guess per line item, confidence and score from its own figures.
GUESSES = f"""guess AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS chave_item, cnpj AS CNPJ_Previsto,
         l_discount * 8 + 0.2::DOUBLE AS CNPJ_Confianca, l_quantity * 2 AS RiskScore
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN candidates ON o_custkey = chave
), leveled AS (
  SELECT *, CASE WHEN RiskScore < 25 THEN 'BAIXO' WHEN RiskScore < 50 THEN 'MEDIO' WHEN RiskScore < 75 THEN 'ALTO'
    WHEN RiskScore < 100.01 THEN 'CRITICO' END AS RiskLevel FROM guess
)"""


def _guesses(spark, d, leveled=True):
    from portolan.functions.scoring import risk_level

    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = lines.join(cnpj_candidates(spark, d), F.col("o_custkey") == F.col("chave")).select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]).alias("chave_item"),
        F.col("cnpj").alias("CNPJ_Previsto"),
        (F.col("l_discount") * 8 + 0.2).alias("CNPJ_Confianca"),
        (F.col("l_quantity") * 2).alias("RiskScore"),
    )
    return df.withColumn("RiskLevel", risk_level(F.col("RiskScore"))) if leveled else df


_CID = NORMAL.replace("cnpj", "CNPJ_Previsto")
VALIDATED = f"""{CANDIDATES}, {GUESSES}, ids AS (SELECT *, {_CID} AS cid FROM leveled),
checked AS (
  SELECT *, coalesce({dv_sql("cid", W1)} = substring(cid, 13, 1)::INTEGER AND {dv_sql("cid", W2)} = substring(cid, 14, 1)::INTEGER
    AND cid <> repeat(substring(cid, 1, 1), 14), false) AS CNPJ_Valido,
    RiskScore >= 50 AS Score_Valido, RiskLevel IN ('BAIXO', 'MEDIO') AS Risk_Valido, CNPJ_Confianca >= 0.6 AS Confianca_Valida
  FROM ids
)"""


@query(
    "candidates",
    f"""WITH {VALIDATED} SELECT chave_item, CNPJ_Valido, Score_Valido, Risk_Valido, Confianca_Valida,
    CNPJ_Valido AND Score_Valido AND Risk_Valido AND Confianca_Valida AS Candidato_Valido FROM checked""",
)
def candidates(spark, d):
    flags = ("CNPJ_Valido", "Score_Valido", "Risk_Valido", "Confianca_Valida", "Candidato_Valido")
    return validate_candidates(_guesses(spark, d)).select("chave_item", *flags)


_BEST = "CNPJ_Confianca DESC NULLS LAST, RiskScore DESC NULLS LAST, CNPJ_Previsto NULLS LAST"


def _selection_sql(where: str) -> str:
    return f"""WITH {VALIDATED}, usable AS (SELECT * FROM checked WHERE {where}),
    best AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY chave_item ORDER BY {_BEST}) = 1)
    SELECT chave_item, CNPJ_Previsto AS CNPJ FROM best ORDER BY {_BEST}, chave_item LIMIT 50"""


@query("candidate_selection", _selection_sql("CNPJ_Valido AND Score_Valido AND Confianca_Valida"))
def selection(spark, d):
    rows = validate_candidates(_guesses(spark, d), levels=("BAIXO", "MEDIO", "ALTO", "CRITICO"))
    return delivery(select_candidates(rows.select(*RANKED)))


@query("candidate_fallback", _selection_sql("true"))
def fallback(spark, d):
    return delivery(select_candidates(validate_candidates(_guesses(spark, d)).select(*RANKED)))


@query(
    "first_gate_delivery",
    f"""WITH {CANDIDATES} SELECT chave AS numero_de_ordem, {NORMAL} AS CNPJ FROM candidates ORDER BY 1, 2 LIMIT 50""",
)
def first_gate(spark, d):
    return first_gate_delivery(cnpj_candidates(spark, d), "chave", "cnpj")


_KPI = {"KPI_Views": "avg((event_type = 'view')::INTEGER) * 2.5::DOUBLE", "KPI_Clicks": "avg((event_type = 'click')::INTEGER) * 2.6::DOUBLE",
        "KPI_Value": "least(1::DOUBLE, avg(value) / 45::DOUBLE)"}


@query(
    "session_pattern",
    f"""WITH s AS (SELECT strftime(ts, '%Y-%m-%d') AS day, avg((event_type = 'error')::INTEGER) AS acc,
      avg((event_type = 'error')::INTEGER) + avg((event_type = 'click')::INTEGER) AS top5,
      {", ".join(f"{e} AS {n}" for n, e in _KPI.items())} FROM events GROUP BY 1),
    l AS (SELECT * FROM s ORDER BY day DESC LIMIT 10),
    k AS ({" UNION ALL ".join(f"SELECT '{n}' AS kpi, sum(({n} > 0.5)::INTEGER) AS hits FROM l" for n in _KPI)}),
    rec AS (SELECT coalesce(string_agg(kpi, ',' ORDER BY kpi), '') AS names FROM k WHERE hits >= 0.6 * (SELECT count(*) FROM l))
    SELECT count(*) AS sessoes_analisadas, {he("avg(acc)", 4)} AS accuracy_media, {he("stddev_pop(acc)", 4)} AS accuracy_std,
      {he("avg(top5)", 4)} AS top5_media,
      CASE WHEN max_by(acc, day) > min_by(acc, day) + 0.02::DOUBLE THEN 'melhora'
           WHEN max_by(acc, day) < min_by(acc, day) - 0.02::DOUBLE THEN 'degradacao' ELSE 'estavel' END AS tendencia,
      (SELECT names FROM rec) AS kpis_recorrentes, substring(md5((SELECT names FROM rec)), 1, 12) AS assinatura,
      (SELECT count(*) FROM s) >= 10 AS pronto_para_palpite, NULL::VARCHAR AS aviso FROM l""",
)
def pattern(spark, d):
    return session_pattern(event_sessions(spark, d))


_PROB = "greatest(0.01::DOUBLE, least(0.99::DOUBLE, score))"


@query(
    "company_report",
    f"""WITH {IMPORTS},
    base AS (SELECT cnpj, any_value(razao_social) AS r, count(*) AS total_registros, count(DISTINCT ncm) AS ncms_distintos,
      count(DISTINCT pais_origem) AS paises_distintos, avg({VALUE}) AS vm, quantile_cont({VALUE}, 0.95) AS p95,
      quantile_cont({VALUE}, 0.25) AS q1, quantile_cont({VALUE}, 0.75) AS q3 FROM imports GROUP BY cnpj),
    best AS (SELECT cnpj, sum(least(n, 10))::BIGINT AS topk_registros FROM (SELECT cnpj, ncm, count(*) AS n FROM imports GROUP BY ALL) GROUP BY cnpj),
    outl AS (SELECT cnpj, count(*) AS outliers FROM imports JOIN base USING (cnpj)
      WHERE {VALUE} > q3 + 1.5::DOUBLE * (q3 - q1) OR {VALUE} < q1 - 1.5::DOUBLE * (q3 - q1) GROUP BY cnpj),
    anon AS (SELECT cnpj, min(n) AS k_min FROM (SELECT cnpj, ncm, pais_origem, uf, count(*) AS n FROM imports GROUP BY ALL) GROUP BY cnpj),
    bins AS (SELECT cnpj, CASE WHEN {_PROB} >= 1 THEN NULL ELSE len(list_filter(range(1, 15), lambda i: {_PROB} >= i * (1::DOUBLE / 15))) END AS b,
      count(*) AS n, sum(suspeito) AS sy, sum({_PROB}) AS sp FROM imports GROUP BY ALL),
    err AS (SELECT cnpj, sum(CASE WHEN b IS NOT NULL THEN abs(sy - sp) ELSE 0 END) / sum(n) AS ece FROM bins GROUP BY cnpj)
    SELECT cnpj, substring(cnpj,1,2) || '.' || substring(cnpj,3,3) || '.' || substring(cnpj,6,3) || '/' || substring(cnpj,9,4) || '-' || substring(cnpj,13,2) AS cnpj_formatado,
      true AS valido, r AS razao_social,
      CASE WHEN upper(r) LIKE '%LTDA%' THEN 'Ltda' WHEN upper(r) LIKE '%S/A%' OR upper(r) LIKE '%SA%' THEN 'S/A'
           WHEN upper(r) LIKE '%EIRELI%' THEN 'EIRELI' WHEN upper(r) LIKE '%ME%' THEN 'ME' ELSE 'DESCONHECIDO' END AS tipo,
      len(string_split(r, ' '))::INTEGER AS palavras, length(r)::INTEGER AS tamanho, total_registros, ncms_distintos, paises_distintos,
      {he("vm", 4)} AS vmle_medio, {he("p95", 4)} AS vmle_p95, topk_registros, coalesce(outliers, 0) AS outliers_encontrados, k_min, {he("ece", 9)} AS ece
    FROM base JOIN best USING (cnpj) LEFT JOIN outl USING (cnpj) JOIN anon USING (cnpj) JOIN err USING (cnpj)""",
)
def company(spark, d):
    columns = ("cnpj", "razao_social", "ncm", "pais_origem", "uf", "vmle_dolar", "score", "suspeito")
    return company_report(imports(spark, d, columns))


@query(
    "company_text_report",
    f"""WITH {IMPORTS}, n AS (SELECT DISTINCT cnpj, razao_social AS r FROM imports)
    SELECT cnpj, 'CNPJ: ' || cnpj || chr(10) || '  Formatado: ' || substring(cnpj,1,2) || '.' || substring(cnpj,3,3) || '.' || substring(cnpj,6,3) || '/' || substring(cnpj,9,4) || '-' || substring(cnpj,13,2)
      || chr(10) || '  Status: VALIDO' || chr(10) || 'Razao Social: ' || r || chr(10) || '  Tipo: ' ||
      CASE WHEN upper(r) LIKE '%LTDA%' THEN 'Ltda' WHEN upper(r) LIKE '%S/A%' OR upper(r) LIKE '%SA%' THEN 'S/A'
           WHEN upper(r) LIKE '%EIRELI%' THEN 'EIRELI' WHEN upper(r) LIKE '%ME%' THEN 'ME' ELSE 'DESCONHECIDO' END
      || chr(10) || '  Palavras: ' || len(string_split(r, ' '))::VARCHAR || chr(10) || '  Tamanho: ' || length(r)::VARCHAR || ' caracteres' AS value FROM n""",
)
def text_report(spark, d):
    return company_report_lines(imports(spark, d, ("cnpj", "razao_social")).distinct())


from portolan.functions.numeric import (  # noqa: E402
    PPF_CENTRE_DEN, PPF_CENTRE_NUM, PPF_MIDDLE_DEN, PPF_MIDDLE_NUM, PPF_TAIL_DEN, PPF_TAIL_NUM,
)


def poly_sql(x: str, coefficients) -> str:
    out = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def ppf_sql(p: str) -> str:
    """The inverse normal distribution function of a column name, in SQL."""
    q, r = f"({p} - 0.5::DOUBLE)", f"sqrt(-ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END))"
    rc, rm, rt = f"(0.180625::DOUBLE - {q} * {q})", f"({r} - 1.6::DOUBLE)", f"({r} - 5::DOUBLE)"
    outer = (
        f"(CASE WHEN {r} <= 5 THEN {poly_sql(rm, PPF_MIDDLE_NUM)} / {poly_sql(rm, PPF_MIDDLE_DEN)} "
        f"ELSE {poly_sql(rt, PPF_TAIL_NUM)} / {poly_sql(rt, PPF_TAIL_DEN)} END)"
    )
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {poly_sql(rc, PPF_CENTRE_NUM)} / {poly_sql(rc, PPF_CENTRE_DEN)} "
        f"WHEN {q} < 0 THEN -{outer} ELSE {outer} END"
    )


def rank_cte(name: str, source: str, value: str) -> str:
    """CTE name(value, n, z): normal score of the average rank."""
    return f"""{name}_c AS (SELECT {value} AS value, count(*) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY 1),
    {name}_r AS (SELECT value, n, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE,
      (coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + (n + 1)::DOUBLE / 2) / sum(n) OVER ())) AS u FROM {name}_c),
    {name} AS (SELECT value, n, {ppf_sql("u")} AS z FROM {name}_r)"""


@query(
    "normal_scores",
    f"WITH {rank_cte('ns', 'events', 'value')} SELECT value, {he('z', 8)} AS z FROM ns",
)
def scores(spark, d):
    return normal_scores(table(spark, d, "events"), "value").withColumn("z", half_even(F.col("z"), 8))


@query(
    "value_ranks",
    """WITH c AS (SELECT event_type, user_id AS value, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, value, n, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "before",
      (sum(n) OVER (PARTITION BY event_type))::BIGINT AS total FROM c""",
)
def ranks(spark, d):
    return value_ranks(table(spark, d, "events"), F.col("user_id"), ["event_type"])
