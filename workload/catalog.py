"""Registry of queries and shared SQL fragments of their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from portolan.plans.views import AS_OF, NAME_ENDINGS, STATES, STATUSES

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(func: Query) -> Query:
        _QUERIES[name] = func
        if sql is not None:
            _SQL[name] = sql
        return func

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def he(expr: str, digits: int) -> str:
    """Half-even rounding in SQL."""
    return f"(round_even(({expr})::DOUBLE * {10**digits}::DOUBLE, 0)::DOUBLE / {10**digits}::DOUBLE)"


def clip01(expr: str, default: str = "0") -> str:
    return f"greatest(0::DOUBLE, least(1::DOUBLE, coalesce({expr}, {default}::DOUBLE)))"


def pick(values: tuple[str, ...], index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({index}) + 1]"


NUM = "try_cast({} AS DOUBLE)"
VALUE = NUM.format("vmle_dolar")

IMPORTS = f"""imports AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS chave_item,
         lpad(o_custkey::VARCHAR, 14, '0') AS cnpj,
         c_name AS importador,
         c_name || {pick(NAME_ENDINGS, "o_custkey % 5")} AS razao_social,
         lpad(l_partkey::VARCHAR, 8, '0') AS ncm,
         concat_ws(' ', p_name, p_type) AS descricao,
         CASE WHEN l_linenumber = 7 AND l_quantity > 45 THEN 'n/d' ELSE l_extendedprice::VARCHAR END AS vmle_dolar,
         CASE WHEN l_quantity = 1 THEN 0::DOUBLE ELSE l_quantity END AS peso_liquido,
         o_orderdate AS eta,
         CASE WHEN l_suppkey % 10 <> 0
              THEN o_orderdate + to_days((l_partkey % 21 - 10)::INTEGER) + to_hours(l_linenumber * 5) END AS eta_real,
         n_name AS pais_origem,
         {pick(STATES, "c_nationkey")} AS uf,
         l_discount * 10 AS score,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS suspeito,
         l_shipdate AS data_importacao,
         l_linestatus
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
)"""


def credit_sql(status: str, age: str, capital: str, partners: str) -> str:
    s, a, c, p = f"lower(coalesce({status}, ''))", f"coalesce({age}, 0)", f"coalesce({capital}, 0)", f"coalesce({partners}, 0)"
    return clip01(
        f"""0.5::DOUBLE
        + CASE WHEN {s} LIKE '%ativa%' THEN 0.2::DOUBLE
               WHEN {s} LIKE '%baixada%' OR {s} LIKE '%suspensa%' THEN -0.3::DOUBLE ELSE 0::DOUBLE END
        + CASE WHEN {a} >= 10 THEN 0.15::DOUBLE WHEN {a} < 2 THEN -0.15::DOUBLE ELSE 0::DOUBLE END
        + CASE WHEN {c} > 1000000 THEN 0.1::DOUBLE WHEN {c} < 10000 THEN -0.05::DOUBLE ELSE 0::DOUBLE END
        + CASE WHEN {p} > 2 THEN 0.05::DOUBLE ELSE 0::DOUBLE END"""
    )


OPENED = "DATE '1990-01-01' + (c_custkey * 37 % 12000)::INTEGER"


def age_sql(opened: str) -> str:
    return he(f"date_diff('day', ({opened})::DATE, DATE '{AS_OF}')::DOUBLE / 365.25::DOUBLE", 2)


REGISTRY = f"""registry_base AS (
  SELECT lpad(c_custkey::VARCHAR, 14, '0') AS cnpj,
         {pick(STATUSES, "c_custkey % 4")} AS ext_situacao,
         c_acctbal * 200 AS ext_capital,
         ({OPENED})::DATE AS ext_abertura,
         (c_custkey % 5)::INTEGER AS ext_socios,
         {pick(STATES, "c_nationkey")} AS ext_uf,
         n_name AS ext_municipio
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE c_acctbal >= 0
), registry_aged AS (
  SELECT *, {age_sql("ext_abertura")} AS ext_idade FROM registry_base
), registry AS (
  SELECT *, {credit_sql("ext_situacao", "ext_idade", "ext_capital", "ext_socios")} AS ext_score_credito FROM registry_aged
)"""

ENRICHED = f"""{IMPORTS}, {REGISTRY}, enriched AS (
  SELECT i.* EXCLUDE (l_linestatus), r.ext_situacao, r.ext_idade, r.ext_score_credito, r.ext_capital
  FROM imports i LEFT JOIN registry r ON i.cnpj = r.cnpj
)"""


def blob_sql(text: str) -> str:
    return f"regexp_replace(lower({text}), '[^a-z0-9]', '', 'g')"


def grams_sql(source: str, text: str, top: int = 50) -> str:
    """CTE chain ending in top_grams(gram, freq) over distinct texts of `source`."""
    parts = " UNION ALL ".join(
        f"SELECT blob, copies, substring(blob, i::BIGINT, {n}) AS gram "
        f"FROM (SELECT blob, copies, unnest(range(1, length(blob) - {n} + 2)) AS i FROM blobs WHERE length(blob) >= {n})"
        for n in (2, 3, 4, 5)
    )
    return f"""blobs AS (
  SELECT {blob_sql(text)} AS blob, count(*) AS copies FROM {source} GROUP BY 1
), occurrences AS ({parts}
), per_text AS (SELECT blob, copies, gram, count(*) AS tf FROM occurrences GROUP BY 1, 2, 3
), gram_freq AS (SELECT gram, sum(tf * copies)::BIGINT AS freq, sum(copies)::BIGINT AS docs FROM per_text GROUP BY 1
), top_grams AS (
  SELECT gram, freq FROM gram_freq WHERE docs >= 2 AND freq > 1 ORDER BY freq DESC, gram LIMIT {top}
)"""


INPUT_COLUMNS = (
    "chave_item", "cnpj", "importador", "razao_social", "ncm", "descricao", "vmle_dolar", "peso_liquido", "eta",
    "eta_real", "pais_origem", "uf", "score", "suspeito", "data_importacao",
)
NULL_COUNT = " + ".join(f"({c} IS NULL)::INTEGER" for c in INPUT_COLUMNS)
VK = f"({VALUE} / nullif({NUM.format('peso_liquido')}, 0))"
DIGITS = "regexp_replace(ncm, '\\D', '', 'g')"
DAYS = "abs(floor((epoch_us(eta_real) - epoch_us(eta))::DOUBLE / 86400000000::DOUBLE))"

KPI_ROWS = f"""{ENRICHED}, {grams_sql("imports", "descricao")},
stats AS (SELECT median({VK}) AS med FROM enriched),
imp AS (SELECT importador AS imp_name, avg({VALUE}) AS m, stddev_samp({VALUE}) AS s FROM enriched GROUP BY 1),
pattern AS (
  SELECT blob, {he("least((SELECT count(*) FROM top_grams WHERE contains(blob, gram))::DOUBLE / 10::DOUBLE, 1)", 4)} AS hit
  FROM blobs
),
kpi_rows AS MATERIALIZED (
  SELECT e.*, row_number() OVER () AS lin,
    {clip01(f"(med - {VK}) / CASE WHEN med <> 0 THEN med ELSE 1 END")} AS KPI_Subvalorizacao,
    {clip01(f"(CASE WHEN {DIGITS} LIKE '%0' THEN 1 ELSE 0 END)::DOUBLE / nullif(length({DIGITS}), 0)")} AS KPI_DisparidadeHS,
    {clip01(f"({VALUE} - m) / (nullif(s, 0) * 3::DOUBLE)")} AS KPI_SurgeVolume,
    {clip01(f"{DAYS} / 7::DOUBLE")} AS KPI_DesvioETA,
    ({NULL_COUNT})::DOUBLE / {len(INPUT_COLUMNS)}::DOUBLE AS KPI_Completude,
    CASE WHEN coalesce(lower(ext_situacao) LIKE '%ativa%', false) THEN 0::DOUBLE ELSE 1::DOUBLE END AS KPI_Ext_ConsistenciaCadastral,
    {clip01("1 - ext_idade / 10::DOUBLE", "0.5")} AS KPI_Ext_IdadeEmpresa,
    coalesce(1 - ext_score_credito, 0.5::DOUBLE) AS KPI_Ext_ScoreCredito,
    hit AS KPI_PadraoChar,
    coalesce({VK}, 0) AS FE_ValorPorKg
  FROM enriched e CROSS JOIN stats
  JOIN imp ON e.importador = imp.imp_name
  JOIN pattern ON {blob_sql("e.descricao")} = pattern.blob
)"""


def risk_sql(weights: dict[str, float], kpis: tuple[str, ...]) -> str:
    total = " + ".join(f"{w}::DOUBLE * {k}" for k, w in weights.items() if k in kpis)
    return he(f"greatest(0::DOUBLE, least(100::DOUBLE, (0::DOUBLE + {total}) * 100))", 2)


LEVEL = """CASE WHEN RiskScore < 25 THEN 'BAIXO' WHEN RiskScore < 50 THEN 'MEDIO'
  WHEN RiskScore < 75 THEN 'ALTO' WHEN RiskScore < 100.01 THEN 'CRITICO' END"""
COLOUR = """CASE RiskLevel WHEN 'BAIXO' THEN '#C6EFCE' WHEN 'MEDIO' THEN '#FFEB9C'
  WHEN 'ALTO' THEN '#FFC7CE' WHEN 'CRITICO' THEN '#C00000' ELSE '#FFFFFF' END"""


def lof_sql(source: str, key: str, scope: tuple[str, ...], columns: list[str]) -> str:
    """CTE chain ending in outlying(id, KPI_Outlier): the factor of every row from all pairs of its scope, 20 neighbours."""
    xs = [f"x{i}" for i in range(len(columns))]
    squared = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in xs)
    return f"""lof_pts AS MATERIALIZED (
  SELECT {key} AS id, concat_ws(chr(31), {", ".join(scope)}) AS g, {", ".join(f"coalesce({c}, 0)::DOUBLE AS {x}" for c, x in zip(columns, xs))} FROM {source}
), lof_sizes AS (SELECT g, count(*) AS n FROM lof_pts GROUP BY g
), lof_pairs AS (
  SELECT a.g, a.id, b.id AS nb, {", ".join(f"b.{x}" for x in xs)}, {squared} AS d2 FROM lof_pts a JOIN lof_pts b ON a.g = b.g AND a.id <> b.id
), lof_ranked AS (SELECT g, id, nb, d2, row_number() OVER (PARTITION BY id ORDER BY d2, {", ".join(xs)}, nb) AS rn FROM lof_pairs
), lof_near AS MATERIALIZED (SELECT g, id, nb, sqrt(d2) AS dist FROM lof_ranked JOIN lof_sizes USING (g) WHERE rn <= least(20, n - 1)
), lof_reach AS (SELECT id, max(dist) AS reach FROM lof_near GROUP BY id
), lof_dense AS MATERIALIZED (
  SELECT near.id, 1::DOUBLE / (avg(greatest(dist, reach)) + 1e-10::DOUBLE) AS density FROM lof_near near JOIN lof_reach r ON near.nb = r.id GROUP BY near.id
), lof_factor AS MATERIALIZED (
  SELECT near.g, near.id, avg(o.density) / m.density AS f
  FROM lof_near near JOIN lof_dense o ON near.nb = o.id JOIN lof_dense m ON near.id = m.id GROUP BY near.g, near.id, m.density
), lof_sorted AS (SELECT g, min(f) AS lo, max(f) AS hi, list_sort(list(-{he("f", 9)})) AS l, count(*) - 1 AS n FROM lof_factor GROUP BY g
), lof_limits AS (SELECT g, lo, hi, l[n // 10 + 1] + (l[least(n // 10 + 2, n + 1)] - l[n // 10 + 1]) * (n % 10) / 10::DOUBLE AS cut FROM lof_sorted
), lof_scaled AS (SELECT id, (f - lo) / (hi - lo + 1e-9::DOUBLE) AS s, -{he("f", 9)} < cut AS flagged FROM lof_factor JOIN lof_limits USING (g)
), outlying AS (
  SELECT p.id, CASE WHEN n < 10 THEN 0::DOUBLE WHEN flagged THEN s ELSE s * 0.3::DOUBLE END AS KPI_Outlier
  FROM lof_pts p JOIN lof_sizes USING (g) LEFT JOIN lof_scaled z ON p.id = z.id
)"""


OUTLIER_SCOPE = ("pais_origem", "uf")


def risk_rows(weights: dict[str, float], kpis: tuple[str, ...]) -> str:
    derived = [he(c, 6) for c in sorted((*(c for c in kpis if c != "KPI_Outlier"), "FE_ValorPorKg"))]
    return f"""{KPI_ROWS}, {lof_sql("kpi_rows", "lin", OUTLIER_SCOPE, [VALUE, "peso_liquido", "ext_capital", *derived])},
whole AS (SELECT k.*, KPI_Outlier FROM kpi_rows k JOIN outlying ON lin = id),
scored AS (SELECT *, {risk_sql(weights, kpis)} AS RiskScore FROM whole),
leveled AS (SELECT *, {LEVEL} AS RiskLevel FROM scored),
risk AS (SELECT *, {COLOUR} AS RiskColor FROM leveled)"""


HASH52 = "('0x' || substring(md5({}), 1, 13))::BIGINT"
