"""Tables written by the sinks and read back by the sources."""

from pyspark.sql import functions as F

from portolan.functions.scoring import WEIGHTS_10
from portolan.operators import kpis as k
from portolan.plans.views import IMPORT_COLUMNS, imports, table
from portolan.session import scratch_path
from portolan.sinks import writers as w
from portolan.sources import files as s
from workload.catalog import DAYS, IMPORTS, INPUT_COLUMNS, NULL_COUNT, clip01, query, risk_sql

_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("register_csv", f"SELECT {', '.join(_ORDERS)} FROM orders")
def register_csv(spark, d):
    """Semicolon-separated parts with headers; types come back as they went."""
    path = scratch_path(spark, "orders_csv")
    table(spark, d, "orders").select(*_ORDERS).write.csv(path, sep=";", header=True)
    s.register_csv(spark, "pedidos_csv", path)
    out = spark.table("pedidos_csv")
    return out.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), *_ORDERS[2:])


@query(
    "register_auto",
    """SELECT n_nationkey::BIGINT AS chave, n_name AS nome, 'parquet' AS tipo FROM nation
    UNION ALL SELECT s_suppkey::BIGINT, s_name, 'csv' FROM supplier""",
)
def register_auto(spark, d):
    """A folder of Parquet parts and one of CSV parts, told apart by what they hold."""
    nations, suppliers = scratch_path(spark, "nations"), scratch_path(spark, "suppliers")
    w.export_parquet(table(spark, d, "nation"), nations)
    table(spark, d, "supplier").select("s_suppkey", "s_name").write.csv(suppliers, sep=";", header=True)
    n, p = s.register_auto(spark, "nacoes_auto", nations), s.register_auto(spark, "fornecedores_auto", suppliers)
    return n.select(F.col("n_nationkey").cast("long").alias("chave"), F.col("n_name").alias("nome"), F.lit("parquet").alias("tipo")).unionByName(
        p.select(F.col("s_suppkey").cast("long").alias("chave"), F.col("s_name").alias("nome"), F.lit("csv").alias("tipo"))
    )


@query("export_parquet", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag FROM lineitem")
def export_parquet(spark, d):
    path = scratch_path(spark, "export")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    w.export_parquet(rows, path, partition_by=["l_returnflag"])
    return spark.read.parquet(path).select(*rows.columns)


_TWO = ("KPI_DesvioETA", "KPI_Completude")


@query(
    "scored_parts",
    f"""WITH {IMPORTS}, kpi_rows AS (SELECT chave_item, {clip01(f"{DAYS} / 7::DOUBLE")} AS KPI_DesvioETA,
      ({NULL_COUNT})::DOUBLE / {len(INPUT_COLUMNS)}::DOUBLE AS KPI_Completude FROM imports)
    SELECT chave_item, {risk_sql(WEIGHTS_10, _TWO)} AS RiskScore FROM kpi_rows""",
)
def scored_parts(spark, d):
    """Scores written twice: the second set of parts replaces the first."""
    path = scratch_path(spark, "scored")
    scored = k.with_risk(k.kpi_completeness(k.kpi_eta(imports(spark, d)), list(IMPORT_COLUMNS))).select("chave_item", "RiskScore")
    w.write_scored(scored.withColumn("RiskScore", F.lit(-1.0)), path)
    w.write_scored(scored, path)
    return spark.read.parquet(path)


@query("event_log", "SELECT event_id, user_id, event_type, value FROM events")
def event_log(spark, d):
    """Run events appended kind by kind as JSON lines."""
    path = scratch_path(spark, "log")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    failed = F.coalesce(F.col("event_type") == "error", F.lit(False))
    w.append_events(events.where(failed), path)
    w.append_events(events.where(~failed), path)
    return spark.read.schema(events.schema).json(path)


@query("session_log", "SELECT user_id, count(*) AS n, sum(value > 100)::BIGINT AS altos FROM events GROUP BY user_id")
def session_log(spark, d):
    """One row for each user and run, appended as Parquet and summed over the runs."""
    path = scratch_path(spark, "sessions")
    events = table(spark, d, "events")
    error = F.coalesce(F.col("event_type") == "error", F.lit(False))
    for run in (error, ~error):
        w.append_session(events.where(run).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).alias("altos")), path)
    return spark.read.parquet(path).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("altos").alias("altos"))
