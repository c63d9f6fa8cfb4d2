"""Pattern over the last sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions.numeric import half_even
from portolan.functions.scoring import signature
from portolan.operators.topk import last_rows

# Sessions looked at, fewest for a pattern, trend step, KPI limit and share of sessions.
SESSIONS = 10
FEWEST = 3
TREND_STEP = 0.02
KPI_LIMIT = 0.5
SESSION_SHARE = 0.6


def session_pattern(sessions: DataFrame, order: str = "timestamp") -> DataFrame:
    """One row over sessions (order, accuracy, top_5, kpis map<string,double>): means, trend, recurring
    KPIs, signature, readiness. With fewer than three sessions only `aviso` is filled."""
    last = last_rows(sessions, order, SESSIONS)
    accuracy = F.coalesce(F.col("accuracy"), F.lit(0.0))
    figures = last.agg(
        F.count(F.lit(1)).alias("n"),
        half_even(F.avg(accuracy), 4).alias("accuracy_media"),
        half_even(F.stddev_pop(accuracy), 4).alias("accuracy_std"),
        half_even(F.avg(F.coalesce(F.col("top_5"), F.lit(0.0))), 4).alias("top5_media"),
        F.min_by(accuracy, order).alias("first_acc"),
        F.max_by(accuracy, order).alias("last_acc"),
    )
    high = (
        last.select(F.explode("kpis").alias("kpi", "level"))
        .where(F.col("level") > KPI_LIMIT)
        .groupBy("kpi")
        .agg(F.count(F.lit(1)).alias("hits"))
        .agg(F.collect_list(F.struct("kpi", "hits")).alias("hits"))
    )
    total = sessions.agg(F.count(F.lit(1)).alias("t")).scalar()
    enough = F.col("n") >= FEWEST
    return (
        figures.withColumns({"hits": high.scalar(), "total": total})
        .withColumn(
            "recurring",
            F.sort_array(
                F.transform(
                    F.filter("hits", lambda h: h["hits"] >= F.lit(SESSION_SHARE) * F.col("n")), lambda h: h["kpi"]
                )
            ),
        )
        .select(
            F.when(enough, F.col("n")).alias("sessoes_analisadas"),
            F.when(enough, F.col("accuracy_media")).alias("accuracy_media"),
            F.when(enough, F.col("accuracy_std")).alias("accuracy_std"),
            F.when(enough, F.col("top5_media")).alias("top5_media"),
            F.when(
                enough,
                F.when(F.col("last_acc") > F.col("first_acc") + TREND_STEP, "melhora")
                .when(F.col("last_acc") < F.col("first_acc") - TREND_STEP, "degradacao")
                .otherwise("estavel"),
            ).alias("tendencia"),
            F.when(enough, F.array_join("recurring", ",")).alias("kpis_recorrentes"),
            F.when(enough, signature(F.col("recurring"))).alias("assinatura"),
            F.when(enough, F.col("total") >= SESSIONS).alias("pronto_para_palpite"),
            F.when(~enough, F.format_string("Historico curto (%d sessoes).", "n")).alias("aviso"),
        )
    )
