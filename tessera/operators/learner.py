"""What past searches teach: mode averages, trends, and the weight between keyword and vector search.

History has: store, seq, mode, confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOMENTUM, LOW, HIGH, STEP, MARGIN = 0.7, 0.2, 0.8, 0.1, 0.05


def _numbered(history: DataFrame) -> DataFrame:
    return history.withColumn("n", F.row_number().over(Window.partitionBy("store").orderBy(F.col("seq").desc())))


def mode_averages(history: DataFrame, last: int = 100) -> DataFrame:
    return _numbered(history).where(F.col("n") <= last).groupBy("store", "mode").agg(F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.count("*").alias("n"))


def recommended_alpha(history: DataFrame, current: float = 0.5) -> DataFrame:
    """store, alpha: moved toward the mode that did better in the last 100 searches; unchanged below 10 searches."""
    recent = _numbered(history).where("n <= 100").groupBy("store").agg(F.count("*").alias("n"), *(F.avg(F.when(F.col("mode") == m, F.col("confidence"))).alias(m) for m in ("semantic", "hybrid", "keyword")))
    vector, keyword = F.coalesce("semantic", "hybrid", F.lit(current)), F.coalesce("keyword", F.lit(current))
    target = F.when(vector > keyword + MARGIN, min(HIGH, current + STEP)).when(keyword > vector + MARGIN, max(LOW, current - STEP)).otherwise(current)
    return recent.select("store", F.when(F.col("n") < 10, current).otherwise(F.round(MOMENTUM * current + (1 - MOMENTUM) * target, 3)).alias("alpha"))


def alpha_path(history: DataFrame, every: int = 100, start: float = 0.5) -> DataFrame:
    """store, alpha after adapting once in every full `every` searches of the store, in order: an exponential average as an ordered fold."""
    step = F.floor((F.row_number().over(Window.partitionBy("store").orderBy("seq")) - 1) / every)
    parts = history.withColumn("step", step).groupBy("store", "step").agg(F.count("*").alias("n"), *(F.avg(F.when(F.col("mode") == m, F.col("confidence"))).alias(m) for m in ("semantic", "hybrid", "keyword"))).where(F.col("n") == every)
    steps = parts.groupBy("store").agg(F.array_sort(F.collect_list(F.struct("step", F.coalesce("semantic", "hybrid").alias("v"), F.col("keyword").alias("k")))).alias("steps"))

    def adapt(alpha, x):
        v, k = F.coalesce(x["v"], alpha), F.coalesce(x["k"], alpha)
        target = F.when(v > k + MARGIN, F.least(F.lit(HIGH), alpha + STEP)).when(k > v + MARGIN, F.greatest(F.lit(LOW), alpha - STEP)).otherwise(alpha)
        return F.round(MOMENTUM * alpha + (1 - MOMENTUM) * target, 3)

    return steps.select("store", F.aggregate("steps", F.lit(start), adapt).alias("alpha"))


def summary(history: DataFrame) -> DataFrame:
    """store, total, avg_confidence, trend: the last ten searches against the ten before."""
    recent, older = F.avg(F.when(F.col("n") <= 10, F.col("confidence"))), F.avg(F.when(F.col("n").between(11, 20), F.col("confidence")))
    trend = F.when(F.count("*") < 20, "insufficient_data").when(recent > older + MARGIN, "improving").when(recent < older - MARGIN, "declining").otherwise("stable")
    return _numbered(history).groupBy("store").agg(F.count("*").alias("total"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), trend.alias("trend"))


def evaluation(judged: DataFrame) -> DataFrame:
    """Per mode: answered share, hit rate, recall at 5 and mean reciprocal rank, from query_id, mode, rank (null: nothing found), relevant, n_relevant."""
    per = judged.groupBy("mode", "query_id").agg(
        F.max(F.col("rank").isNotNull()).alias("answered"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.count_if(F.col("relevant") & (F.col("rank") <= 5)).alias("found"),
        F.max("n_relevant").alias("n"),
    )
    return per.groupBy("mode").agg(
        F.count("*").alias("queries"),
        F.count_if("answered").alias("answered"),
        F.round(F.avg(F.col("first").isNotNull().cast("double")), 4).alias("hit_rate"),
        F.round(F.avg(F.when(F.col("n") > 0, F.col("found") / F.least("n", F.lit(5))).otherwise(0.0)), 4).alias("recall_at_5"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"),
    )
