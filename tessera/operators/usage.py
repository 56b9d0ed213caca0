"""Usage analytics over request records.

Records have: api_key, endpoint, request_tokens, response_tokens, request_bytes, response_bytes, duration_ms, status, ts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUOTA = {"daily_requests": 10_000, "daily_tokens": 1_000_000, "monthly_requests": 300_000, "monthly_tokens": 30_000_000, "alert_pct": 80.0}


def tokens() -> Column:
    return F.col("request_tokens") + F.col("response_tokens")


def volume() -> Column:
    return F.col("request_bytes") + F.col("response_bytes")


def between(records: DataFrame, key: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Records of a key and of a time range with both ends; either may be left out."""
    if key is not None:
        records = records.where(F.col("api_key") == key)
    if since is not None:
        records = records.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        records = records.where(F.col("ts") <= F.lit(until).cast("timestamp"))
    return records


def _measures() -> list[Column]:
    return [
        F.count("*").alias("requests"),
        F.coalesce(F.sum(tokens()), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.sum(volume()), F.lit(0)).cast("long").alias("bytes"),
        F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 4).alias("avg_ms"),
        F.round(F.when(F.count("*") > 0, F.count_if(F.col("status").between(200, 299)) * 100.0 / F.count("*")).otherwise(100.0), 4).alias("success_rate"),
    ]


def stats(records: DataFrame) -> DataFrame:
    """One row of totals; without records the success rate is 100."""
    return records.agg(*_measures())


def by(records: DataFrame, *columns: str) -> DataFrame:
    return records.groupBy(*columns).agg(*_measures())


def top_endpoints(records: DataFrame, n: int = 5) -> DataFrame:
    return records.groupBy("endpoint").agg(F.count("*").alias("requests")).orderBy(F.col("requests").desc(), "endpoint").limit(n)


def daily(records: DataFrame) -> DataFrame:
    return by(records.withColumn("day", F.to_date("ts")), "day")


def of_user(records: DataFrame, keys: DataFrame, user: str | None = None) -> DataFrame:
    """Records of the keys (api_key, user_id) of one user, or with the user of each."""
    return records.join(keys if user is None else keys.where(F.col("user_id") == user), "api_key")


def quota_status(records: DataFrame, quotas: DataFrame, now: str) -> DataFrame:
    """For every key with use this month or with a quota: use since the start of day and month up to now against its quota (defaults where it
    has none; zeros where it has no use)."""
    at = F.lit(now).cast("timestamp")
    month = records.where((F.col("ts") >= F.date_trunc("month", at)) & (F.col("ts") <= at))
    today = F.col("ts") >= F.date_trunc("day", at)
    use = month.groupBy("api_key").agg(
        F.count_if(today).alias("daily_requests_used"),
        F.coalesce(F.sum(F.when(today, tokens())), F.lit(0)).cast("long").alias("daily_tokens_used"),
        F.count("*").alias("monthly_requests_used"),
        F.sum(tokens()).cast("long").alias("monthly_tokens_used"),
    )
    names = ("daily_requests", "daily_tokens", "monthly_requests", "monthly_tokens")
    joined = use.join(quotas, "api_key", "full").withColumns({f"{n}_used": F.coalesce(f"{n}_used", F.lit(0)).cast("long") for n in names})
    for n in names:
        limit = F.coalesce(F.col(n), F.lit(QUOTA[n]))
        joined = joined.withColumn(n, limit.cast("long"))
        joined = joined.withColumn(f"{n}_pct", F.round(F.when(F.col(n) > 0, F.col(f"{n}_used") * 100.0 / F.col(n)).otherwise(0.0), 4))
    over = F.lit(False)
    for n in names:
        over = over | (F.col(f"{n}_used") >= F.col(n))
    return joined.withColumn("alert_pct", F.coalesce("alert_pct", F.lit(QUOTA["alert_pct"]))).withColumn("exceeded", over)


def alert_candidates(records: DataFrame, quotas: DataFrame) -> DataFrame:
    """api_key, kind, pct, used, quota, ts: every record after which a day's or month's use stands at or above the alert threshold."""
    parts = []
    limits = records.join(quotas, "api_key", "left")
    for period in ("day", "month"):
        w = Window.partitionBy("api_key", F.date_trunc(period, "ts")).orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        for metric in ("requests", "tokens"):
            name = f"{'daily' if period == 'day' else 'monthly'}_{metric}"
            used = (F.count("*") if metric == "requests" else F.sum(tokens())).over(w)
            limit = F.coalesce(F.col(name), F.lit(QUOTA[name]))
            parts.append(limits.select("api_key", F.lit(name).alias("kind"), used.cast("long").alias("used"), limit.cast("long").alias("quota"), F.coalesce("alert_pct", F.lit(QUOTA["alert_pct"])).alias("alert_pct"), "ts"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    pct = F.when(F.col("quota") > 0, F.col("used") * 100.0 / F.col("quota")).otherwise(0.0)
    return out.withColumn("pct", F.round(pct, 4)).where(F.col("pct") >= F.col("alert_pct")).select("api_key", "kind", "pct", "used", "quota", "ts").distinct()


def cool_down(candidates: DataFrame, seconds: int = 3600) -> DataFrame:
    """Of each key and kind the alerts that come `seconds` or more after the last one that went out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "used"])
        last, keep = None, []
        for t in pdf["ts"]:
            keep.append(last is None or (t - last).total_seconds() >= seconds)
            last = t if keep[-1] else last
        return pdf[keep]

    return candidates.groupBy("api_key", "kind").applyInPandas(run, candidates.schema)


def retained(records: DataFrame, now: str, days: int) -> DataFrame:
    """Records of the last `days` days; the rest is what a clean-up deletes."""
    return records.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))


def recent_count(records: DataFrame, now: str, hours: int = 24) -> DataFrame:
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
    return records.agg(F.count("*").alias("total"), F.count_if(F.col("ts") > since).alias("recent"))


def sliding_counts(records: DataFrame, length: str = "300 seconds", step: str = "60 seconds") -> DataFrame:
    """Requests and errors in every sliding window."""
    w = F.window("ts", length, step)
    return records.groupBy(w.alias("w")).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors")).select(F.col("w.start").alias("start"), "requests", "errors")


def histogram(records: DataFrame, value: str, edges: list[float], *by_columns: str) -> DataFrame:
    """le, n: how many values are at or below each edge (null: all), cumulative."""
    marks = F.array(*(F.struct(F.lit(float(e)).alias("le"), (F.col(value) <= e).alias("in")) for e in edges), F.struct(F.lit(None).cast("double").alias("le"), F.lit(True).alias("in")))
    rows = records.select(*by_columns, F.explode(marks).alias("m"))
    return rows.groupBy(*by_columns, F.col("m.le").alias("le")).agg(F.count_if(F.col("m.in")).alias("n"))


def hit_rate(records: DataFrame, hit: Column) -> DataFrame:
    return records.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.round(F.when(F.count("*") > 0, F.count_if(hit) / F.count("*")).otherwise(0.0), 4).alias("hit_rate"))


def last_used(records: DataFrame, now: str) -> DataFrame:
    from ..functions.text import age

    seconds = F.timestamp_diff("SECOND", F.max("ts"), F.lit(now).cast("timestamp"))
    return records.groupBy("api_key").agg(age(seconds).alias("last_used"))


def recent(alerts: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Alerts of the last hours, the newest first."""
    at = F.lit(now).cast("timestamp")
    return alerts.where((F.col("ts") > at - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= at)).orderBy(F.col("ts").desc(), "api_key")
