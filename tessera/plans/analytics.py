"""Catalogue: usage, quotas, alerts, learner and streams over events."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learner, usage
from ..streaming import usage as stream
from .catalog import query, table

NOW = "2024-01-20 12:00:00"
_COLUMNS = {
    "api_key": "CAST(user_id AS {s})",
    "endpoint": "event_type",
    "request_tokens": "event_id % 500",
    "response_tokens": "event_id % 900",
    "request_bytes": "event_id % 2000",
    "response_bytes": "event_id % 7000",
    "duration_ms": "value",
    "status": "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END",
    "ts": "ts",
}
_U = "(SELECT " + ", ".join(f"{e.format(s='VARCHAR')} AS {n}" for n, e in _COLUMNS.items()) + ", event_id FROM events)"


def records(events: DataFrame) -> DataFrame:
    return events.selectExpr(*(f"{e.format(s='STRING')} AS {n}" for n, e in _COLUMNS.items()), "event_id")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(table(spark, sf_dir, "events"))


_M = """count(*) AS requests, CAST(coalesce(sum(request_tokens + response_tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(request_bytes + response_bytes), 0) AS BIGINT) AS bytes,
round(coalesce(avg(duration_ms), 0), 4) AS avg_ms, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (status BETWEEN 200 AND 299) * CAST(100 AS DOUBLE) / count(*) ELSE 100 END, 4) AS success_rate"""


@query(f"SELECT {_M} FROM {_U}")
def usage_stats(spark, sf_dir):
    return usage.stats(_records(spark, sf_dir))


@query(f"SELECT {_M} FROM {_U} WHERE api_key = '3' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-15'")
def usage_stats_filtered(spark, sf_dir):
    return usage.stats(usage.between(_records(spark, sf_dir), "3", "2024-01-05", "2024-01-15"))


@query(f"SELECT CAST(ts AS DATE) AS day, {_M} FROM {_U} GROUP BY 1")
def usage_trend_daily(spark, sf_dir):
    return usage.daily(_records(spark, sf_dir))


@query(f"SELECT endpoint, count(*) AS requests FROM {_U} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_endpoints(spark, sf_dir):
    return usage.top_endpoints(_records(spark, sf_dir))


@query(f"SELECT endpoint, {_M} FROM {_U} GROUP BY 1")
def usage_by_endpoint(spark, sf_dir):
    return usage.by(_records(spark, sf_dir), "endpoint")


def _keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("api_key"), F.col("c_mktsegment").alias("user_id"))


@query(f"SELECT api_key, user_id, {_M} FROM {_U} JOIN (SELECT CAST(c_custkey AS VARCHAR) AS api_key, c_mktsegment AS user_id FROM customer) USING (api_key) GROUP BY ALL")
def usage_by_key(spark, sf_dir):
    return usage.by(usage.of_user(_records(spark, sf_dir), _keys(spark, sf_dir)), "api_key", "user_id")


@query(f"SELECT endpoint, {_M} FROM {_U} JOIN (SELECT CAST(c_custkey AS VARCHAR) AS api_key FROM customer WHERE c_mktsegment = 'BUILDING') USING (api_key) GROUP BY 1")
def usage_of_user(spark, sf_dir):
    return usage.by(usage.of_user(_records(spark, sf_dir), _keys(spark, sf_dir), "BUILDING"), "endpoint")


def _quotas(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr("CAST(c_custkey AS STRING) AS api_key", "CAST(2 AS LONG) AS daily_requests", "CAST(c_custkey * 100 AS LONG) AS daily_tokens", "CAST(NULL AS LONG) AS monthly_requests", "CAST(50000 AS LONG) AS monthly_tokens", "CAST(50 AS DOUBLE) AS alert_pct")


_QUOTAS = "(SELECT CAST(c_custkey AS VARCHAR) AS api_key, 2 AS daily_requests, c_custkey * 100 AS daily_tokens, NULL AS monthly_requests, 50000 AS monthly_tokens, CAST(50 AS DOUBLE) AS alert_pct FROM customer WHERE c_custkey % 2 = 0)"
_NAMES = ("daily_requests", "daily_tokens", "monthly_requests", "monthly_tokens")
_LIMITS = ", ".join(f"CAST(coalesce({n}, {usage.QUOTA[n]}) AS BIGINT) AS {n}" for n in _NAMES)
_PCTS = ", ".join(f"round(CASE WHEN {n} > 0 THEN {n}_used * CAST(100 AS DOUBLE) / {n} ELSE 0 END, 4) AS {n}_pct" for n in _NAMES)


@query(f"""WITH u AS (SELECT api_key, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS daily_requests_used, CAST(coalesce(sum(request_tokens + response_tokens) FILTER (ts >= TIMESTAMP '2024-01-20'), 0) AS BIGINT) AS daily_tokens_used,
count(*) AS monthly_requests_used, CAST(sum(request_tokens + response_tokens) AS BIGINT) AS monthly_tokens_used FROM {_U} WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '{NOW}' GROUP BY 1),
j AS (SELECT api_key, {", ".join(f"coalesce({n}_used, 0) AS {n}_used" for n in _NAMES)}, {_LIMITS}, coalesce(alert_pct, 80) AS alert_pct FROM u FULL JOIN {_QUOTAS} USING (api_key))
SELECT *, {_PCTS}, {" OR ".join(f"{n}_used >= {n}" for n in _NAMES)} AS exceeded FROM j""")
def quota_status(spark, sf_dir):
    return usage.quota_status(_records(spark, sf_dir), _quotas(spark, sf_dir), NOW)


@query(f"""SELECT count(*) AS requests, CAST(sum(request_tokens + response_tokens) AS BIGINT) AS tokens, round(count(*) * CAST(100 AS DOUBLE) / 300000, 4) AS pct FROM {_U} WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '{NOW}'""")
def quota_global(spark, sf_dir):
    month = usage.between(_records(spark, sf_dir), since="2024-01-01", until=NOW)
    return month.agg(F.count("*").alias("requests"), F.sum(usage.tokens()).cast("long").alias("tokens"), F.round(F.count("*") * 100.0 / usage.QUOTA["monthly_requests"], 4).alias("pct"))


def _parts() -> str:
    out = []
    for period, word in (("day", "daily"), ("month", "monthly")):
        for metric, used in (("requests", "count(*)"), ("tokens", "sum(request_tokens + response_tokens)")):
            n = f"{word}_{metric}"
            out.append(f"SELECT api_key, '{n}' AS kind, CAST({used} OVER (PARTITION BY api_key, date_trunc('{period}', ts) ORDER BY ts RANGE UNBOUNDED PRECEDING) AS BIGINT) AS used, CAST(coalesce({n}, {usage.QUOTA[n]}) AS BIGINT) AS quota, coalesce(alert_pct, 80) AS alert_pct, ts FROM r")
    return " UNION ALL ".join(out)


@query(f"WITH r AS (SELECT * FROM {_U} LEFT JOIN {_QUOTAS} USING (api_key)), a AS ({_parts()}), p AS (SELECT *, round(CASE WHEN quota > 0 THEN used * CAST(100 AS DOUBLE) / quota ELSE 0 END, 4) AS pct FROM a) SELECT DISTINCT api_key, kind, pct, used, quota, ts FROM p WHERE pct >= alert_pct")
def alert_candidates(spark, sf_dir):
    return usage.alert_candidates(_records(spark, sf_dir), _quotas(spark, sf_dir))


_ERRORS = f"(SELECT DISTINCT api_key, ts FROM {_U} WHERE status = 500)"


@query(f"""WITH RECURSIVE e AS (SELECT api_key, ts, row_number() OVER (PARTITION BY api_key ORDER BY ts) AS n FROM {_ERRORS}),
f AS (SELECT api_key, n, ts, ts AS last, true AS sent FROM e WHERE n = 1
UNION ALL SELECT e.api_key, e.n, e.ts, CASE WHEN e.ts >= f.last + INTERVAL 3 DAY THEN e.ts ELSE f.last END, e.ts >= f.last + INTERVAL 3 DAY FROM f JOIN e ON e.api_key = f.api_key AND e.n = f.n + 1)
SELECT api_key, ts FROM f WHERE sent""")
def usage_alerts(spark, sf_dir):
    errors = _records(spark, sf_dir).where("status = 500").select("api_key", F.lit("error").alias("kind"), "ts", F.lit(1).alias("used")).distinct()
    return usage.cool_down(errors, 3 * 86400).select("api_key", "ts")


@query(f"SELECT event_id FROM {_U} WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def retention_cleanup(spark, sf_dir):
    return usage.retained(_records(spark, sf_dir), NOW, 7).select("event_id")


@query(f"SELECT count(*) AS total, count(*) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS recent FROM {_U}")
def recent_24h(spark, sf_dir):
    return usage.recent_count(_records(spark, sf_dir), NOW)


@query("SELECT label AS store, count(*) AS vectors FROM embeddings GROUP BY 1")
def vectors_per_store(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("store")).agg(F.count("*").alias("vectors"))


_SLIDING = f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * i AS start, status FROM {_U}, range(6) AS r(i)) SELECT start, count(*) AS requests, count(*) FILTER (status >= 400) AS errors FROM w GROUP BY 1"""


@query(_SLIDING)
def sliding_counts(spark, sf_dir):
    return usage.sliding_counts(_records(spark, sf_dir), "6 hours", "1 hour")


_EDGES = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


@query(f"SELECT endpoint, e AS le, count(*) FILTER (e IS NULL OR duration_ms <= e) AS n FROM {_U}, (VALUES {', '.join(f'(CAST({e} AS DOUBLE))' for e in _EDGES)}, (NULL)) AS x(e) GROUP BY ALL")
def latency_histogram(spark, sf_dir):
    return usage.histogram(_records(spark, sf_dir), "duration_ms", _EDGES, "endpoint")


@query(f"SELECT count(*) FILTER (endpoint = 'view') AS hits, count(*) FILTER (endpoint <> 'view') AS misses, round(CAST(count(*) FILTER (endpoint = 'view') AS DOUBLE) / count(*), 4) AS hit_rate FROM {_U}")
def hit_rate(spark, sf_dir):
    return usage.hit_rate(_records(spark, sf_dir), F.col("endpoint") == "view")


@query(f"""WITH s AS (SELECT api_key, epoch(TIMESTAMP '2024-02-02')::BIGINT - floor(epoch(max(ts)))::BIGINT AS s FROM {_U} GROUP BY 1)
SELECT api_key, CASE WHEN s < 3600 THEN 'Just now' WHEN s < 86400 THEN concat(s // 3600, 'h ago') ELSE concat(s // 86400, 'd ago') END AS last_used FROM s""")
def last_used(spark, sf_dir):
    return usage.last_used(_records(spark, sf_dir), "2024-02-02")


_H = "(SELECT event_type AS mode0, CAST(user_id % 5 AS VARCHAR) AS store, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'semantic' ELSE 'hybrid' END AS mode, (event_id * 37 % 101) / CAST(100 AS DOUBLE) AS confidence FROM events)"


def _history(spark, sf_dir):
    mode = F.when(F.col("event_id") % 3 == 0, "keyword").when(F.col("event_id") % 3 == 1, "semantic").otherwise("hybrid")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("string").alias("store"), F.col("event_id").alias("seq"), mode.alias("mode"), ((F.col("event_id") * 37 % 101) / 100.0).alias("confidence"))


_NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY store ORDER BY seq DESC) AS n FROM {_H})"


@query(f"SELECT store, mode, round(avg(confidence), 6) AS avg_confidence, count(*) AS n FROM {_NUMBERED} WHERE n <= 100 GROUP BY ALL")
def learner_modes(spark, sf_dir):
    return learner.mode_averages(_history(spark, sf_dir))


@query(f"""WITH a AS (SELECT store, count(*) AS n, coalesce(avg(confidence) FILTER (mode = 'semantic'), avg(confidence) FILTER (mode = 'hybrid'), 0.5) AS v, coalesce(avg(confidence) FILTER (mode = 'keyword'), 0.5) AS k FROM {_NUMBERED} WHERE n <= 100 GROUP BY 1)
SELECT store, CAST(CASE WHEN n < 10 THEN 0.5 ELSE round(0.7 * 0.5 + 0.3 * CASE WHEN v > k + 0.05 THEN 0.6 WHEN k > v + 0.05 THEN 0.4 ELSE 0.5 END, 3) END AS DOUBLE) AS alpha FROM a""")
def learner_alpha(spark, sf_dir):
    return learner.recommended_alpha(_history(spark, sf_dir))


@query(f"""WITH RECURSIVE g AS (SELECT store, step, coalesce(avg(confidence) FILTER (mode = 'semantic'), avg(confidence) FILTER (mode = 'hybrid')) AS v, avg(confidence) FILTER (mode = 'keyword') AS k
  FROM (SELECT *, (row_number() OVER (PARTITION BY store ORDER BY seq) - 1) // 20 AS step FROM {_H}) GROUP BY store, step HAVING count(*) = 20),
r AS (SELECT DISTINCT store, CAST(-1 AS BIGINT) AS step, CAST(0.5 AS DOUBLE) AS alpha FROM g
  UNION ALL SELECT r.store, r.step + 1, round(CAST(0.7 AS DOUBLE) * alpha + (1 - CAST(0.7 AS DOUBLE)) * CASE WHEN coalesce(v, alpha) > coalesce(k, alpha) + CAST(0.05 AS DOUBLE) THEN least(CAST(0.8 AS DOUBLE), alpha + CAST(0.1 AS DOUBLE)) WHEN coalesce(k, alpha) > coalesce(v, alpha) + CAST(0.05 AS DOUBLE) THEN greatest(CAST(0.2 AS DOUBLE), alpha - CAST(0.1 AS DOUBLE)) ELSE alpha END, 3)
  FROM r JOIN g ON g.store = r.store AND g.step = r.step + 1)
SELECT store, arg_max(alpha, step) AS alpha FROM r GROUP BY store""")
def learner_alpha_path(spark, sf_dir):
    return learner.alpha_path(_history(spark, sf_dir), 20)


@query(f"""SELECT store, count(*) AS total, round(avg(confidence), 3) AS avg_confidence, CASE WHEN count(*) < 20 THEN 'insufficient_data' WHEN avg(confidence) FILTER (n <= 10) > avg(confidence) FILTER (n BETWEEN 11 AND 20) + 0.05 THEN 'improving'
WHEN avg(confidence) FILTER (n <= 10) < avg(confidence) FILTER (n BETWEEN 11 AND 20) - 0.05 THEN 'declining' ELSE 'stable' END AS trend FROM {_NUMBERED} GROUP BY 1""")
def learner_summary(spark, sf_dir):
    return learner.summary(_history(spark, sf_dir))


@query(f"""SELECT 'stores' AS metric, CAST(count(DISTINCT source) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'documents', CAST(count(*) AS DOUBLE) FROM documents UNION ALL SELECT 'vectors', CAST(count(*) AS DOUBLE) FROM embeddings
UNION ALL SELECT 'hit_rate', round(CAST(count(*) FILTER (endpoint = 'view') AS DOUBLE) / count(*), 4) FROM {_U}""")
def metrics(spark, sf_dir):
    docs, rates = table(spark, sf_dir, "documents"), usage.hit_rate(_records(spark, sf_dir), F.col("endpoint") == "view")
    rows = docs.agg(F.countDistinct("source").cast("double").alias("stores"), F.count("*").cast("double").alias("documents"))
    rows = rows.crossJoin(table(spark, sf_dir, "embeddings").agg(F.count("*").cast("double").alias("vectors"))).crossJoin(rates.select("hit_rate"))
    return rows.unpivot([], rows.columns, "metric", "value")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of one file (a folder where there are several)."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    found = source.parquet(path) if os.path.isdir(path) else source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return records(found).withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need times with a zone


@query(f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, api_key, count(*) AS requests, CAST(sum(request_tokens + response_tokens) AS BIGINT) AS tokens FROM {_U} GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return stream.drained(spark, _stream(spark, sf_dir), stream.tumbling)


@query(_SLIDING)
def stream_sliding(spark, sf_dir):
    return stream.drained(spark, _stream(spark, sf_dir), lambda df: stream.sliding(df, "6 hours", "1 hour"))


@query(f"SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, api_key, count(*) AS requests FROM {_U} GROUP BY ALL")
def stream_monthly(spark, sf_dir):
    return stream.drained(spark, _stream(spark, sf_dir), stream.monthly)


@query(f"SELECT DISTINCT api_key, endpoint FROM {_U}")
def stream_dedup(spark, sf_dir):
    return stream.drained(spark, _stream(spark, sf_dir), lambda df: stream.deduplicated(df, ["api_key", "endpoint"], "60 days").select("api_key", "endpoint"), "append")


@query(f"""WITH RECURSIVE e AS (SELECT api_key, ts, row_number() OVER (PARTITION BY api_key ORDER BY ts) AS n FROM {_ERRORS}),
f AS (SELECT api_key, n, ts, ts AS last, true AS sent FROM e WHERE n = 1
UNION ALL SELECT e.api_key, e.n, e.ts, CASE WHEN e.ts >= f.last + INTERVAL 3 DAY THEN e.ts ELSE f.last END, e.ts >= f.last + INTERVAL 3 DAY FROM f JOIN e ON e.api_key = f.api_key AND e.n = f.n + 1)
SELECT api_key, ts FROM f WHERE sent""")
def stream_alerts(spark, sf_dir):
    def plan(df):
        return stream.cooled_alerts(df.where("status = 500").select("api_key", F.lit("error").alias("kind"), "ts", F.lit(100.0).alias("pct")), 3 * 86400)

    return stream.drained(spark, _stream(spark, sf_dir), plan, "append").select("api_key", F.col("ts").cast("timestamp").alias("ts"))


@query()
def approx_distinct_users(spark, sf_dir):
    """Extension: users by endpoint from a sketch."""
    return _records(spark, sf_dir).groupBy("endpoint").agg(F.approx_count_distinct("api_key").alias("users"))


@query()
def latency_percentiles(spark, sf_dir):
    """Extension: latency quantiles by endpoint from a sketch."""
    return _records(spark, sf_dir).groupBy("endpoint").agg(F.percentile_approx("duration_ms", [0.5, 0.95, 0.99], 10000).alias("ms"))


@query("SELECT CAST(user_id AS VARCHAR) AS api_key, ts FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '2024-01-20 12:00:00' ORDER BY ts DESC")
def recent_alerts(spark, sf_dir):
    alerts = _records(spark, sf_dir).where("status = 500").select("api_key", "ts")
    return usage.recent(alerts, NOW, 48)
