"""SS: the batch results that the streaming forms have to reach; tests run both."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.sources.views import RUNS, runs, table
from tidewell.streaming import status as T
from tidewell.streaming import windows as S

c = F.col


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))


@query("ss03_rate_limit", "SELECT user_id, date_trunc('hour', ts) AS time, count(*) AS n, count(*) - 1 AS refused FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def ss03(spark, d):
    return S.over_limit(_events(spark, d), "1 hour", 1).withColumn("time", c("time").cast("timestamp_ntz"))


@query("ss03_sliding_limit", "SELECT event_id, (SELECT count(*) FROM events x WHERE x.user_id = e.user_id AND x.ts <= e.ts AND x.ts > e.ts - INTERVAL 3600 SECOND) > 2 AS refused FROM events e")
def ss03b(spark, d):
    """Events beyond two of their user within the hour before them."""
    micros = F.unix_micros("ts")
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000 + 1, 0)
    return _events(spark, d).withColumn("us", micros).select("event_id", (F.count("*").over(w) > 2).alias("refused"))


@query("ss04_daily_counters", "SELECT user_id, strftime(ts + INTERVAL 9 HOUR, '%Y%m%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def ss04(spark, d):
    return S.daily_counts(_events(spark, d))


@query("ss06_windowed_bars", "WITH b AS (SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01') AS time, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM b WHERE n >= 2")
def ss06(spark, d):
    return S.bars(_events(spark, d), complete=2).withColumn("time", c("time").cast("timestamp_ntz"))


@query("ss07_session_windows", "WITH g AS (SELECT user_id, ts, event_id, coalesce((ts - lag(ts) OVER w >= INTERVAL 1 HOUR)::INT, 1) AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k")
def ss07(spark, d):
    return S.sessions(_events(spark, d)).withColumns({x: c(x).cast("timestamp_ntz") for x in ("first_ts", "last_ts")})


@query("ss08_expired_runs", f"WITH {RUNS} SELECT run_id, CASE WHEN status = 'running' AND started < TIMESTAMP '2001-01-01' - INTERVAL 60 SECOND THEN 'failed' ELSE status END AS status FROM runs")
def ss08(spark, d):
    old = (c("status") == "running") & F.expr("started < timestamp_ntz '2001-01-01' - interval 60 seconds")
    return runs(spark, d).select("run_id", F.when(old, "failed").otherwise(c("status")).alias("status"))


@query("ss08_ended_runs", """WITH e AS (SELECT user_id::VARCHAR || '-' || strftime(ts, '%Y%m%d') AS run_id, ts, event_type AS status FROM events),
g AS (SELECT run_id, min(ts) AS created, min(ts) FILTER (WHERE status IN ('purchase', 'error')) AS ended, arg_min(status, row(ts, status)) FILTER (WHERE status IN ('purchase', 'error')) AS word FROM e GROUP BY 1)
SELECT run_id, CASE WHEN ended < created + INTERVAL 6 HOUR THEN word ELSE 'failed' END AS status, CASE WHEN ended < created + INTERVAL 6 HOUR THEN NULL ELSE 'stale' END AS error, created,
CASE WHEN ended < created + INTERVAL 6 HOUR THEN ended ELSE created + INTERVAL 6 HOUR END AS finished FROM g WHERE created + INTERVAL 6 HOUR <= (SELECT max(ts) FROM e)""")
def ss08b(spark, d):
    """A user's day as a run that a purchase or an error ends within six hours."""
    run = F.concat(c("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    out = T.ended_runs(_events(spark, d).select(run.alias("run_id"), "ts", c("event_type").alias("status")), ("purchase", "error"), 6 * 3600)
    return out.withColumns({x: c(x).cast("timestamp_ntz") for x in ("created", "finished")})
