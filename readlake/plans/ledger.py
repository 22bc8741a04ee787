"""Reports over the activity and usage ledger.  "Now" is the newest event, never the clock."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.operators.ordered import with_island_start, with_neighbour, with_running_sums, with_window_of
from readlake.params import FINISHED
from readlake.sources.tables import jobs, progress, table, usage, with_views

LATEST = 500  # events that a trend looks at (the feature's own limit)
TREND_DAYS = 14
RATE_HOURS, RATE_LIMIT = 24, 5
TTL_HOURS, REFRESH_HOURS = 6, 3
STALE_DAYS = (300, 1800)  # idle days after which a job fails, and after which a finished one is reaped
THROTTLE_SECONDS = 600
BURST_MS = 900


def now(df: DataFrame, col: str = "ts") -> DataFrame:
    """One row, one column: the newest time."""
    return df.agg(F.max(col).alias("now"))


def with_now(df: DataFrame, col: str = "ts") -> DataFrame:
    return df.crossJoin(F.broadcast(now(df, col)))  # a single row


def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest 40 events."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("rank", F.row_number().over(w)).where("rank <= 40").select("user_id", "rank", "event_id", "event_type", "ts")


def activity_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day over the last two weeks, days without any included, among the latest events only."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    latest = e.orderBy(F.desc("ts"), F.desc("event_id")).limit(LATEST)
    counts = latest.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = now(e).select(F.explode(F.sequence(F.date_sub(F.to_date("now"), TREND_DAYS - 1), F.to_date("now"))).alias("day"))
    return days.join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def history_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, days named relative to the newest."""
    day = with_now(table(spark, sf_dir, "events").select("ts", "event_type")).withColumn("day", F.to_date("ts"))
    age = F.datediff(F.to_date("now"), F.col("day"))
    label = F.when(age == 0, "Today").when(age == 1, "Yesterday").otherwise(F.col("day").cast("string"))
    return day.groupBy(F.col("day").cast("string").alias("day"), label.alias("label"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def history_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each history group; a group is a set of types."""
    groups = spark.createDataFrame([("imports", "purchase"), ("reading", "view"), ("reading", "click"), ("account", "signup"), ("problems", "error")], "grp string, event_type string")
    return table(spark, sf_dir, "events").join(F.broadcast(groups), "event_type").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by bot: outcomes, tokens and the mean latency of those that worked."""
    ok = F.col("status") == "ok"
    return usage(spark, sf_dir).groupBy("bot").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(ok).alias("ok_calls"),
        F.count_if(F.col("status") == "offline").alias("offline_calls"),
        F.sum("est_tokens").alias("tokens"),
        F.floor(F.avg(F.when(ok, F.col("latency_ms"))) + 0.5).alias("avg_latency_ms"),
    )


def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's successful calls on the newest day, against the daily limit."""
    u = with_now(usage(spark, sf_dir)).where((F.to_date("ts") == F.to_date("now")) & (F.col("status") == "ok"))
    used = u.groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))
    return used.select("user_id", "used", F.lit(120).alias("quota"), F.greatest(F.lit(0), 120 - F.col("used")).alias("remaining"), (F.col("used") >= 120).alias("exhausted"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("latest"))


def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that idled too long fail; finished ones are reaped later.  Ages are in days here."""
    j = with_now(jobs(spark, sf_dir), "updated_at")
    age = F.datediff("now", "updated_at")
    fate = F.when(F.col("status").isin("running", "queued") & (age > STALE_DAYS[0]), "failed").when((F.col("status") == "done") & (age > STALE_DAYS[1]), "reaped").otherwise("kept")
    return j.groupBy("status", fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))


def backlog_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued jobs of each user: high priority first, then first come; the first two are active."""
    w = W.partitionBy("user_id").orderBy(F.desc("priority"), "updated_at", "job_id")
    q = jobs(spark, sf_dir).where("status = 'queued'").withColumn("position", F.row_number().over(w))
    return q.select("user_id", "job_id", "priority", "position", (F.col("position") <= 2).alias("active"))


SPAN = 86_400_000_000  # microseconds of a history that one task orders


def _span(time: str = "ts"):
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / SPAN)


def finish_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves that pass the finishing line, the save before (stored to one decimal) being short of it."""
    p = with_neighbour(progress(spark, sf_dir), ["user_id", "doc_id"], ["ts", "event_id"], "progress", "before", _span())
    before = F.coalesce(F.floor(F.col("before") * 10 + 0.5) / 10, F.lit(0.0))
    return p.where((F.col("progress") >= FINISHED) & (before < FINISHED)).select("user_id", "doc_id", "event_id", "ts")


def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that exceed their user's limit within a sliding window."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec"))
    c = with_window_of(e, ["user_id"], "sec", RATE_HOURS * 3600, {"n": F.count(F.lit(1)), "oldest": F.min("sec")})
    return c.where(F.col("n") > RATE_LIMIT).select("event_id", "user_id", "n", (F.col("oldest") + RATE_HOURS * 3600 - F.col("sec")).alias("wait_sec"))


ETA_APART, ETA_SAMPLES = 43_200, 3  # seconds between samples at least (saves are sparse here); samples that a rate spans


def rolling_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds left by the rate over the last samples of a position, and words a minute since the first save.

    Samples are saves thinned as they come: each is ETA_APART or more after the sample before.  A save sees the last
    ETA_SAMPLES samples up to itself.  Without a rate (a sample alone, or none gained), the time since the first save
    stands in once 4 % are read.
    """
    keys, order = ["user_id", "doc_id"], ["ts", "event_id"]
    p = progress(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("k", F.concat_ws("/", *keys))
    kept = throttled(p.select("k", "event_id", "at"), "k", ETA_APART * 1_000_000).select("event_id", F.lit(1).alias("sample"))
    p = with_running_sums(p.join(kept, "event_id", "left"), keys, order, {"seen": F.coalesce("sample", F.lit(0))}, _span())
    samples = p.where("sample = 1").select(*keys, F.col("seen").alias("no"), F.col("progress").alias("then"), F.col("at").alias("since"))
    last = samples.select(*keys, F.col("no").alias("seen"), F.col("then").alias("now"), F.col("since").alias("until"))
    first = samples.select(*keys, F.col("no").alias("from_no"), "then", "since")
    start = p.groupBy(*keys).agg(F.min("at").alias("start"))
    p = p.withColumn("from_no", F.greatest(F.lit(1), F.col("seen") - (ETA_SAMPLES - 1))).join(last, [*keys, "seen"]).join(first, [*keys, "from_no"]).join(start, keys)
    took, gain, elapsed = (F.col("until") - F.col("since")) / 1e6, F.col("now") - F.col("then"), (F.col("at") - F.col("start")) / 1e6
    left = F.when((took > 0) & (gain > 0), (100 - F.col("progress")) / (gain / took)).when(F.col("progress") > 4, elapsed / (F.col("progress") / 100) * (1 - F.col("progress") / 100))
    pace = F.when((F.col("words") > 0) & (elapsed > 0.5), F.floor(F.col("words") / elapsed * 60 + 0.5))
    return p.withColumn("words", F.floor(F.col("progress") * 100)).select("event_id", *keys, F.when(left.isNotNull(), F.greatest(F.lit(1), F.floor(left + 0.5))).alias("eta_sec"), pace.alias("words_a_minute"))


def cache_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by state: live ones past REFRESH_HOURS are served and refreshed."""
    e = with_now(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"))
    age = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    state = F.when(age > TTL_HOURS * 3600, "expired").when(age > REFRESH_HOURS * 3600, "stale").otherwise("live")
    return e.groupBy("event_type", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and bytes by namespace."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("props")).alias("bytes"))


def quiz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and right ones by user: an answer's choice against the question's."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'").withColumn("right", F.col("event_id") % 4 == F.col("user_id") % 4)
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("answered"), F.count_if("right").alias("correct"), F.round(100.0 * F.count_if("right") / F.count(F.lit(1)), 3).alias("percent"))


def throttled(events: DataFrame, key: str = "user_id", limit: int = THROTTLE_SECONDS * 1_000_000) -> DataFrame:
    """(key, event_id) of events (key, event_id, at) that the throttle lets through: those ``limit`` or more after the last one let through.

    What it lets through depends on what it has let through before, but a row after a pause of ``limit``
    always goes through.  So runs without such a pause are dealt over tasks and read in order, row by row:
    a task holds one number, however long a run.
    """
    kind = dict(events.dtypes)[key]
    islands = with_island_start(events, key, "at", ["event_id"], limit, 144 * limit)
    runs = islands.repartition(key, "island").sortWithinPartitions(key, "island", "at", "event_id").select(key, "island", "at", "event_id")

    def passed(batches):
        run, last = None, None
        for batch in batches:
            keep = []
            for k, island, at in zip(*(batch.column(c).to_pylist() for c in (key, "island", "at")), strict=True):
                good = (k, island) != run or at - last >= limit
                if good:
                    run, last = (k, island), at
                keep.append(good)
            yield batch.select([key, "event_id"]).filter(pa.array(keep, pa.bool_()))

    return runs.mapInArrow(passed, f"{key} {kind}, event_id long")


def read_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at least THROTTLE_SECONDS after their user's last one that was let through."""
    return throttled(table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")))


def session_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last save of each burst; a burst ends with a pause (an hour here, as saves are sparse)."""
    p = progress(spark, sf_dir).withColumn("sec", F.unix_timestamp(F.col("ts").cast("timestamp")))
    p = with_neighbour(p, ["user_id"], ["ts", "event_id"], "sec", "next", _span(), ahead=True)
    return p.where(F.col("next").isNull() | (F.col("next") - F.col("sec") >= 3600)).select("user_id", "event_id", "progress")


_NOW = "(SELECT max(ts) AS now FROM events)"
QUERIES = {
    f.__name__: f
    for f in (
        recent_activity, activity_trend, history_by_day, history_filter, usage_summary, daily_quota, status_counts, stale_jobs, backlog_order, finish_events,
        rate_window, rolling_eta, cache_state, cache_stats, quiz_score, read_throttle, session_last,
    )
}
ORACLES = {
    "recent_activity": "SELECT user_id, rank, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 40",
    "activity_trend": f"""WITH latest AS (SELECT ts FROM events ORDER BY ts DESC, event_id DESC LIMIT {LATEST}),
days AS (SELECT unnest(generate_series(max(ts)::DATE - {TREND_DAYS - 1}, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events)
SELECT day::VARCHAR AS day, count(ts) AS n FROM days LEFT JOIN latest ON latest.ts::DATE = day GROUP BY day""",
    "history_by_day": f"""SELECT (ts::DATE)::VARCHAR AS day, CASE now::DATE - ts::DATE WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE (ts::DATE)::VARCHAR END AS label, event_type, count(*) AS n
FROM events, {_NOW} GROUP BY ALL""",
    "history_filter": """SELECT grp, count(*) AS n, max(ts) AS latest FROM events JOIN (VALUES ('imports','purchase'),('reading','view'),('reading','click'),('account','signup'),('problems','error')) AS g(grp, event_type)
USING (event_type) GROUP BY grp""",
    "usage_summary": with_views(
        """SELECT bot, count(*) AS calls, count(*) FILTER (status = 'ok') AS ok_calls, count(*) FILTER (status = 'offline') AS offline_calls, sum(est_tokens)::BIGINT AS tokens,
floor(avg(latency_ms) FILTER (status = 'ok') + 0.5)::BIGINT AS avg_latency_ms FROM usage GROUP BY bot"""
    ),
    "daily_quota": with_views(
        f"""SELECT user_id, count(*) AS used, 120 AS quota, greatest(0, 120 - count(*)) AS remaining, count(*) >= 120 AS exhausted FROM usage, {_NOW}
WHERE ts::DATE = now::DATE AND status = 'ok' GROUP BY user_id"""
    ),
    "status_counts": with_views("SELECT status, count(*) AS n, max(updated_at) AS latest FROM jobs GROUP BY status"),
    "stale_jobs": with_views(
        f"""SELECT status, CASE WHEN status IN ('running', 'queued') AND now::DATE - updated_at::DATE > {STALE_DAYS[0]} THEN 'failed' WHEN status = 'done' AND now::DATE - updated_at::DATE > {STALE_DAYS[1]} THEN 'reaped' ELSE 'kept' END AS fate,
count(*) AS n FROM jobs, (SELECT max(updated_at) AS now FROM jobs) GROUP BY ALL"""
    ),
    "backlog_order": with_views(
        """SELECT user_id, job_id, priority, position, position <= 2 AS active FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, updated_at, job_id) AS position FROM jobs WHERE status = 'queued')"""
    ),
    "finish_events": with_views(
        f"""SELECT user_id, doc_id, event_id, ts FROM (SELECT *, coalesce(lag(floor(progress * 10 + 0.5) / 10) OVER (PARTITION BY user_id, doc_id ORDER BY ts, event_id), 0) AS before FROM progress)
WHERE progress >= {FINISHED} AND before < {FINISHED}"""
    ),
    "rate_window": f"""SELECT event_id, user_id, n, oldest + {RATE_HOURS * 3600} - sec AS wait_sec FROM (
SELECT *, count(*) OVER w AS n, min(sec) OVER w AS oldest FROM (SELECT *, floor(epoch(ts))::BIGINT AS sec FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN {RATE_HOURS * 3600} PRECEDING AND CURRENT ROW)) WHERE n > {RATE_LIMIT}""",
    "rolling_eta": with_views(
        f"""WITH RECURSIVE o AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, doc_id ORDER BY ts, event_id) AS k, min(epoch_us(ts)) OVER (PARTITION BY user_id, doc_id) AS began FROM progress),
f AS (SELECT *, us AS last, true AS sample, [{{'t': us, 'p': progress}}] AS seen FROM o WHERE k = 1
  UNION ALL SELECT o.*, CASE WHEN o.us - f.last >= {ETA_APART * 1_000_000} THEN o.us ELSE f.last END, o.us - f.last >= {ETA_APART * 1_000_000},
    CASE WHEN o.us - f.last >= {ETA_APART * 1_000_000} THEN list_append(f.seen, {{'t': o.us, 'p': o.progress}})[-{ETA_SAMPLES}:] ELSE f.seen END
  FROM f JOIN o ON o.user_id = f.user_id AND o.doc_id = f.doc_id AND o.k = f.k + 1),
r AS (SELECT *, (seen[-1].t - seen[1].t) / 1e6 AS took, seen[-1].p - seen[1].p AS gain, (us - began) / 1e6 AS elapsed, floor(progress * 100)::BIGINT AS words FROM f),
e AS (SELECT *, CASE WHEN took > 0 AND gain > 0 THEN (100 - progress) / (gain / took) WHEN progress > 4 THEN elapsed / (progress / 100) * (1 - progress / 100) END AS eta FROM r)
SELECT event_id, user_id, doc_id, CASE WHEN eta IS NOT NULL THEN greatest(1, floor(eta + 0.5)::BIGINT) END AS eta_sec, CASE WHEN words > 0 AND elapsed > 0.5 THEN floor(words / elapsed * 60 + 0.5)::BIGINT END AS words_a_minute FROM e"""
    ),
    "cache_state": f"""SELECT event_type, CASE WHEN age > {TTL_HOURS * 3600} THEN 'expired' WHEN age > {REFRESH_HOURS * 3600} THEN 'stale' ELSE 'live' END AS state, count(*) AS n
FROM (SELECT event_type, floor(epoch(now))::BIGINT - floor(epoch(ts))::BIGINT AS age FROM events, {_NOW}) GROUP BY ALL""",
    "cache_stats": "SELECT event_type, count(*) AS entries, sum(octet_length(encode(props)))::BIGINT AS bytes FROM events GROUP BY event_type",
    "quiz_score": """SELECT user_id, count(*) AS answered, count(*) FILTER (event_id % 4 = user_id % 4) AS correct, round(100.0 * count(*) FILTER (event_id % 4 = user_id % 4) / count(*), 3) AS percent
FROM events WHERE event_type = 'click' GROUP BY user_id""",
    "read_throttle": f"""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, us AS last, k, true AS emitted FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.event_id, CASE WHEN o.us - f.last >= {THROTTLE_SECONDS} * 1000000 THEN o.us ELSE f.last END, o.k, o.us - f.last >= {THROTTLE_SECONDS} * 1000000
  FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, event_id FROM f WHERE emitted""",
    "session_last": with_views(
        """SELECT user_id, event_id, progress FROM (SELECT *, floor(epoch(ts)) AS sec, lead(floor(epoch(ts))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM progress) WHERE next IS NULL OR next - sec >= 3600"""
    ),
}
