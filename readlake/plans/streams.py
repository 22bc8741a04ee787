"""Rules over time as streaming queries over many micro-batches; each agrees with a batch query over the same rows.

The tables are played back as files that come one after the other, rows late and in mixed order.  Results go to
keyed stores (``operators.runs``) by the number of the batch, so that a batch that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.operators.runs import SortedRuns
from readlake.plans.ledger import ORACLES as BATCH
from readlake.plans.ledger import REFRESH_HOURS, STALE_DAYS, THROTTLE_SECONDS, TTL_HOURS
from readlake.sources.shared import discard, fresh_path
from readlake.sources.tables import jobs, table
from readlake.streaming.sources import part_stream, played_back, run_to_end
from readlake.streaming.timed import NOBODY, CacheAges, Throttle

DELAY_SECONDS = 3600  # how late a row may come; later ones are dropped
DAY_MICROS = 86_400_000_000
SESSION_MICROS = 3_600_000_000  # a pause that ends a burst
SHARDS = 32  # of a cache's namespace
BUCKETS = 256  # of users
NO_ID = -(2**63)


def store(spark: SparkSession, columns: dict[str, str], keys: list[str], merge: dict[str, Callable]) -> SortedRuns:
    """A keyed store of its own, with as many buckets as shuffles have partitions."""
    return SortedRuns(spark, fresh_path(spark, "store"), columns, keys, merge, int(spark.conf.get("spark.sql.shuffle.partitions")), "stream_store")


def events_of(spark: SparkSession, sf_dir: str, ahead: int | None = None) -> tuple[DataFrame, str]:
    """Events as a stream of many micro-batches under a watermark, and the folder that they come from."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    path = played_back(events, "ts", DELAY_SECONDS, "event_id", ahead)
    return part_stream(spark, path).withWatermark("ts", f"{DELAY_SECONDS} seconds"), path


def to_store(stream: DataFrame, mode: str, into: SortedRuns, shaped: Callable[[DataFrame], DataFrame] = lambda df: df) -> list[dict]:
    """Run a stream to its end; each batch is added under its number.  (Rows of the closing null row are left out.)"""
    first = into.keys[0]
    return run_to_end(stream, mode, lambda df, batch: into.add(shaped(df).where(F.col(first).isNotNull()).select(*into.schema), f"batch-{batch}"))


def finished(into: SortedRuns, path: str) -> DataFrame:
    """What the store holds, once the folder that its stream came from is deleted."""
    discard(into.spark, path)
    return into.read()


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type: changed counts only leave the stream, and a day's state ends with the watermark."""
    events, path = events_of(spark, sf_dir)
    counts = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    into = store(spark, {"event_type": "STRING", "day": "STRING", "n": "BIGINT"}, ["event_type", "day"], {"n": F.max})  # counts only grow
    to_store(counts, "update", into, lambda df: df.select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n"))
    return finished(into, path)


def throttled_stream(events: DataFrame) -> DataFrame:
    bucket = F.coalesce(F.when(F.col("user_id").isNotNull(), F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS))), F.lit(NOBODY)).alias("bucket")
    known = [F.coalesce(c, F.lit(NO_ID)).cast("long").alias(c) for c in ("user_id", "event_id")]  # arrays hold no nulls
    rows = events.select(bucket, *known, "ts", F.unix_micros("ts").alias("at"))
    passed = rows.groupBy("bucket").transformWithStateInPandas(Throttle(THROTTLE_SECONDS * 1_000_000), Throttle.OUTPUT, "Append", "EventTime")
    return passed.select("user_id", F.nullif("event_id", F.lit(NO_ID)).alias("event_id"))


def stream_read_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events let through by each user's throttle; the state is each user's last time that one was, and the rows that wait."""
    events, path = events_of(spark, sf_dir, ahead=DELAY_SECONDS + 1)
    into = store(spark, {"event_id": "BIGINT", "user_id": "BIGINT"}, ["event_id"], {"user_id": F.max})
    to_store(throttled_stream(events), "append", into)
    return finished(into, path)


def latest_saves(df: DataFrame) -> DataFrame:
    """A batch's latest position of each user and document."""
    saved = df.select("user_id", (F.col("event_id") % 5).alias("doc_id"), F.struct("ts", "event_id", F.least(F.lit(100.0), F.col("value")).alias("progress")).alias("latest"))
    return saved.groupBy("user_id", "doc_id").agg(F.max("latest").alias("latest"))


def stream_latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest position of each user and document: each batch's are merged into the store, and the stream holds no state."""
    events, path = events_of(spark, sf_dir)
    columns = {"user_id": "BIGINT", "doc_id": "BIGINT", "latest": "STRUCT<ts: TIMESTAMP, event_id: BIGINT, progress: DOUBLE>"}
    into = store(spark, columns, ["user_id", "doc_id"], {"latest": F.max})
    to_store(events, "append", into, latest_saves)
    return finished(into, path).select("user_id", "doc_id", "latest.event_id", "latest.progress")


def session_stream(events: DataFrame) -> DataFrame:
    last = F.max(F.struct("ts", "event_id", F.least(F.lit(100.0), F.col("value")).alias("progress"))).alias("l")
    # pauses are counted in whole seconds: the burst goes on until an hour from the event's second on; a session takes in what begins at its very end, so it ends a microsecond before
    left = F.lit(SESSION_MICROS - 1) - F.pmod(F.unix_micros("ts"), F.lit(1_000_000))
    gap = F.make_interval(secs=(left / 1_000_000).cast("decimal(18,6)"))
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(last).select("user_id", "l.event_id", "l.progress")


def stream_session_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last save of each burst of a user's, once, when the watermark has passed the burst's end."""
    events, path = events_of(spark, sf_dir, ahead=2 * DELAY_SECONDS + 3600)
    into = store(spark, {"user_id": "BIGINT", "event_id": "BIGINT", "progress": "DOUBLE"}, ["user_id", "event_id"], {"progress": F.max})
    to_store(session_stream(events), "append", into)
    return finished(into, path)


def cache_stream(events: DataFrame) -> DataFrame:
    shard = F.coalesce(F.pmod("user_id", F.lit(SHARDS)).cast("int"), F.lit(NOBODY)).alias("shard")
    rows = events.select("event_type", shard, "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("event_type", "shard").transformWithStateInPandas(CacheAges(TTL_HOURS * 3600, REFRESH_HOURS * 3600), CacheAges.OUTPUT, "Update", "EventTime")


def stream_cache_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by state as time goes on: live ones past REFRESH_HOURS are to be refreshed, and expired ones leave the state."""
    events, path = events_of(spark, sf_dir)
    columns = {"event_type": "STRING", "shard": "INT", "latest": "STRUCT<now_ms: BIGINT, live: BIGINT, stale: BIGINT, expired: BIGINT>"}
    into = store(spark, columns, ["event_type", "shard"], {"latest": F.max})
    to_store(cache_stream(events), "update", into, lambda df: df.groupBy("event_type", "shard").agg(F.max(F.struct("now_ms", "live", "stale", "expired")).alias("latest")))
    states = F.array(*[F.struct(F.lit(s).alias("state"), F.col(f"latest.{s}").alias("n")) for s in ("live", "stale", "expired")])
    rows = finished(into, path).select("event_type", F.explode(states).alias("s")).select("event_type", "s.state", "s.n")
    return rows.groupBy("event_type", "state").agg(F.sum("n").alias("n")).where("n > 0")


def job_stream(rows: DataFrame) -> DataFrame:
    """Jobs as kept when they come (step 0), and as failed or reaped (step 1) once the watermark has passed the last of the whole days that their status may idle.

    A job's wait is a session of its own that lasts as long, kept and closed by Spark's own state.
    """
    days = F.when(F.col("status").isin("running", "queued"), STALE_DAYS[0]).when(F.col("status") == "done", STALE_DAYS[1])
    due = (F.floor(F.unix_micros("ts") / DAY_MICROS) + days + 1) * DAY_MICROS
    gap = F.make_interval(secs=((due - F.unix_micros("ts")) / 1_000_000).cast("decimal(18,6)"))
    # by an expression of ts too: a filter on other columns alone would take the closing row away before it moves time on
    known = rows.where(F.when(F.col("ts").isNotNull(), F.col("job_id")).isNotNull())
    kept = known.select("job_id", F.lit(0).alias("step"), "status", F.lit("kept").alias("fate"))
    idle = known.groupBy(F.session_window("ts", gap), "job_id").agg(F.max_by("status", "ts").alias("status"))
    return kept.unionByName(idle.select("job_id", F.lit(1).alias("step"), "status", F.when(F.col("status") == "done", "reaped").otherwise("failed").alias("fate")))


def stream_stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that idled too long fail, finished ones are reaped, by the watermark alone, without input."""
    rows = jobs(spark, sf_dir).select("job_id", "status", F.col("updated_at").cast("timestamp").alias("ts"))
    path = played_back(rows, "ts", DELAY_SECONDS, "job_id")
    stream = part_stream(spark, path).withWatermark("ts", f"{DELAY_SECONDS} seconds")
    into = store(spark, {"job_id": "BIGINT", "fate": "STRUCT<step: INT, status: STRING, fate: STRING>"}, ["job_id"], {"fate": F.max})
    to_store(job_stream(stream), "append", into, lambda df: df.groupBy("job_id").agg(F.max(F.struct("step", "status", "fate")).alias("fate")))
    return finished(into, path).groupBy("fate.status", "fate.fate").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (stream_daily_counts, stream_read_throttle, stream_latest_progress, stream_session_last, stream_cache_state, stream_stale_jobs)}
ORACLES = {
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_read_throttle": BATCH["read_throttle"],
    "stream_latest_progress": "SELECT user_id, event_id % 5 AS doc_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(least(100.0, value), (ts, event_id)) AS progress FROM events GROUP BY ALL",
    "stream_session_last": BATCH["session_last"],
    "stream_cache_state": BATCH["cache_state"],
    "stream_stale_jobs": BATCH["stale_jobs"],
}
