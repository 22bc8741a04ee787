"""Streams of many micro-batches with late rows: state that ends, batches that are run again, and what each batch knows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from readlake.operators.runs import SortedRuns
from readlake.plans import ledger, streams
from readlake.sources import shared
from readlake.streaming.sources import file_stream, played_back, run_to_end
from tests.oracle import rows


def batch_of(spark, events):
    return spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, ts timestamp")


def at(hours: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def state_rows(progress: list[dict]) -> list[int]:
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]


def test_played_back_rows_come_late_and_in_parts(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = played_back(events, "ts", 3600, "event_id", parts=4)
    files = spark.read.parquet(path).select("*", F.input_file_name().alias("f"))
    assert files.where("event_id is not null").count() == events.count() and files.select("f").distinct().count() == 5
    spans = [(r["a"], r["b"]) for r in files.where("event_id is not null").groupBy("f").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("a").collect()]
    assert any(b[0] < a[1] for a, b in zip(spans, spans[1:], strict=False))  # they overlap in time


def test_a_batch_that_is_run_again_changes_nothing(spark, sf):
    events, _ = streams.events_of(spark, sf)
    columns = {"user_id": "BIGINT", "doc_id": "BIGINT", "latest": "STRUCT<ts: TIMESTAMP, event_id: BIGINT, progress: DOUBLE>"}
    into = streams.store(spark, columns, ["user_id", "doc_id"], {"latest": F.max})
    seen = []

    def twice(df, batch):
        shaped = streams.latest_saves(df).where("user_id is not null")
        into.add(shaped, f"batch-{batch}")
        kept = rows(into.read().toPandas())
        into.add(shaped, f"batch-{batch}")
        seen.append(rows(into.read().toPandas()) == kept)

    checkpoint = shared.fresh_path(spark, "kept-checkpoint")
    run_to_end(events, "append", twice, checkpoint)
    assert len(seen) >= 5 and all(seen)
    again = SortedRuns(spark, into.path, columns, into.keys, into.merge, 1, "again")  # opened anew, as after a restart
    assert rows(again.read().toPandas()) == rows(into.read().toPandas())
    assert run_to_end(events, "append", lambda df, batch: pytest.fail("no batch is left"), checkpoint) is not None


def test_state_of_idle_users_is_freed(spark, sf):
    events, _ = streams.events_of(spark, sf, ahead=streams.DELAY_SECONDS + 2 * ledger.THROTTLE_SECONDS)
    progress = run_to_end(streams.throttled_stream(events), "append", lambda df, batch: df.count())
    assert max(state_rows(progress)) > 0 and state_rows(progress)[-1] == 0
    events, _ = streams.events_of(spark, sf, ahead=2 * streams.DELAY_SECONDS + 3600)
    progress = run_to_end(streams.session_stream(events), "append", lambda df, batch: df.count())
    assert state_rows(progress)[-1] <= 1  # the closing row's own session
    assert max(state_rows(progress)) < spark.read.parquet(f"{sf}/events.parquet").count() / 3  # about a part at a time


def test_rows_that_come_too_late_are_dropped_and_counted(spark):
    first = [(1, 1, "view", 1.0, at(0)), (2, 1, "view", 2.0, at(5))]
    late = [(3, 1, "view", 3.0, at(0.5)), (4, 1, "view", 4.0, at(4.5))]  # 3 is 4.5 hours late, 4 half an hour
    between = [(5, 2, "view", 1.0, at(5.1))]  # a batch in which the watermark of the first one holds
    last = [(None, None, None, None, at(9))]
    path = shared.fresh_path(spark, "late")
    for part in (first, between, late, last):
        batch_of(spark, part).coalesce(1).write.mode("append").parquet(path)
    found = []
    events = file_stream(spark, path, 1).withWatermark("ts", "1 hour")
    progress = run_to_end(streams.throttled_stream(events), "append", lambda df, batch: found.extend(r["event_id"] for r in df.collect()))
    assert sorted(found) == [1, 2, 4, 5] and sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"]) == 1


def test_cache_states_at_each_time_equal_the_batch_report(spark, sf):
    events, path = streams.events_of(spark, sf)
    told = []
    run_to_end(streams.cache_stream(events), "update", lambda df, batch: told.extend(r.asDict() for r in df.collect()))
    entries = [(r["event_type"], r["user_id"] % streams.SHARDS, r["ts"]) for r in spark.read.parquet(path).where("event_id is not null").select("event_type", "user_id", F.unix_micros("ts").alias("ts")).collect()]
    assert len({r["now_ms"] for r in told}) > 3
    for r in told:
        ages = [r["now_ms"] // 1000 - t // 1_000_000 for kind, shard, t in entries if (kind, shard) == (r["event_type"], r["shard"]) and t // 1000 <= r["now_ms"]]
        expired = sum(a > ledger.TTL_HOURS * 3600 for a in ages)
        stale = sum(a > ledger.REFRESH_HOURS * 3600 for a in ages) - expired
        assert (r["live"], r["stale"], r["expired"]) == (len(ages) - stale - expired, stale, expired)


def test_timers_of_jobs_fire_without_input(spark):
    """All jobs come in the first batch; the closing row alone moves time on."""
    jobs = [(k, 7, status, at(k)) for k, status in enumerate(("queued", "running", "done", "queued"))]
    path = shared.fresh_path(spark, "jobs")
    schema = "job_id long, user_id long, status string, ts timestamp"
    spark.createDataFrame(jobs, schema).coalesce(1).write.parquet(path)
    spark.createDataFrame([(None, None, None, at(24 * 302))], schema).coalesce(1).write.mode("append").parquet(path)
    stream = file_stream(spark, path, 1).withWatermark("ts", "0 seconds").select("*", F.unix_micros("ts").alias("at"))
    told = []
    run_to_end(streams.job_stream(stream), "append", lambda df, batch: told.extend(map(tuple, df.collect())))
    assert sorted(told) == [(0, 0, "queued", "kept"), (0, 1, "queued", "failed"), (1, 0, "running", "kept"), (1, 1, "running", "failed"), (2, 0, "done", "kept"), (3, 0, "queued", "kept"), (3, 1, "queued", "failed")]


def test_a_cluster_must_name_its_shared_folder():
    class Settings:
        master = "spark://host:7077"

        def get(self, *_):
            return None

    class Session:
        conf = Settings()
        sparkContext = type("Context", (), {"master": Settings.master, "getConf": lambda self: Settings()})()

    with pytest.raises(ValueError, match="share"):
        shared.shared_dir(Session())


def test_empty_events_give_empty_results(spark, tmp_path):
    batch_of(spark, []).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("props", F.lit("")).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_daily_counts", "stream_read_throttle", "stream_latest_progress", "stream_session_last", "stream_cache_state"):
        assert streams.QUERIES[name](spark, str(tmp_path)).count() == 0
