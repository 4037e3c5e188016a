from __future__ import annotations

import datetime
import time

import pytest
from pyspark.sql import functions as F

from lumenkg.operators import logs
from lumenkg.plans.bridge import table
from lumenkg.plans.streams import _spans
from lumenkg.streaming import logs as S

SF = "/root/testdata/sf0.001"


def lines_stream(spark, tmp_path):
    own = table(spark, SF, "log_lines")
    own.write.parquet(f"file://{tmp_path}/lines")
    return own, spark.readStream.schema(own.schema).parquet(f"file://{tmp_path}/lines")


def finished(df, tmp_path, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table("out")


def test_level_counts(spark, tmp_path):
    own, stream = lines_stream(spark, tmp_path)
    got = finished(S.level_counts(stream), tmp_path, "complete")
    want = own.where(logs.level_rank(F.col("level")) >= 2).groupBy("level", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    assert sorted((r.level, str(r.hour), r.n) for r in got.collect()) == sorted((r.level, str(r.hour), r.n) for r in want.collect())


def as_text(df):
    return sorted((r.span, str(r.opened), str(r.closed), r.messages) for r in df.collect())


@pytest.mark.parametrize(("files", "order"), [(1, 1), (1, -1), (2, -1), (64, 1)])
def test_spans_for_any_files_and_order(spark, tmp_path, files, order):
    own = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").limit(400)
    for n in range(5):  # files are read in the order in which they were written
        k = n if order > 0 else 4 - n
        own.where(f"event_id % 5 = {k}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events.parquet")
        time.sleep(0.05)
    got = _spans(spark, f"file://{tmp_path}", files)
    assert got.count() > 10
    assert as_text(got) == as_text(logs.spans(table(spark, f"file://{tmp_path}", "log_lines")).where("closed is not null"))


def test_events_of_two_files_that_cross(spark, tmp_path):
    rows = lambda *xs: [(n, {"open": "signup", "close": "purchase"}.get(tag, "view"), 7, datetime.datetime(2024, 1, 1, 0, n), 1.0, "{}") for n, tag in xs]
    schema = "event_id long, event_type string, user_id long, ts timestamp_ntz, value double, props string"
    for part in (rows((2, "close"), (3, "open")), rows((1, "open"), (4, "close"))):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events.parquet")
        time.sleep(0.05)
    for files in (1, 64):
        assert [(r.opened.minute, r.closed.minute) for r in _spans(spark, f"file://{tmp_path}", files).orderBy("opened").collect()] == [(1, 2), (3, 4)]


def test_late_events_and_forgotten_spans(spark, tmp_path):
    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    schema = "event_id long, tag string, span long, ts timestamp_ntz"
    batches = [[(1, "open", 1, at(0)), (2, "open", 2, at(0)), (3, "open", 3, at(100))], [(4, "message", 1, at(5)), (5, "close", 1, at(130)), (6, "message", 3, at(95)), (7, "close", 3, at(120)), (8, "open", None, at(110))], [(9, "message", 9, at(600))], [(10, "message", 9, at(601))]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/lines")
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/lines")
    before = spark.conf.get(S.STATE_STORE[0])
    spark.conf.set(*S.STATE_STORE)
    try:
        # the message of minute 5 is later than 10 minutes; span 1 is open for over an hour
        got = finished(S.span_durations(stream, "10 minutes", datetime.timedelta(hours=1)), tmp_path, "append")
        assert [(r.span, r.closed - r.opened, r.messages) for r in got.collect()] == [(3, datetime.timedelta(minutes=20), 0)]
    finally:
        spark.conf.set(S.STATE_STORE[0], before)


def test_changes(spark, tmp_path):
    apply = S.file_changes(f"file://{tmp_path}/states", f"file://{tmp_path}/events")
    schema = "archive string, rel_path string, state int"
    apply(spark.createDataFrame([("a", "f", 1), ("a", "g", 3)], schema), 0)
    apply(spark.createDataFrame([("a", "f", 3)], schema), 1)
    got = spark.read.parquet(f"file://{tmp_path}/events")
    assert sorted((r.epoch, r.rel_path, r.event) for r in got.collect()) == [(0, "f", "created"), (0, "g", "created"), (1, "f", "changed")]
    assert spark.read.parquet(f"file://{tmp_path}/states/2").count() == 2
