"""Feed state: the stream equals the batch form across restarts, and timers fire without another check."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from rivulet.sources.buckets import write_bucketed
from rivulet.streaming import feed_state

SCHEMA = "feed_url string, status int, last_modified timestamp, fetched_at timestamp, seq long"
T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run_stream(spark, src, out, ckpt):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = (feed_state.track(stream, retries=2, delay_ms=4000, factor=2.0).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.select("feed_url", "at", "event", "failures", "next_at").collect())))


def test_steps_of_one_feed(spark):
    log = [("f", 200, at(-5), at(0), 1), ("f", 200, at(-1), at(10), 2), ("f", 304, None, at(11), 3), ("f", 500, None, at(12), 4), ("f", None, None, at(14), 5),
           ("f", 404, None, at(30), 6), ("f", 200, at(29), at(31), 7), ("f", 503, None, at(32), 8), ("g", 200, None, at(100), 9), (None, 200, at(0), at(1), 10)]
    got = [(r["feed_url"], r["event"], r["failures"], r["at"], r["next_at"]) for r in
           feed_state.transitions(spark.createDataFrame(log, SCHEMA), retries=2, delay_ms=4000).orderBy("feed_url", "at").collect()]
    assert got == [("f", "due", 0, at(0), None), ("f", "unchanged", 0, at(10), None), ("f", "unchanged", 0, at(11), None), ("f", "failed", 1, at(12), at(16)),
                   ("f", "failed", 2, at(14), at(22)), ("f", "retry", 2, at(22), None), ("f", "gave_up", 3, at(30), None), ("f", "due", 0, at(31), None),
                   ("f", "failed", 1, at(32), at(36)), ("f", "retry", 1, at(36), None), ("g", "unchanged", 0, at(100), None)]
    assert feed_state.transitions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_equals_batch_over_a_restart(spark, tmp_dir):
    rnd = random.Random(3)
    log, t = [], 0
    for i in range(150):
        t += rnd.choice([0, 1, 2, 5])
        feed = f"feed{rnd.randint(0, 5)}"
        log.append((feed, rnd.choice([200, 200, 304, 500, 503, None]), at(t - rnd.randint(0, 9)) if rnd.random() < 0.9 else None, at(t), i))
    log.append(("silent", 500, None, at(t + 1), 500))
    log.append(("last", 200, at(t + 1), at(t + 100), 501))
    src, out, ckpt = (os.path.join(tmp_dir, x) for x in ("log", "out", "ckpt"))
    parts = [log[:40], log[40:90], log[90:120], log[120:151], log[151:]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        if n in (1, 2, 4):                          # the second and third run go on from the checkpoint
            run_stream(spark, src, out, ckpt)
    want = rows_of(feed_state.transitions(spark.createDataFrame(log, SCHEMA), retries=2, delay_ms=4000))
    got = rows_of(spark.read.parquet(out))
    assert got == want
    assert any("'silent'" in r and "'retry'" in r for r in got)      # a timer of its own
    run_stream(spark, src, out, ckpt)                                # nothing new: nothing happens
    assert rows_of(spark.read.parquet(out)) == want


def test_bucketed_join_has_no_exchange(spark, tmp_dir):
    import __spark_entry__ as entry
    from conftest import SF_SMALL
    df = entry.queries()["entry_enrichment_bucketed"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    same = entry.queries()["entry_enrichment"](spark, SF_SMALL)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, same.collect()), key=str)
    t = write_bucketed(spark.range(10).select(F.col("id").alias("k")), "bucketed_rows", 3, ["k"], os.path.join(tmp_dir, "t"))
    assert t.count() == 10
    spark.sql("DROP TABLE bucketed_rows")
