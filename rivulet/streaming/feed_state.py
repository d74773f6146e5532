"""Feed state as a stream (T1, T2, T5, U5): one state per feed, timers in Spark's state store.

Every check of a feed (a fetch-log row) moves the feed's state and gives one row:

* ``due``: status 200 and modified after the feed's last good check;
* ``unchanged``: any other good check (2xx, 304);
* ``failed``: an error, with the time of the next attempt (``next_at``), which
  grows by ``factor`` with every error in a row;
* ``gave_up``: an error after ``retries`` attempts in a row;

and, when the time of the next attempt comes before another check does, a
``retry`` row.  In the stream that is an event-time timer: it fires when the
watermark passes, also for a feed that is never heard of again.

``track`` is the stateful operator: its state (last good check, errors in a
row, next attempt) lives in the state store and survives a restart; a replayed
micro-batch gives the same rows.  ``transitions`` is the same over a finished
log, by windows.  The rows of one feed are ordered by (``fetched_at``, ``seq``).

Defined cases: a NULL status is an error; NULL ``last_modified`` is never due;
rows without a feed or a time are left out; rows that come later than the
watermark allows are left out by Spark (``delay``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RETRIES = 3
DELAY_MS = 1000
FACTOR = 2.0

COLUMNS = ("feed_url", "status", "last_modified", "fetched_at", "seq")
OUT = "feed_url string, at timestamp, event string, failures int, next_at timestamp"
STATE = "good_us long, failures int, next_us long"


def _good(status: Column) -> Column:
    return F.coalesce(status.between(200, 299) | (status == 304), F.lit(False))


def transitions(log: DataFrame, retries: int = RETRIES, delay_ms: int = DELAY_MS, factor: float = FACTOR) -> DataFrame:
    """(feed_url, at, event, failures, next_at) of a finished log; attempts later than its last row are still to come."""
    rows = log.select(*COLUMNS).where("feed_url is not null and fetched_at is not null")
    order = Window.partitionBy("feed_url").orderBy("fetched_at", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    good = _good(F.col("status"))
    rows = rows.select("*", good.alias("good"), F.sum(good.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
                       F.max(F.when(good, F.col("fetched_at"))).over(before).alias("good_at"), F.lead("fetched_at").over(order).alias("then"))
    in_run = Window.partitionBy("feed_url", "run").orderBy("fetched_at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("failures", F.sum((~F.col("good")).cast("int")).over(in_run).cast("int"))
    wait = F.lit(delay_ms * 1000) * F.pow(F.lit(float(factor)), F.col("failures") - 1)
    next_at = F.when(~F.col("good") & (F.col("failures") <= retries), F.timestamp_micros(F.unix_micros("fetched_at") + F.floor(wait)))
    due = (F.col("status") == 200) & (F.col("last_modified") > F.coalesce("good_at", F.lit(0).cast("timestamp")))
    event = (F.when(F.col("good"), F.when(F.coalesce(due, F.lit(False)), "due").otherwise("unchanged"))
             .otherwise(F.when(F.col("failures") <= retries, "failed").otherwise("gave_up")))
    rows = rows.select("feed_url", F.col("fetched_at").alias("at"), event.alias("event"), "failures", next_at.alias("next_at"), "then")
    last = rows.agg(F.max("at").alias("last"))     # one row
    waited = (rows.where("next_at is not null").crossJoin(F.broadcast(last)).where(F.coalesce("then", "last") > F.col("next_at"))
              .select("feed_url", F.col("next_at").alias("at"), F.lit("retry").alias("event"), "failures", F.lit(None).cast("timestamp").alias("next_at")))
    return rows.drop("then").unionByName(waited)


def track(stream: DataFrame, retries: int = RETRIES, delay_ms: int = DELAY_MS, factor: float = FACTOR, delay: str = "0 seconds") -> DataFrame:
    """The same rows from a stream of checks, in append mode."""

    def micros(t) -> int | None:
        return None if pd.isna(t) else t.value // 1000

    def stamp(us: int | None):
        return pd.NaT if us is None else pd.Timestamp(us, unit="us")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        good, failures, nxt = state.get if state.exists else (None, 0, None)
        out = []

        def retry():
            nonlocal nxt
            out.append((key[0], stamp(nxt), "retry", failures, pd.NaT))
            nxt = None

        if state.hasTimedOut:
            if nxt is not None:
                retry()
        else:
            rows = pd.concat(list(batches)).sort_values(["fetched_at", "seq"])
            for status, modified, at in zip(rows["status"], rows["last_modified"].map(micros), rows["fetched_at"].map(micros)):
                if nxt is not None and at > nxt:
                    retry()
                nxt = None
                if not pd.isna(status) and (200 <= status <= 299 or status == 304):
                    due = status == 200 and modified is not None and not pd.isna(modified) and modified > (good or 0)
                    good, failures = at, 0
                    out.append((key[0], stamp(at), "due" if due else "unchanged", 0, pd.NaT))
                else:
                    failures += 1
                    nxt = at + int(delay_ms * 1000 * factor ** (failures - 1)) if failures <= retries else None
                    out.append((key[0], stamp(at), "gave_up" if nxt is None else "failed", failures, stamp(nxt)))
        # the timer is set anew each time; one that the watermark has passed already fires here
        if nxt is not None and nxt // 1000 < state.getCurrentWatermarkMs():
            retry()
        state.update((good, failures, nxt))
        if nxt is not None:
            state.setTimeoutTimestamp(max(nxt // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["feed_url", "at", "event", "failures", "next_at"]).astype(
            {"at": "datetime64[us]", "next_at": "datetime64[us]", "failures": "int32"})

    rows = stream.select(*COLUMNS).where("feed_url is not null and fetched_at is not null").withWatermark("fetched_at", delay)
    return rows.groupBy("feed_url").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
