"""Queue-driven ingestion with Structured Streaming.

Stage 0  ``enqueue_changed_feeds`` (batch, scheduled or on demand, T1/T2/T4):
         config feeds ⟕ fetch log ⟕ state → due feeds → stage-1 messages;
         the state advances only after the messages are committed.
Stage 1  ``start_feed_ingest`` (stream, T3/T5/T6): stage-1 messages → decode
         → reject with reasons → dedupe redeliveries within a watermark →
         landed feed documents (join on URL) → parse → feed and entry rows →
         validate → upsert / quarantine → stage-2 messages (key chunks).
Stage 2  ``start_entry_enrichment`` (stream, T7): stage-2 messages → entry
         keys → entries → enrichment → upsert.

Queues are folders of text files, one base64 message per line; every
stream has its checkpoint below the folder that holds its tables, so that
any later process goes on where the last one stopped, and every sink is a
keyed upsert, so a replayed micro-batch rewrites the same rows.  What a
batch does not store goes to a side table with the reason.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import fixed
from ..functions.dates import iso_utc
from ..operators.entities import build_entries, build_feeds, with_feed_keys
from ..operators.enrich import enrich
from ..operators.relational import changed_feeds, entry_key_lists, last_write_wins
from ..operators.validate import entry_rules, feed_rules, validate
from ..session import scratch_path
from ..sources.feeds import parse_feed_xml
from ..sources.queue import (ENTRY_MESSAGE_SCHEMA, FEED_MESSAGE_SCHEMA, decode_body, encode_body,
                             envelope, mark_retrieved, with_reject_reasons)
from ..sources.store import KeyedTable


# hash buckets of the entry tables, unless a run is told otherwise
ENTRY_BUCKETS = 16
KEYS = ["partition_key", "row_key"]


def checkpoint_path(tables: dict[str, str], name: str) -> str:
    """Where a stream keeps its state: below the folder of its tables, the same
    in every process."""
    return f"{tables['entries'].rstrip('/').rpartition('/')[0]}/_checkpoints/{name}"


# ------------------------------------------------------------ stage 0 --

def enqueue_changed_feeds(spark: SparkSession, feeds: DataFrame, fetch_log: DataFrame,
                          state_path: str, queue_dir: str, run_start: str) -> int:
    """T1 + S6 + T2.  ``feeds``: (name, url, type); ``fetch_log``:
    (feed_url, status, last_modified, event_id); state: (feed_id=url,
    last_ingestion).  Returns how many messages were written."""
    state = KeyedTable(spark, state_path, ["feed_id"], partition_col="state")
    cur = (state.read().select("feed_id", "last_ingestion") if state.exists()
           else spark.createDataFrame([], "feed_id string, last_ingestion timestamp"))
    log = fetch_log.join(feeds.select(F.col("url").alias("feed_url")), "feed_url", "left_semi") \
        .withColumnRenamed("feed_url", "feed_id")
    # written once: messages and watermark see the same set of due feeds
    due_path = scratch_path(spark, f"due-{uuid.uuid4().hex}")
    changed_feeds(log, cur).filter("changed").select("feed_id").write.parquet(due_path)
    due = spark.read.schema("feed_id string").parquet(due_path)
    now = F.lit(run_start).cast("timestamp")
    msgs = (feeds.join(due, feeds.url == due.feed_id, "left_semi")
            .select(encode_body(F.struct(envelope(fixed.ENVELOPE_ENQUEUED, iso_utc(now)).alias("envelope"),
                                         F.struct("name", "url", "type").alias("feed"))).alias("value")))
    obs = Observation(f"enqueued_{uuid.uuid4().hex}")
    msgs.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("append").text(queue_dir)  # sink first ...
    state.upsert(due.select("feed_id", now.alias("last_ingestion"),
                            F.lit("s").alias("state")))          # ... then the watermark moves
    return int(obs.get.get("rows", 0))


# ------------------------------------------------------------ stage 1 --

def decoded_feed_messages(stream: DataFrame) -> DataFrame:
    """S5 + P1 + T6 on a stream of ``value`` lines."""
    m = with_reject_reasons(stream.withColumn("payload", decode_body(F.col("value"), FEED_MESSAGE_SCHEMA)))
    m = m.withColumn("enqueued_at", F.col("payload.envelope.timestamp")) \
         .withColumn("feed_url", F.col("payload.feed.url"))
    # one key per message: the feed and its enqueue time, or the raw body
    # for a message that cannot be used (so distinct bad ones stay apart)
    key = F.when(F.size("reject_reasons") == 0, F.concat_ws("|", "feed_url", "enqueued_at")) \
           .otherwise(F.concat(F.lit("raw:"), F.col("value")))
    # arrival time drives the watermark: nothing is ever "late", so a
    # delayed message is processed; redeliveries within the span are dropped
    return m.withColumn("dedupe_key", key).withColumn("arrived_at", F.current_timestamp())


def _write_epoch(df: DataFrame, path: str, kind: str) -> None:
    """Side tables of a micro-batch are partitioned by (epoch, kind) and
    written with dynamic overwrite: a replayed batch replaces its own rows
    of that kind and nothing else."""
    (df.withColumn("kind", F.lit(kind)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("epoch", "kind").parquet(path))


def ingest_batch(batch: DataFrame, epoch_id: int, spark: SparkSession, landed: DataFrame,
                 tables: dict[str, str], entry_queue_dir: str, now: str | None = None,
                 pages: DataFrame | None = None, buckets: int = ENTRY_BUCKETS) -> None:
    """One micro-batch of stage 1 (T3): all writes are keyed upserts or
    appends of rows that carry the batch's own keys, so a replay is safe."""
    kept = [batch.persist()]
    epoch = F.lit(epoch_id).cast("long").alias("epoch")

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist())
        return kept[-1]

    def set_aside(df: DataFrame, what: Column, reason: str) -> None:
        _write_epoch(df.select(what.cast("string").alias("id"), F.array(F.lit(reason)).alias("violations"), epoch),
                     tables["quarantine"], reason)
    try:
        good = batch.filter(F.size("reject_reasons") == 0).select("feed_url").distinct()
        rejected = batch.filter(F.size("reject_reasons") > 0).select("value", "reject_reasons", epoch)
        _write_epoch(rejected, tables["rejected"], "message")
        # a document landed more than once counts once: the latest
        order = F.struct("landed_at", "xml") if "landed_at" in landed.columns else F.col("xml")
        docs = (landed.join(good, "feed_url", "left_semi").groupBy("feed_url").agg(F.max_by("xml", order).alias("xml")))
        items = keep(parse_feed_xml(docs, "xml"))
        set_aside(good.join(items.select("feed_url"), "feed_url", "left_anti"), F.col("feed_url"), "document_missing")
        set_aside(items.filter(~F.col("parsed")), F.col("feed_url"), "document_unparsable")
        set_aside(items.filter(F.col("parsed") & F.col("item_pos").isNotNull() & F.col("id").isNull()),
                  F.concat_ws("#", "feed_url", F.col("item_pos").cast("string")), "item_without_id")
        feeds = build_feeds(items.filter("parsed").select(
            F.col("feed_title").alias("title"), F.col("feed_link").alias("link"), F.col("feed_language").alias("language"),
            F.col("feed_updated").alias("updated"), F.col("feed_subtitle").alias("subtitle"), "feed_url")
            .dropDuplicates(["feed_url"]), source_url_col="feed_url")
        fv = keep(validate(feeds, feed_rules()))
        _write_epoch(fv.filter(F.size("violations") > 0).select(F.col("link").alias("id"), "violations", epoch),
                     tables["quarantine"], "feed")
        # two documents of one feed link are one feed: the greater row wins, in any run
        feed_rows = fv.filter(F.size("violations") == 0).drop("violations", "entry_partition")
        KeyedTable(spark, tables["feeds"], KEYS).upsert(last_write_wins(feed_rows, KEYS, ["updated", "title", "link", "language", "subtitle"]))
        raw = with_feed_keys(items.filter("parsed").filter(F.col("id").isNotNull()))   # same keys as the feed rows
        # an id that repeats in a document counts once: the later item (A2)
        ev = validate(build_entries(raw, keep=("item_pos",)), entry_rules())
        ev = keep(last_write_wins(ev.withColumn("__last", F.struct("item_pos", "feed_key", "title", "link")), KEYS, ["__last"]).drop("__last"))
        _write_epoch(ev.filter(F.size("violations") > 0).drop("item_pos").withColumn("epoch", epoch),
                     tables["quarantine"], "validation")
        good_entries = ev.filter(F.size("violations") == 0).drop("violations")
        if pages is not None:
            good_entries = keep(_with_content(spark, good_entries, pages, tables, epoch_id, buckets))
        KeyedTable(spark, tables["entries"], KEYS, buckets=buckets).upsert(good_entries.drop("item_pos"))
        ts = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        # document order, the same in any run
        lists = entry_key_lists(good_entries, "feed_key", "item_pos")
        lists.select(encode_body(mark_retrieved(F.col("feed_key"), F.col("entries"), iso_utc(ts))).alias("value")) \
            .write.mode("append").text(entry_queue_dir)
    finally:
        for df in kept:
            df.unpersist()


def _with_content(spark: SparkSession, entries: DataFrame, pages: DataFrame, tables: dict[str, str],
                  epoch_id: int, buckets: int = ENTRY_BUCKETS) -> DataFrame:
    """An entry is saved only with content — stored content
    first, else its landed page as Markdown.  New content is written to the
    content table; entries without any go to the quarantine."""
    from ..functions.html import text_or_html_to_markdown
    from ..operators.relational import content_with_fallback
    content = KeyedTable(spark, tables["content"], KEYS, buckets=buckets)
    stored = (content.read_for(entries) if content.exists()      # only the buckets of this batch
              else spark.createDataFrame([], "partition_key string, row_key string, content string"))
    path = scratch_path(spark, f"content-{uuid.uuid4().hex}")
    content_with_fallback(entries, stored, pages, text_or_html_to_markdown).write.parquet(path)   # pages are converted once
    c = spark.read.parquet(path)
    content.upsert(c.filter(F.col("content_source") == "page").select("partition_key", "row_key", "content"))
    _write_epoch(c.filter(F.col("content").isNull()).drop("content", "content_source", "item_pos")
                 .withColumn("violations", F.array(F.lit("content_missing")))
                 .withColumn("epoch", F.lit(epoch_id).cast("long")), tables["quarantine"], "content")
    return c.filter(F.col("content").isNotNull()).drop("content", "content_source")


def start_feed_ingest(spark: SparkSession, queue_dir: str, landed: DataFrame, tables: dict[str, str],
                      entry_queue_dir: str, name: str = "feed_ingest", available_now: bool = True,
                      now: str | None = None, pages: DataFrame | None = None, buckets: int = ENTRY_BUCKETS) -> StreamingQuery:
    """Run stage 1 over the feed queue; ``available_now`` processes
    what is there and stops (the scheduled run), else it keeps running.
    With ``pages`` (landed ``url``, ``html``), entries are saved only with
    content (stored, else the page as Markdown), content is stored too."""
    stream = spark.readStream.format("text").load(queue_dir)
    m = decoded_feed_messages(stream)
    # A redelivered message (same feed and enqueue time) is dropped,
    # with dedupe state kept for the watermark's span only
    m = m.withWatermark("arrived_at", "1 day").dropDuplicatesWithinWatermark(["dedupe_key"])
    w = (m.writeStream.option("checkpointLocation", checkpoint_path(tables, name))
         .foreachBatch(lambda b, i: ingest_batch(b, i, spark, landed, tables, entry_queue_dir, now, pages, buckets)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.queryName(name).start()


# ------------------------------------------------------------ stage 2 --

def enrich_batch(batch: DataFrame, epoch_id: int, spark: SparkSession, tables: dict[str, str], buckets: int = ENTRY_BUCKETS) -> None:
    keys = (batch.select(F.explode_outer("payload.entries").alias("k"))
            .select(F.col("k")[0].alias("partition_key"), F.col("k")[1].alias("row_key"))
            .dropna().distinct())
    entries = KeyedTable(spark, tables["entries"], KEYS, buckets=buckets).read_for(keys)
    e = enrich(entries, "summary")
    KeyedTable(spark, tables["enrichment"], KEYS, buckets=buckets).upsert(
        e.select("partition_key", "row_key", F.col("ai_summary").alias("summary"),
                 F.col("sentiment"), F.col("sentiment_score"), F.col("readability"),
                 F.col("embedding").alias("embeddings")))


def start_entry_enrichment(spark: SparkSession, entry_queue_dir: str, tables: dict[str, str],
                           name: str = "entry_enrichment", available_now: bool = True, buckets: int = ENTRY_BUCKETS) -> StreamingQuery:
    """Second stage, fed by the first stage's entry queue."""
    stream = spark.readStream.format("text").load(entry_queue_dir)
    m = stream.withColumn("payload", decode_body(F.col("value"), ENTRY_MESSAGE_SCHEMA)) \
              .filter(F.col("payload.envelope.status") == fixed.ENVELOPE_RETRIEVED)
    w = (m.writeStream.option("checkpointLocation", checkpoint_path(tables, name))
         .foreachBatch(lambda b, i: enrich_batch(b, i, spark, tables, buckets)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.queryName(name).start()


def run_pipeline(spark: SparkSession, feeds: DataFrame, fetch_log: DataFrame, landed: DataFrame,
                 root: str, run_start: str, pages: DataFrame | None = None, buckets: int = ENTRY_BUCKETS) -> dict[str, str]:
    """T4 + T7: one scheduled (or on-demand) run of all stages: enqueue the
    due feeds, drain the feed queue, drain the entry queue.  Each stage
    stops when its input is processed (``availableNow``); the schedule
    itself lives outside.  With ``pages`` entries are saved only with content.
    ``buckets`` is the number of buckets of the entry tables where they are new: about
    a table's bytes / 1 GB.  Returns the table paths."""
    import os
    paths = {k: os.path.join(root, k) for k in
             ("feeds", "entries", "quarantine", "rejected", "enrichment", "content", "state", "q_feeds", "q_entries")}
    enqueue_changed_feeds(spark, feeds, fetch_log, paths["state"], paths["q_feeds"], run_start)
    start_feed_ingest(spark, paths["q_feeds"], landed, paths, paths["q_entries"],
                      name="feed_ingest", now=run_start, pages=pages, buckets=buckets).awaitTermination()
    start_entry_enrichment(spark, paths["q_entries"], paths, name="entry_enrichment", buckets=buckets).awaitTermination()
    return paths


__all__ = ["run_pipeline", "enqueue_changed_feeds", "start_feed_ingest", "start_entry_enrichment",
           "ingest_batch", "enrich_batch", "decoded_feed_messages"]
