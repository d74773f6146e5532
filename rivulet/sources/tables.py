"""Readers for the landed tables and the stand-in mappings onto the feed
domain (which driver column plays which domain column)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_line


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def feed_url_of(source) -> F.Column:
    return F.concat(F.lit("https://"), source, F.lit(".example.com/feed"))


def feed_items_from_documents(documents: DataFrame) -> DataFrame:
    """Documents as parsed feed items: one item per document, its feed is
    its ``source``.  Columns follow what a feed parser yields (``id``,
    ``title``, ``link``, ``summary``, ``published``, ``author``, ``tags`` as
    ``[{term}]``, ``content`` as ``[{value}]``) plus the feed it came from."""
    d = documents
    return d.select(
        d.source.alias("feed_title"),
        feed_url_of(d.source).alias("feed_url"),
        d.doc_id.cast("string").alias("id"),
        first_line(d.text).alias("title"),
        F.concat(F.lit("https://"), d.source, F.lit(".example.com/entries/"), d.doc_id.cast("string"))
        .alias("link"),
        d.text.alias("summary"),
        F.lit(None).cast("string").alias("published"),
        F.lit(None).cast("string").alias("author"),
        F.array(F.struct(d.lang.alias("term")), F.struct(d.source.alias("term"))).alias("tags"),
        F.array(F.struct(d.text.alias("value"))).alias("content"),
        d.doc_id, d.lang, d.source,
    )


def feeds_from_documents(documents: DataFrame) -> DataFrame:
    """One feed per distinct source (partial aggregation before shuffle)."""
    return (documents.groupBy("source").agg(F.count(F.lit(1)).alias("n_items"))
            .select(F.col("source").alias("title"), feed_url_of(F.col("source")).alias("link"),
                    F.lit(None).cast("string").alias("language"), "n_items"))


# Event types standing in for list interactions (FIXED mapping of the stand-in).
INTERACTION_OF_EVENT = {"click": "Liked", "purchase": "Shared", "view": "Comment"}


def interactions_from_events(events: DataFrame) -> DataFrame:
    """Events as interactions on entries: ``user_id`` plays the entry."""
    kind = F.lit(None).cast("string")
    for ev, name in INTERACTION_OF_EVENT.items():
        kind = F.when(F.col("event_type") == ev, F.lit(name)).otherwise(kind)
    return events.select(F.col("user_id").alias("entry_id"), "ts", kind.alias("interaction"))


def fetch_log_from_events(events: DataFrame) -> DataFrame:
    """Events as a feed fetch log: ``user_id`` plays the feed, ``ts`` the
    Last-Modified time; an error event is a failed fetch (500), a view a
    not-modified answer (304), anything else a 200."""
    status = (F.when(F.col("event_type") == "error", F.lit(500))
              .when(F.col("event_type") == "view", F.lit(304)).otherwise(F.lit(200)))
    return events.select(
        F.col("user_id").alias("feed_id"),
        F.concat(F.lit("https://feed"), F.col("user_id").cast("string"), F.lit(".example.com/rss"))
        .alias("feed_url"),
        status.alias("status"), F.col("ts").alias("last_modified"), "event_id")
