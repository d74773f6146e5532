"""Joins, aggregates, ordering and unions.

Scale notes
* Aggregates use functions with partial (map-side) aggregation (count,
  count_if, sum, max_by, bool_or, min), so a key holding a third of all rows
  still sends one row per map task through the shuffle.
* Joins carry no hints: AQE measures the build side at run time and
  switches to a broadcast join only when it is small.
* Positions inside a group (payload chunks) come from
  :func:`ordered_index`, which never sorts a whole group in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions._col import let
from ..functions.scores import engagement_score
from ..functions.urls import normalize_url

# ---------------------------------------------------------------- joins --

def new_only(df: DataFrame, existing: DataFrame, key: str, existing_key: str | None = None) -> DataFrame:
    """Rows whose key is not already present."""
    ek = existing.select(F.col(existing_key or key).alias("__k"))
    return df.join(ek, df[key] == ek["__k"], "left_anti")


def attach_feed(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """Entries ⋈ feeds on ``feed_key = feeds.row_key``; adaptive execution
    measures the feed side and broadcasts it only if it is small."""
    f = feeds.select(*[F.col(c).alias(f"feed_{c}") for c in feeds.columns])
    return entries.join(f, entries["feed_key"] == f["feed_row_key"], "inner")


def orphan_entries(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """J2 anti side: entries whose feed is unknown."""
    k = feeds.select(F.col("row_key").alias("__fk"))
    return entries.join(k, entries["feed_key"] == k["__fk"], "left_anti")


def with_enrichment(entries: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Entries ⟕ enrichment on (partition_key, row_key)."""
    e = enrichment.select(*[F.col(c).alias(c if c in ("partition_key", "row_key") else f"enr_{c}")
                            for c in enrichment.columns])
    return entries.join(e, ["partition_key", "row_key"], "left")


def content_with_fallback(entries: DataFrame, content: DataFrame, pages: DataFrame,
                          to_markdown) -> DataFrame:
    """Stored content first; else the page at the entry's link
    converted to Markdown; else NULL.  One row per entry.

    Links and page URLs are compared in normalised form.  With a ``status``
    column only pages answered with 200 count; of several copies of a page the
    latest by ``fetched_at`` counts (without that column, the greatest HTML).
    Pages are joined once, on the link of entries without stored content only."""
    c = content.select("partition_key", "row_key", F.col("content").alias("__stored")) \
        .filter(F.col("__stored").isNotNull() & (F.col("__stored") != "")
                & (F.col("__stored") != fixed.MISSING_CONTENT_SENTINEL))
    e = entries.join(c, ["partition_key", "row_key"], "left")
    ok = pages.filter(F.col("status") == 200) if "status" in pages.columns else pages
    order = F.struct("fetched_at", "html") if "fetched_at" in pages.columns else F.col("html")
    p = (ok.filter(F.col("html").isNotNull()).groupBy(normalize_url(F.col("url")).alias("__url"))
         .agg(F.max_by("html", order).alias("__html")))
    wanted = F.when(F.col("__stored").isNull(), normalize_url(F.col("link")))
    j = e.withColumn("__wanted", wanted).join(p, F.col("__wanted") == F.col("__url"), "left")

    def pick(h):
        # the page is converted once per row (bound by let), then tested
        return let(to_markdown(h), lambda md: F.when(h.isNotNull() & (md != ""), F.struct(
            md.alias("content"), F.lit("page").alias("content_source"))).otherwise(F.struct(
                F.lit(None).cast("string").alias("content"), F.lit("missing").alias("content_source"))))
    stored = F.struct(F.col("__stored").alias("content"), F.lit("store").alias("content_source"))
    found = F.when(F.col("__stored").isNotNull(), stored).otherwise(pick(F.col("__html")))
    return j.select(*entries.columns, found.alias("__c")).select(*entries.columns, "__c.content", "__c.content_source")


def changed_feeds(fetch_log: DataFrame, state: DataFrame) -> DataFrame:
    """J6 + T1: per feed, the latest fetch decides; a feed is due when that
    fetch answered 200 with Last-Modified after the feed's last ingestion
    (no state → epoch).  304, other 2xx and errors are not due."""
    latest = (fetch_log.groupBy("feed_id")
              .agg(F.max_by(F.struct("status", "last_modified"),
                            F.struct("last_modified", "event_id")).alias("l"))
              .select("feed_id", F.col("l.status").alias("status"),
                      F.col("l.last_modified").alias("last_modified")))
    s = state.select("feed_id", "last_ingestion")
    j = latest.join(s, "feed_id", "left")
    since = F.coalesce(F.col("last_ingestion"), F.lit("1970-01-01 00:00:00").cast("timestamp"))
    due = F.coalesce((F.col("status") == 200) & (F.col("last_modified") > since), F.lit(False))
    return j.select("feed_id", "status", "last_modified", since.alias("since"), due.alias("changed"))


# ----------------------------------------------------------- aggregates --

def last_write_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one greatest in ``order`` (later write
    wins).  ``max_by`` aggregates partially before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return agg.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def log_once(errors: DataFrame, message: str = "message", at: str = "ts") -> DataFrame:
    """A3: one report line per distinct message: count and first time."""
    return errors.groupBy(message).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"))


def interaction_counts(interactions: DataFrame, entry: str = "entry_id", kind: str = "interaction") -> DataFrame:
    """A4 + F24: likes/shares/comments per entry and the engagement score."""
    k = F.col(kind)
    return (interactions.groupBy(entry)
            .agg(F.count_if(k == "Liked").alias("likes"),
                 F.count_if(k == "Shared").alias("shares"),
                 F.count_if(k == "Comment").alias("comments"))
            .withColumn("engagement_score", engagement_score("likes", "shares", "comments")))


def reject_summary(messages: DataFrame, reasons: str = "reject_reasons") -> DataFrame:
    """A5: rejected messages per reason.  (explode_outer + filter: a plain
    explode lets Catalyst push an inferred size filter, with a copy of the
    reasons' expression, below the projection that computes them.)"""
    return (messages.select(F.explode_outer(reasons).alias("reason")).filter(F.col("reason").isNotNull())
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n_messages")))


def processed_status(status: DataFrame, key: str = "Entry_ID", flag: str = "Processed") -> DataFrame:
    """Processed flag per key (any row processed → processed)."""
    return status.groupBy(key).agg(F.bool_or(F.col(flag)).alias("processed"))


# -------------------------------------------------------------- ordering --

def ordered_index(df: DataFrame, by: list[str], order_col: str, block: int = 1 << 16,
                  out: str = "idx", materialize: bool = False) -> DataFrame:
    """0-based position of each row inside its ``by`` group, ordered by
    ``order_col`` (integral and unique inside a group).

    Rows are cut into value blocks of ``order_col``; row numbers are taken
    inside (group, block) — at most ``block`` rows each, whatever the skew —
    and each block is offset by the row count of the group's earlier
    blocks, computed on the small per-block count table.

    The input is read twice (counts and rows); ``materialize`` writes it
    once to the shared checkpoint folder first, for an expensive input."""
    if materialize:
        df = df.checkpoint(eager=True)
    blk = F.floor(F.col(order_col) / F.lit(block))
    d = df.withColumn("__blk", blk)
    counts = d.groupBy(*by, "__blk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__blk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*by, "__blk").orderBy(order_col)
    ranked = d.withColumn("__rn", F.row_number().over(inside))
    return (ranked.join(offsets, [*by, "__blk"])
            .withColumn(out, (F.col("__off") + F.col("__rn") - 1).cast("long"))
            .drop("__blk", "__rn", "__off"))


def entry_key_lists(entries: DataFrame, feed: str, order_col: str, chunk: int = 400,
                    max_json_bytes: int = 48 * 1024) -> DataFrame:
    """A1: per feed, the (partition_key, row_key) pairs of its entries in
    arrival order, cut into chunks so one payload stays under the queue's
    message limit: at most ``chunk`` pairs and at most ``max_json_bytes`` of
    JSON (64 KB once base64-encoded), 1 KB kept for the envelope.  A pair
    costs len(pk) + len(rk) + 8 bytes (keys are ASCII); a feed's entries
    share one partition key, so the size is constant inside a feed."""
    pair_bytes = F.length("partition_key") + F.length("row_key") + 8
    per_chunk = F.greatest(F.lit(1), F.least(F.lit(chunk), F.floor(F.lit(max_json_bytes - 1024) / pair_bytes)))
    idx = ordered_index(entries, [feed], order_col)
    chunked = idx.withColumn("chunk", F.floor(F.col("idx") / per_chunk).cast("long"))
    agg = chunked.groupBy(feed, "chunk").agg(
        F.sort_array(F.collect_list(F.struct("idx", "partition_key", "row_key"))).alias("__keys"),
        F.count(F.lit(1)).alias("n_entries"),
        F.min(order_col).alias("first_entry"), F.max(order_col).alias("last_entry"))
    return agg.select(feed, "chunk", "n_entries", "first_entry", "last_entry",
                      F.transform("__keys", lambda k: F.array(k["partition_key"], k["row_key"]))
                      .alias("entries"))


# --------------------------------------------------------------- unions --

def union_all(frames: list[DataFrame]) -> DataFrame:
    """All feeds' rows in one frame; shapes may differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def category_set(*arrays: Column) -> Column:
    """Union of category lists without duplicates."""
    out = arrays[0]
    for a in arrays[1:]:
        out = F.array_union(out, a)
    return F.array_distinct(out)
