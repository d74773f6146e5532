"""Typed feed, entry, enrichment and post rows (schemas of the domain
tables) built from raw inputs with native column functions.

Each builder accepts snake_case or PascalCase input names (P9), fills the
declared defaults, derives the hashed keys and returns the declared column
order.  Validation is a separate step (``validate``) so callers decide
whether to quarantine or fail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import fixed
from ..functions.dates import parse_date_or_epoch
from ..functions.html import clean_summary
from ..functions.keys import entry_key, feed_key, partition_key_from_title, post_key
from ..functions.markdown import markdown_document_to_html
from ..functions.structured import image_from_json, tags_to_terms
from ..functions.urls import normalize_url
from .conform import link_fallback, project_aliases

FEED_FIELDS = [("partition_key", "PartitionKey"), ("title", "Title"), ("link", "Link"),
               ("language", "Language"), ("publisher", "Publisher"), ("rights", "Rights"),
               ("updated", "Updated"), ("image", "Image"), ("subtitle", "Subtitle")]
ENTRY_FIELDS = [("partition_key", "PartitionKey"), ("feed_key", "FeedKey"), ("id", "Id"),
                ("title", "Title"), ("link", "Link"), ("published", "Published"),
                ("author", "Author"), ("tags", "Tags"), ("summary", "Summary"),
                ("source", "Source")]
ENRICHMENT_FIELDS = [("partition_key", "PartitionKey"), ("row_key", "RowKey"),
                     ("summary", "Summary"), ("grade_level", "GradeLevel"),
                     ("difficulty", "Difficulty"), ("engagement_score", "EngagementScore"),
                     ("engagement_categories", "EngagementCategories"),
                     ("embeddings", "Embeddings")]


def _dtype(df: DataFrame, name: str):
    return df.schema[name].dataType


def build_feeds(raw: DataFrame, source_url_col: str | None = None) -> DataFrame:
    """Feed rows: link falls back to the fetched URL (P10) before it is
    normalised (F1); ``row_key`` = hash of the normalised link (F2);
    ``partition_key`` from the title (F4) is exposed as ``entry_partition``
    for the feed's entries while the feed itself lives under 'feed'."""
    src = F.col(source_url_col) if source_url_col else F.lit(None).cast("string")
    p = project_aliases(raw.withColumn("__src", src), FEED_FIELDS + [("__src", "__src")])
    title = F.coalesce(F.col("title").cast("string"), F.lit(fixed.DEFAULT_TITLE))
    link = normalize_url(link_fallback(F.col("link").cast("string"), F.col("__src")))
    image = F.col("image")
    if isinstance(_dtype(p, "image"), StringType):
        image = image_from_json(image)
    elif p.schema["image"].dataType.simpleString() == "void":
        image = F.lit(None).cast("map<string,string>")
    return p.select(
        F.coalesce(F.col("partition_key").cast("string"), F.lit(fixed.FEED_PARTITION_KEY)).alias("partition_key"),
        feed_key(link).alias("row_key"),
        title.alias("title"),
        link.alias("link"),
        F.col("language").cast("string").alias("language"),
        F.col("publisher").cast("string").alias("publisher"),
        F.col("rights").cast("string").alias("rights"),
        parse_date_or_epoch(F.col("updated"), _dtype(p, "updated")).alias("updated"),
        image.alias("image"),
        F.col("subtitle").cast("string").alias("subtitle"),
        partition_key_from_title(title).alias("entry_partition"),
    )


def with_feed_keys(items: DataFrame, title_col: str = "feed_title", link_col: str | None = "feed_link",
                   source_url_col: str | None = "feed_url") -> DataFrame:
    """Give items their feed's keys without joining the feed table: the
    entries' partition key (F4 of the feed title) and the feed key (F2 of
    the feed link, falling back to the fetched URL, normalised) are pure
    functions of the item's own feed columns — the same expressions
    :func:`build_feeds` uses."""
    def col_or_null(c):
        return F.col(c) if c and c in items.columns else F.lit(None).cast("string")
    title = F.coalesce(col_or_null(title_col).cast("string"), F.lit(fixed.DEFAULT_TITLE))
    link = normalize_url(link_fallback(col_or_null(link_col).cast("string"), col_or_null(source_url_col)))
    return items.withColumn("partition_key", partition_key_from_title(title)) \
                .withColumn("feed_key", feed_key(link))


def build_entries(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Entry rows from parsed items that already carry ``partition_key`` and
    ``feed_key``: key = hash(id), tags → terms, summary cleaned (HTML →
    Markdown, ≤20 sentences, ≤2000 characters), link normalised, published
    parsed (absent → epoch, unparsable → NULL and flagged).  ``keep`` names
    input columns carried through unchanged."""
    p = project_aliases(raw, ENTRY_FIELDS + [(k, k) for k in keep])
    tags_dt = _dtype(p, "tags")
    tags = (tags_to_terms(F.col("tags"), tags_dt) if tags_dt.simpleString() != "void"
            else F.array().cast("array<string>"))
    src_dt = _dtype(p, "source")
    source = F.col("source") if src_dt.simpleString().startswith("map") else F.lit(None).cast("map<string,string>")
    return p.select(
        F.coalesce(F.col("partition_key").cast("string"), F.lit(fixed.ENTRY_PARTITION_KEY)).alias("partition_key"),
        entry_key(F.col("id")).alias("row_key"),
        F.col("feed_key").cast("string").alias("feed_key"),
        F.col("id").cast("string").alias("id"),
        F.coalesce(F.col("title").cast("string"), F.lit(fixed.DEFAULT_TITLE)).alias("title"),
        normalize_url(F.col("link").cast("string")).alias("link"),
        parse_date_or_epoch(F.col("published"), _dtype(p, "published")).alias("published"),
        F.col("author").cast("string").alias("author"),
        tags.alias("tags"),
        clean_summary(F.col("summary").cast("string")).alias("summary"),
        source.alias("source"),
        *[F.col(k) for k in keep],
    )


def build_enrichment(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Enrichment rows keyed like their entry; categories as a set.
    ``keep`` names input columns carried through unchanged (ids)."""
    p = project_aliases(raw, ENRICHMENT_FIELDS + [(k, k) for k in keep])
    cats = F.col("engagement_categories")
    if p.schema["engagement_categories"].dataType.simpleString() == "void":
        cats = F.lit(None).cast("array<string>")
    emb = F.col("embeddings")
    if p.schema["embeddings"].dataType.simpleString() == "void":
        emb = F.lit(None).cast("array<float>")
    cats = F.transform(cats, lambda x: F.when(x == "Commented", F.lit("Comment")).otherwise(x))
    return p.select(
        F.col("partition_key").cast("string").alias("partition_key"),
        F.col("row_key").cast("string").alias("row_key"),
        F.col("summary").cast("string").alias("summary"),
        F.col("grade_level").cast("double").alias("grade_level"),
        F.col("difficulty").cast("double").alias("difficulty"),
        F.col("engagement_score").cast("double").alias("engagement_score"),
        F.array_distinct(cats).alias("engagement_categories"),
        emb.cast("array<float>").alias("embeddings"),
        *[F.col(k) for k in keep],
    )


def build_posts(raw: DataFrame) -> DataFrame:
    """Post rows: partition ``yyyy-MM`` of the draft date, key = hash of
    ``title_content_isoformat(draft_date)`` over the Markdown content, with
    the HTML rendering kept beside it."""
    fields = [("title", "Title"), ("draft_date", "DraftDate"), ("keywords", "Keywords"),
              ("content", "Content"), ("draft_status", "DraftStatus")]
    p = project_aliases(raw, fields)
    dd = parse_date_or_epoch(F.col("draft_date"), _dtype(p, "draft_date"))
    dd = F.when(F.col("draft_date").isNull(), F.lit(None).cast("timestamp")).otherwise(dd)
    p = p.withColumn("draft_date", dd)
    return p.select(
        F.date_format("draft_date", "yyyy-MM").alias("partition_key"),
        post_key(F.col("title"), F.col("content"), F.col("draft_date")).alias("row_key"),
        F.col("title").cast("string").alias("title"),
        F.col("draft_date"),
        F.col("keywords").cast("array<string>").alias("keywords"),
        F.col("content").cast("string").alias("content"),
        markdown_document_to_html(F.col("content").cast("string")).alias("content_html"),
        F.col("draft_status").cast("array<string>").alias("draft_status"),
    )
