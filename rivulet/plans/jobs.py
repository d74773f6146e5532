"""User-level jobs: the three flows of the original, each one call.

* :func:`daily_job` — enqueue changed feeds, ingest them, enrich entries
  (the scheduled / on-demand run; see ``streaming.ingest.run_pipeline``).
* :func:`frame_job` — configured feeds → 13-column frame → enrichment →
  rows stored by (month of publication, entry key).
* :func:`publish_job` — items → 15-column list rows → list column names →
  only rows not yet in the list are appended; rule breakers quarantined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import readability
from ..operators.conform import (conform_frame13, conform_list15, drop_missing_ids, frame_table_rows,
                                 list_column_map)
from ..operators.enrich import ModelRegistry, enrich, enrich_with_models
from ..operators.validate import rules_from_list_schema, to_list_values
from ..sources.feeds import load_feed_config, parse_feed_xml
from ..sources.store import KeyedTable, publish_new_rows, quarantine_rows
from ..streaming.ingest import run_pipeline as daily_job  # noqa: F401


def frame_job(spark: SparkSession, config_path: str, landed: DataFrame, table_path: str,
              registry: ModelRegistry | None = None, buckets: int = 16) -> DataFrame:
    """Feeds listed in a config (top-level ``feeds``) are parsed from the
    landed documents (``feed_url``, ``xml``), conformed to the 13-column
    frame, enriched (offline models, or the registry's), and upserted by
    (yyyy-MM, Entry_ID).  All feeds go into one frame.  Returns the rows."""
    feeds = load_feed_config(spark, config_path, section=None)
    docs = landed.join(feeds.select(F.col("url").alias("feed_url")), "feed_url", "left_semi")
    frame = conform_frame13(drop_missing_ids(parse_feed_xml(docs, "xml")), fill_nulls=True)
    if registry is None:
        e = enrich(frame, "Summary")
    else:
        e = enrich_with_models(frame, registry, "Summary")
    e = e.withColumn("Summary", F.coalesce("ai_summary", "Summary")) \
         .withColumn("Sentiment", F.col("sentiment")).withColumn("Sentiment_Score", F.col("sentiment_score")) \
         .withColumn("Readability_FK", readability(F.col("Summary"))) \
         .withColumn("Embeddings", F.col("embedding").cast("array<float>"))
    rows = frame_table_rows(e)
    # a date that does not parse gives no month: set aside, not stored under NULL
    dated = F.col("PartitionKey").isNotNull()
    aside = rows.withColumn("violations", F.when(dated, F.array().cast("array<string>")).otherwise(F.array(F.lit("date_unparsable"))))
    quarantine_rows(aside, f"{table_path.rstrip('/')}_quarantine")
    rows = rows.filter(dated)
    KeyedTable(spark, table_path, ["PartitionKey", "RowKey"], partition_col="PartitionKey",
               buckets=buckets).upsert(rows)
    return rows


def publish_job(items: DataFrame, list_path: str, column_meta: DataFrame, list_schema: dict | str,
                quarantine_path: str | None = None) -> int:
    """Items → list rows (P4) → the list's internal column names
    → rules of the list schema (V18) → append the rows whose Entry_ID is
    new (J1, S14).  Returns how many rows were appended."""
    rows = to_list_values(conform_list15(items), list_schema)
    rename = {r.display_name: r.name for r in list_column_map(column_meta).collect()}  # metadata
    return publish_new_rows(rows, list_path, rename, rules_from_list_schema(list_schema), quarantine_path)
