"""Queue messages as rows.

A message body is base64 text of a JSON payload
``{envelope: {status, timestamp}, feed: {name, url, type}}`` (stage 1) or
``{envelope, feed: <feed key>, entries: [[pk, rk], ...]}`` (stage 2).
Decoding never fails a task: a body that is not base64, not UTF-8 JSON or
not an object decodes to NULL and is rejected with its reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions._col import let

FEED_MESSAGE_SCHEMA = ("envelope struct<status: string, timestamp: string>, "
                       "feed struct<name: string, url: string, type: string>")
ENTRY_MESSAGE_SCHEMA = ("envelope struct<status: string, timestamp: string>, "
                        "feed string, entries array<array<string>>")


def encode_body(payload: Column) -> Column:
    """JSON of a struct, base64 text on one line (Spark's base64 may
    break lines every 76 characters; a queue line is one message)."""
    return F.regexp_replace(F.base64(F.encode(F.to_json(payload), "UTF-8")), "[\r\n]", "")


def decode_body(body: Column, schema: str = FEED_MESSAGE_SCHEMA) -> Column:
    """base64 → UTF-8 → JSON struct; NULL when any step fails."""
    raw = F.try_to_binary(body, F.lit("base64"))
    text = F.try_validate_utf8(raw.cast("string"))  # invalid UTF-8 → NULL, never an error
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def envelope(status: str, timestamp: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), timestamp.alias("timestamp"))


def with_reject_reasons(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``reject_reasons`` lists why a stage-1 message cannot be used:
    wrong status, empty payload, no feed URL (each reported)."""
    def reasons(p):
        status_ok = F.coalesce(p["envelope"]["status"] == fixed.ENVELOPE_ENQUEUED, F.lit(False))
        empty = p.isNull() | (p["envelope"].isNull() & p["feed"].isNull())
        url = p["feed"]["url"]
        no_url = url.isNull() | (url == "")
        return F.array_compact(F.array(
            F.when(~status_ok, F.lit("invalid_status")),
            F.when(empty, F.lit("invalid_payload")),
            F.when(no_url, F.lit("missing_feed_url"))))
    # the payload is bound once: its decoding is not repeated per reference
    return df.withColumn("reject_reasons", let(F.col(payload), reasons))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.size("reject_reasons") == 0)


def mark_retrieved(feed_key: Column, entries: Column, now: Column) -> Column:
    """T5: stage-2 payload, status ``retrieved`` with a new timestamp."""
    return F.struct(envelope(fixed.ENVELOPE_RETRIEVED, now).alias("envelope"),
                    feed_key.alias("feed"), entries.alias("entries"))
