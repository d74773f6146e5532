"""Entries and enrichment as bucketed tables, so that their join needs no shuffle.

Both tables are written hashed by the entry's key into the same number of
buckets, each bucket one sorted file.  The shuffle is paid once, when a table is
written; every later join on the key reads matching buckets side by side.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.relational import with_enrichment
from ..session import scratch_path

KEY = ("partition_key", "row_key")


def write_bucketed(df: DataFrame, name: str, buckets: int, keys: Sequence[str] = KEY, path: str | None = None) -> DataFrame:
    """Writes ``df`` as the catalogue table ``name`` in ``buckets`` buckets by ``keys``
    (replacing it), its files below ``path``, and returns the table."""
    out = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").format("parquet")
    (out.option("path", path) if path else out).saveAsTable(name)
    return df.sparkSession.table(name)


def bucketed_enrichment(entries: DataFrame, enrichment: DataFrame, buckets: int) -> DataFrame:
    """J3 over bucketed copies of both tables; the join itself has no exchange."""
    spark, mark = entries.sparkSession, uuid.uuid4().hex
    made = [write_bucketed(df, f"{kind}_{mark}", buckets, path=scratch_path(spark, f"{kind}-{mark}"))
            for df, kind in ((entries, "entries"), (enrichment, "enrichment"))]
    return with_enrichment(made[0], made[1].hint("merge"))
