"""Helpers shared by the operators of this subpackage.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` (shared
by all executors), so a lost executor costs a re-read and never a lost result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Files of a table that may be broadcast; beyond it joins are shuffled.
BROADCAST_BYTES = 8 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only (``lower`` would fold other letters as well)."""
    return F.translate(c, UPPER, UPPER.lower())


class Table:
    """A DataFrame written once to the shared folder."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, f"llm-{name}-{uuid.uuid4().hex}")
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def _path(self):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def bytes(self) -> int:
        fs, p = self._path()
        return fs.getContentSummary(p).getLength()

    def drop(self) -> None:
        """Removes the files; only for tables that no returned plan reads."""
        fs, p = self._path()
        fs.delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows are written to the shared folder and read back."""
    return Table(df, name).df


def broadcast_within(table: Table, max_bytes: int) -> DataFrame:
    """The table with a broadcast hint if its files are within ``max_bytes``
    (columnar files unpack to a small multiple); else left to a shuffled join."""
    return F.broadcast(table.df) if table.bytes() <= max_bytes else table.df


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, to order repeated rows the same way in any run."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def sampled(rows: DataFrame, size: int, salt: str) -> DataFrame:
    """About ``size`` of the distinct rows (all, if there are fewer), chosen by a hash of
    the whole row: null or repeated ids are no reason to be taken or left out together."""
    return rows.where(in_sample(rows, size, salt)).distinct()


def in_sample(rows: DataFrame, size: int, salt: str) -> Column:
    """Whether a row is one of ``sampled``; equal rows are in or out together."""
    own = [F.col(f"`{c}`") for c in rows.columns]
    n = rows.agg(F.approx_count_distinct(F.xxhash64(*own), 0.02).alias("n")).first()["n"]
    steps = 1 << 62
    return F.pmod(F.xxhash64(F.lit(salt), *own), F.lit(steps)) < F.lit(steps if n <= size else int(steps / n * size))
