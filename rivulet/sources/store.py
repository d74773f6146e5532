"""Keyed tables on parquet: merge-upsert, keyed delete, append-new
(S7, S8, S10, S11, S13, S14, and the ingestion state of T2).

A table is a parquet folder with a fixed number of hash buckets of its keys
as its only partition level, so that keys stay ordinary (typed, nullable)
columns and a hot partition key spreads over all buckets.  Its schema is
kept in a side file and declared on every read.

A write stages the merged rows of the buckets that it touches inside the
table folder (hidden from readers), records what it is about to swap, then
moves the buckets in.  A crash before the record leaves the table as it was;
after it, the next operation on the table completes the swap.  Re-running a
batch gives the same table.  One writer per table at a time; a reader during
the swap may see some buckets new and some old.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .. import fixed
from ..operators.relational import last_write_wins


def merge_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """S10 semantics: create-or-merge by key.  A property that is NULL (or
    absent) in the new row keeps the old value; every other property takes
    the new one.  ``new`` must already hold one row per key."""
    cols = [c for c in old.columns if c not in keys]
    for c in new.columns:
        if c not in keys and c not in cols:
            cols.append(c)
    o = old.select(*[F.col(k).alias(f"__ok_{k}") for k in keys], *[F.col(c).alias(f"__o_{c}") for c in cols if c in old.columns])
    n = new.select(*[F.col(k).alias(f"__nk_{k}") for k in keys], *[F.col(c).alias(f"__n_{c}") for c in cols if c in new.columns])
    same = [F.col(f"__ok_{k}").eqNullSafe(F.col(f"__nk_{k}")) for k in keys]     # a NULL key equals itself
    j = o.join(n, reduce(lambda x, y: x & y, same), "full_outer")

    def pick(c):
        if c in new.columns and c in old.columns:
            return F.coalesce(F.col(f"__n_{c}"), F.col(f"__o_{c}")).alias(c)
        if c in new.columns:
            return F.col(f"__n_{c}").alias(c)
        return F.col(f"__o_{c}").alias(c)

    return j.select(*[F.coalesce(f"__nk_{k}", f"__ok_{k}").alias(k) for k in keys], *[pick(c) for c in cols])


def keyed_delete(df: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in the delete set are removed."""
    return df.join(deletes.select(*keys), keys, "left_anti")


class DuplicateKeyError(ValueError):
    """A batch holds different rows of one key and nothing orders them."""


class KeyedTable:
    """A parquet table with one row per ``keys``.

    ``buckets`` is fixed when the table is made.  ``seq_cols`` order the rows
    of one key inside a batch (the last wins, A2); they are not stored.
    """

    BUCKET = "bucket"

    def __init__(self, spark: SparkSession, path: str, keys: list[str],
                 partition_col: str = "partition_key", seq_cols: list[str] | None = None,
                 buckets: int = 16):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.partition_col, self.seq_cols, self.buckets = partition_col, seq_cols, buckets

    # -- files --

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        return jvm, jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, *parts: str):
        return self._fs()[0].org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _put(self, text: str, *parts: str) -> None:
        out = self._fs()[1].create(self._p(*parts), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _get(self, *parts: str) -> str:
        jvm, fs = self._fs()
        stream = fs.open(self._p(*parts))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def exists(self) -> bool:
        self._recover()
        return bool(self._fs()[1].exists(self._p("_table.json")))

    def _table(self) -> dict:
        return json.loads(self._get("_table.json"))

    def _recover(self) -> None:
        """Completes a recorded swap; removes stages without a record."""
        fs = self._fs()[1]
        if not fs.exists(self._p()):
            return
        for f in fs.listStatus(self._p()):
            name = f.getPath().getName()
            if name.startswith("_stage-"):
                if fs.exists(self._p(name, "_swap.json")):
                    self._move_in(name)
                fs.delete(self._p(name), True)

    def _move_in(self, stage: str) -> None:
        fs = self._fs()[1]
        swap = json.loads(self._get(stage, "_swap.json"))
        for b in swap["buckets"]:
            folder = f"{self.BUCKET}={b}"
            if b in swap["empty"]:
                fs.delete(self._p(folder), True)
            elif fs.exists(self._p(stage, folder)):       # else moved before the crash
                fs.delete(self._p(folder), True)
                fs.rename(self._p(stage, folder), self._p(folder))
        self._put(json.dumps(swap["table"]), "_table.json")

    # -- reads --

    def _read_all(self) -> DataFrame:
        t = self._table()
        self.buckets = t["buckets"]
        schema = StructType.fromJson(t["schema"]).add(self.BUCKET, IntegerType())
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self) -> DataFrame:
        self._recover()
        return self._read_all().drop(self.BUCKET)

    def read_for(self, keys_df: DataFrame) -> DataFrame:
        """The stored rows of the given keys; only their buckets are scanned."""
        self._recover()
        stored = self._read_all()
        k = self._with_bucket(keys_df.select(*self.keys))
        hit = self._buckets_of(k)
        return stored.filter(F.col(self.BUCKET).isin(hit)).join(k, [*self.keys, self.BUCKET], "left_semi").drop(self.BUCKET)

    def _with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _buckets_of(self, df: DataFrame) -> list[int]:
        """At most as many numbers as the table has buckets."""
        return sorted(r[0] for r in df.select(self.BUCKET).distinct().collect())

    # -- writes --

    def _one_per_key(self, batch: DataFrame) -> DataFrame:
        if self.seq_cols:
            return last_write_wins(batch, self.keys, self.seq_cols).drop(*self.seq_cols)
        rest = [c for c in batch.columns if c not in self.keys]
        whole = F.xxhash64(*[F.col(c).cast("string") if batch.schema[c].dataType.typeName() == "map" else F.col(c) for c in rest]) if rest else F.lit(0)
        one = batch.groupBy(*self.keys).agg(F.first(F.struct(*rest) if rest else F.lit(0)).alias("__row"),
                                            F.min(whole).alias("__lo"), F.max(whole).alias("__hi"))
        ok = F.when(F.col("__lo") == F.col("__hi"), F.lit(True)).otherwise(
            F.raise_error(F.lit(f"different rows of one key in a batch for {self.path}")).cast("boolean"))
        return one.filter(ok).select(*self.keys, *[F.col(f"__row.{c}").alias(c) for c in rest])

    def _stage(self, df: DataFrame, name: str) -> None:
        (df.repartition(self.BUCKET).write.mode("overwrite").partitionBy(self.BUCKET)
         .parquet(f"{self.path}/{name}"))

    def _swap_in(self, rows: DataFrame, touched: list[int]) -> None:
        """Replaces the touched buckets by ``rows``."""
        stage = f"_stage-{uuid.uuid4().hex}"
        data = rows.drop(self.BUCKET)
        self._stage(rows.select(*data.columns, self.BUCKET), stage)
        fs = self._fs()[1]
        empty = [b for b in touched if not fs.exists(self._p(stage, f"{self.BUCKET}={b}"))]
        table = {"buckets": self.buckets, "schema": json.loads(data.schema.json())}
        self._put(json.dumps({"buckets": touched, "empty": empty, "table": table}), stage, "_swap.json")
        self._recover()

    def upsert(self, batch: DataFrame) -> None:
        """Merge a batch (S10).  Within the batch the last row per key wins when
        ``seq_cols`` order it (A2); else different rows of one key are an error."""
        exists = self.exists()
        if exists:
            stored = self._read_all()
        batch = self._with_bucket(self._one_per_key(batch))
        # evaluated once: its buckets are found on the staged copy
        held = f"_batch-{uuid.uuid4().hex}"
        self._stage(batch, held)
        try:
            batch = self.spark.read.schema(batch.schema).parquet(f"{self.path}/{held}").select(*batch.columns)
            touched = self._buckets_of(batch)
            if exists:
                if not touched:
                    return
                old = stored.filter(F.col(self.BUCKET).isin(touched))
                batch = merge_upsert(old, batch, [*self.keys, self.BUCKET])
            self._swap_in(batch, touched)
        finally:
            self._fs()[1].delete(self._p(held), True)

    def delete(self, keys_df: DataFrame) -> None:
        """Keyed delete (S11) of the given keys."""
        if not self.exists():
            return
        stored = self._read_all()
        gone = self._with_bucket(keys_df.select(*self.keys))
        touched = self._buckets_of(gone)
        if touched:
            self._swap_in(keyed_delete(stored.filter(F.col(self.BUCKET).isin(touched)), gone, [*self.keys, self.BUCKET]), touched)

    def append_new(self, batch: DataFrame) -> int:
        """Append only rows whose key is not yet stored; returns how
        many were appended (observed on the write itself).  New columns join the
        table's schema (NULL in the rows before), others take its types."""
        exists = self.exists()
        if exists:
            stored = self._read_all()
        batch = self._with_bucket(self._one_per_key(batch))
        if exists:
            batch = batch.join(stored.select(*self.keys, self.BUCKET), [*self.keys, self.BUCKET], "left_anti")
            schema = StructType.fromJson(self._table()["schema"])
            more = [f for f in batch.schema if f.name not in (*schema.names, self.BUCKET)]
            for f in more:
                schema = schema.add(f.name, f.dataType)
            if more:      # recorded first: until the rows are there the column is NULL
                self._put(json.dumps({"buckets": self.buckets, "schema": json.loads(schema.json())}), "_table.json")
            batch = batch.select(*[(F.col(f"`{f.name}`") if f.name in batch.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema],
                                 self.BUCKET)
        else:
            self._put(json.dumps({"buckets": self.buckets, "schema": json.loads(batch.drop(self.BUCKET).schema.json())}), "_table.json")
        obs = Observation(f"appended_{uuid.uuid4().hex}")
        (batch.observe(obs, F.count(F.lit(1)).alias("rows")).repartition(self.BUCKET)
         .write.mode("append").partitionBy(self.BUCKET).parquet(self.path))
        return int(obs.get.get("rows", 0))


def delete_entries(keys_df: DataFrame, *tables: KeyedTable) -> None:
    """S11 with what hangs on an entry: the same keys go from the entry table
    and from its content, embedding and enrichment tables.  Re-running it after
    a crash finishes the rest."""
    for t in tables:
        t.delete(keys_df)


def content_table(spark: SparkSession, path: str) -> KeyedTable:
    """Markdown content per entry; empty content is never stored."""
    return KeyedTable(spark, path, ["partition_key", "row_key"])


def embedding_table(spark: SparkSession, path: str) -> KeyedTable:
    """``array<float>`` embedding per entry; missing → NULL on join."""
    return KeyedTable(spark, path, ["partition_key", "row_key"])


def state_table(spark: SparkSession, path: str) -> KeyedTable:
    """Ingestion state (T2): one row per feed, ``last_ingestion``."""
    return KeyedTable(spark, path, ["feed_id"], partition_col="state")


def save_content(table: KeyedTable, rows: DataFrame) -> None:
    """S7 write: non-empty content only."""
    c = F.col("content")
    table.upsert(rows.filter(c.isNotNull() & (c != "") & (c != fixed.MISSING_CONTENT_SENTINEL)))


def create_posts(spark: SparkSession, raw: DataFrame, path: str, quarantine_path: str | None = None) -> DataFrame:
    """Validate post drafts (V4, V15–V17, F12), key them (F3) and
    upsert the good ones by (yyyy-MM, key); bad ones go to the quarantine.
    Returns the stored rows."""
    from ..operators.entities import build_posts
    from ..operators.validate import post_rules, validate
    v = validate(build_posts(raw), post_rules())
    good = v.filter(F.size("violations") == 0).drop("violations")
    if quarantine_path:
        quarantine_rows(v, quarantine_path)
    KeyedTable(spark, path, ["partition_key", "row_key"]).upsert(good)
    return good


def quarantine_rows(validated: DataFrame, path: str) -> None:
    """Rows that break a rule, appended once: a row that is there already (same
    values, same violations) is not added by a re-run."""
    spark = validated.sparkSession
    text = lambda df: F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in sorted(df.columns)])
    bad = validated.filter(F.size("violations") > 0)
    bad = bad.withColumn("__h", text(bad))
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    if hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
        old = spark.read.schema(validated.schema).parquet(path)
        bad = bad.join(old.select(text(old).alias("__h")), "__h", "left_anti")
    bad.drop("__h").write.mode("append").parquet(path)


def publish_new_rows(rows: DataFrame, list_path: str, rename: dict[str, str], rules: dict,
                     quarantine_path: str | None = None, key: str = "Entry_ID") -> int:
    """S14 (with J1 and P7): list rows that pass the list's rules and whose
    key is not in the list yet are appended under the list's internal
    column names; rows breaking a rule go to the quarantine instead of
    stopping the others.  Returns how many rows were appended."""
    from ..operators.conform import rename_columns
    from ..operators.validate import validate
    spark = rows.sparkSession
    v = validate(rows, rules)
    good = v.filter(F.size("violations") == 0).drop("violations")
    if quarantine_path:
        quarantine_rows(v, quarantine_path)
    out = rename_columns(good, rename)
    internal_key = rename.get(key, key)
    out = last_write_wins(out, [internal_key], [c for c in out.columns if c != internal_key
                                                and out.schema[c].dataType.typeName() != "map"])
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(list_path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hpath):
        existing = spark.read.parquet(list_path).select(F.col(internal_key).alias("__k"))
        out = out.join(existing, out[internal_key] == existing["__k"], "left_anti")
    obs = Observation(f"published_{uuid.uuid4().hex}")
    out.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(list_path)
    return int(obs.get.get("rows", 0))
