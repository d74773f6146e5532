"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit set where over half of the text's shingle hashes have
it.  Two fingerprints link at ``radius`` or fewer differing bits.

Candidates come from 2^(radius+1) - 1 masks.  Every bit position gets a vector
of radius+1 bits; the mask of a nonzero vector v drops the positions whose
vector is orthogonal to v (over GF(2)).  The vectors of at most ``radius``
differing positions cannot span the space, so some v is orthogonal to all of
them: its mask drops them all and both fingerprints are equal under it.  Every pair within the radius
therefore meets in some table; none is lost, whatever the data.

Exact copies are folded first (one row per distinct fingerprint).  A bucket's
members are compared in a sorted stream; what is emitted is a spanning forest
of its links, never its pairs.  A bucket above ``CHUNK`` members is dealt out
in pairs of chunks to as many tasks, so that no task holds more than two chunks.

Defined cases: null text and text without words have fingerprint zero and link
like any other; repeated rows each get a row; rows with a null id get a
fingerprint and the smallest non-null id reachable (null if there is none); an
empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import BROADCAST_BYTES, Table, broadcast_within, stored
from .components import components

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
CHUNK = 4096
SLICE = 1 << 16


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text, unsigned."""
    words = text.lower().split()     # bytes: folds A-Z and splits at \\x20, \\x09-\\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(starts)
    for lo in range(0, n, SLICE):
        s, e = starts[lo:lo + SLICE].tolist(), ends[lo:lo + SLICE].tolist()
        h = np.fromiter((digest(view[i:j], SEED) for i, j in zip(s, e)), "<u8", len(s))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp): one row per row of ``docs``; fp as a signed long."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))

    def each(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py() or b"", width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(each, "id long, fp long")


def masks(radius: int = RADIUS) -> np.ndarray:
    """The 2^(radius+1)-1 masks.  Positions get the nonzero vectors in turn, so
    that every mask keeps nearly half of the bits."""
    dim = radius + 1
    vec = np.arange(BITS) % (2 ** dim - 1) + 1
    keep = np.array([[bin(v & u).count("1") % 2 == 1 for u in vec.tolist()] for v in range(1, 2 ** dim)])
    return (keep.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _forest(fps: np.ndarray, radius: int, first: int | None = None):
    """Links (a, b) that span the components of ``fps`` at ``radius``; with
    ``first``, only links between the first so many and the rest."""
    n = len(fps)
    todo = np.ones(n, bool)
    out_a, out_b = [], []
    for root in range(n):
        if not todo[root]:
            continue
        todo[root] = False
        stack = [root]
        while stack:
            i = stack.pop()
            rest = np.flatnonzero(todo)
            if first is not None:
                rest = rest[rest >= first] if i < first else rest[rest < first]
            near = rest[np.bitwise_count(fps[rest] ^ fps[i]) <= radius]
            if len(near):
                todo[near] = False
                out_a.append(np.full(len(near), fps[i], np.uint64))
                out_b.append(fps[near])
                stack.extend(near.tolist())
    if not out_a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _link_batch(a: np.ndarray, b: np.ndarray):
    none = np.full(len(a), -1, np.int32)
    return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                            pa.array(none, mask=np.ones(len(a), bool)), pa.array(np.zeros(len(a), np.int64)),
                            pa.array(none, mask=np.ones(len(a), bool))], ["a", "b", "t", "k", "chunk"])


LINK_SCHEMA = "a long, b long, t int, k long, chunk int"


def _scan(radius: int, chunk: int):
    """Over rows sorted by (table, key, fp): links of small buckets, and the
    members of large ones with their chunk number."""

    def each(batches):
        held, key, parts = np.empty(0, np.uint64), None, 0   # members of the open bucket, its key, chunks passed on

        def close(fps, parts, key):
            if parts:
                yield part(fps, key, parts)
            elif len(fps) == 2:
                if np.bitwise_count(fps[0] ^ fps[1]) <= radius:
                    yield fps[:1], fps[1:]
            elif len(fps) > 2:
                yield _forest(fps, radius)

        def part(fps, key, no):
            n = len(fps)
            return pa.record_batch([pa.array(fps.view(np.int64)), pa.array(np.zeros(n, np.int64), mask=np.ones(n, bool)),
                                    pa.array(np.full(n, key[0], np.int32)), pa.array(np.full(n, key[1], np.int64)),
                                    pa.array(np.full(n, no, np.int32))], ["a", "b", "t", "k", "chunk"])

        for batch in batches:
            t, k = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            fp = np.asarray(batch.column(2)).view(np.uint64)
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            bounds = np.concatenate(([0], cut, [len(t)]))
            sizes = np.diff(bounds)
            la, lb = [], []
            # buckets that neither open nor end the batch and have one member hold no link
            some = np.flatnonzero(sizes > 1)
            for g in sorted({0, len(sizes) - 1, *some.tolist()}):
                lo, hi = int(bounds[g]), int(bounds[g + 1])
                at = (int(t[lo]), int(k[lo]))
                if at != key:
                    for x in close(held, parts, key) if key is not None else ():
                        if isinstance(x, tuple):
                            la.append(x[0]), lb.append(x[1])
                        else:
                            yield x
                    held, key, parts = np.empty(0, np.uint64), at, 0
                held = np.concatenate((held, fp[lo:hi]))
                while len(held) > chunk:
                    yield part(held[:chunk], key, parts)
                    held, parts = held[chunk:], parts + 1
            if la:
                yield _link_batch(np.concatenate(la), np.concatenate(lb))
        if key is not None:
            for x in close(held, parts, key):
                yield _link_batch(*x) if isinstance(x, tuple) else x

    return each


def links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``distinct`` (fp) -> links (a, b) that span every component at ``radius``."""
    ms = [int(m) for m in masks(radius).view(np.int64)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in ms])).alias("t", "k"))
    sorted_rows = keyed.select("t", "k", "fp").repartition("t", "k").sortWithinPartitions("t", "k", "fp")
    found = stored(sorted_rows.mapInArrow(_scan(radius, chunk), LINK_SCHEMA), "simhash-links")
    small = found.where("chunk is null").select("a", "b")
    large = found.where("chunk is not null").select("t", "k", "chunk", F.col("a").alias("fp"))
    last = large.groupBy("t", "k").agg(F.max("chunk").alias("last"))
    # a chunk goes to its pairs (itself, j) and (i, itself)
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("o")
    dealt = (large.join(last, ["t", "k"]).select("t", "k", "chunk", "fp", other)
             .select("t", "k", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "fp"))

    def pair(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        own = table.column("chunk").to_numpy() == table.column("i").to_numpy()
        if own.all():
            a, b = _forest(fp, radius)
        else:
            a, b = _forest(np.concatenate((fp[own], fp[~own])), radius, first=int(own.sum()))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return small.unionByName(dealt.groupBy("t", "k", "i", "j").applyInArrow(pair, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): per row its fingerprint and the smallest id that it
    reaches through links, its own included."""
    marked = stored(fingerprints(docs, id_col, text_col, width), "simhash-docs")
    distinct = stored(marked.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius))
    classed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    lowest = classed.groupBy("root").agg(F.min("low").alias("component"))
    by_fp = classed.join(lowest, "root").select("fp", "component")
    return marked.join(by_fp, "fp").select("id", "fp", "component")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id (of
    repeated rows one; without any id, one per fingerprint)."""
    found = near_duplicates(docs, id_col, text_col, width, radius)
    kept = Table(found.where(F.col("id").eqNullSafe(F.col("component"))).groupBy("id", "fp").agg(F.count("*").alias("n")), "simhash-kept")
    odd = kept.df.where("n > 1 or id is null").limit(1).count() or kept.df.groupBy("id").count().where("count > 1").limit(1).count()
    if odd:
        return _one_of_repeated(docs, kept.df.select("id", "fp"), id_col, text_col, width)
    own = [F.col(f"`{c}`") for c in docs.columns]
    ids = broadcast_within(kept, BROADCAST_BYTES).select(F.col("id").alias("__kept"))
    chosen = docs.join(ids, F.col(f"`{id_col}`") == F.col("__kept"), "left_semi").select(*own)
    if chosen.select(F.col(f"`{id_col}`")).count() > kept.df.count():       # an id repeats in a component that another represents
        return _one_of_repeated(docs, kept.df.select("id", "fp"), id_col, text_col, width)
    return chosen


def _one_of_repeated(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """The same where ids are null or repeat: of rows that share id and
    fingerprint the first by a hash of all columns stays."""

    @arrow_udf("long")
    def fp_of(t: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(x.as_py() or b"", width) for x in t.cast(pa.binary())), np.uint64, len(t)).view(np.int64))

    own = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(*own, fp_of(F.col(f"`{text_col}`")).alias("__fp"), F.xxhash64(*own).alias("__row"))
    low = F.row_number().over(Window.partitionBy("__id", "__fp").orderBy("__row"))
    return (marked.withColumn("__id", F.col(f"`{id_col}`").cast("long"))
            .join(kept.select(F.col("id").alias("__k"), F.col("fp").alias("__kfp")),
                  F.col("__id").eqNullSafe(F.col("__k")) & (F.col("__fp") == F.col("__kfp")), "left_semi")
            .withColumn("__n", low).where("__n = 1").select(*own))
