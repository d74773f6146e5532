"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected by ``orderings`` random orthonormal maps to ``dims``
dimensions, shifted at random, and put on a Hilbert curve each.  Spark range
partitions the rows by (ordering, key), rows of one cell by a projection of the
ordering's own; a second pass numbers them, so that a query's window is the rows on
either side in each ordering: ``window_share`` of all rows, and ``half_window`` at
least.  Rows and queries meet in blocks of an ordering: a task holds one block of at
most ``BLOCK_ROWS`` and the queries whose window touches it, whatever the data.
Each block gives every query its nearest within the window, by exact
double-precision distance on the original vectors; the orderings' lists are merged
and ranked.

Of equal vectors only the ``k`` + 1 smallest ids are placed, as no other can be
among the ``k`` nearest; a query beyond them has the first ``k`` as its answer.  So
copies of one vector do not fill a window.

Recall against brute force is measured in the tests; it depends on the window and
the number of orderings, not on any training.

Defined cases: vectors that are null, zero, of another length than the most common
one, or hold a null or non-finite component take no part; equal distances are
ordered by id; repeated ids are rows of their own (a query's own id is never its
neighbour); fewer candidates than ``k`` give fewer rows; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Table, broadcast_within, stored

ORDERINGS = 24
DIMS = 8
LEVELS = 7
HALF_WINDOW = 1024
WINDOW_SHARE = 0.02      # of the rows, either way
BLOCK_ROWS = 1 << 16
SPREAD = 6.0      # standard deviations on the grid
SHIFT = 0.08      # of the grid, either way
SEED = 42


def hilbert_keys(cells: np.ndarray, levels: int) -> np.ndarray:
    """Positions on the Hilbert curve of cells (n, dims) with coordinates below
    2**levels, as unsigned integers (dims * levels bits, at most 63): at each level
    from the coarsest, the orthant's Gray rank in the frame of the level above."""
    n, dims = cells.shape
    key = np.zeros(n, np.uint64)
    flip = np.zeros(n, np.int64)      # the frame: orthant bits are XORed by flip, then rotated right by turn
    turn = np.zeros(n, np.int64)
    full = (1 << dims) - 1
    weights = 1 << np.arange(dims)
    for level in range(levels - 1, -1, -1):
        orthant = ((cells >> level) & 1) @ weights
        x = orthant ^ flip
        x = ((x >> turn) | (x << (dims - turn))) & full
        rank = x.copy()                # Gray code to rank
        step = 1
        while step < dims:
            rank ^= rank >> step
            step *= 2
        key = (key << np.uint64(dims)) | rank.astype(np.uint64)
        # the sub-cube's entry point and direction
        before = np.maximum((rank - 1) & ~1, 0)
        entry = before ^ (before >> 1)
        entry[rank == 0] = 0
        ones = np.where(rank % 2 == 0, rank - 1, rank)       # trailing one bits of this number
        direction = np.zeros(n, np.int64)
        probe = np.maximum(ones, 0)
        for _ in range(dims):
            odd = probe & 1 == 1
            if not odd.any():
                break
            direction += odd
            probe = np.where(odd, probe >> 1, 0)
        direction[rank == 0] = 0
        back = ((entry << (turn)) | (entry >> (dims - turn))) & full
        flip = flip ^ back
        turn = (turn + direction % dims + 1) % dims
    return key


def _maps(length: int, orderings: int, dims: int, seed: int):
    rng = np.random.default_rng(seed)
    maps = [np.linalg.qr(rng.standard_normal((length, length)))[0][:, :dims] for _ in range(orderings)]
    return np.stack(maps), rng.uniform(-SHIFT, SHIFT, (orderings, dims))


def _usable(c: Column) -> Column:
    ok = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & ok & F.exists(c, lambda x: x != 0)


def search(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", orderings: int = ORDERINGS,
           dims: int = DIMS, levels: int = LEVELS, half_window: int = HALF_WINDOW,
           window_share: float = WINDOW_SHARE, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): per row with ``is_query`` its ``k`` nearest
    found among all other rows, nearest first; score is the Euclidean distance."""
    vec = F.col(f"`{vector_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    length = common["n"]
    every = rows.where(F.size("v") == length).groupBy("v", "id").agg(F.max("q").alias("q"))
    # a vector's k + 1 smallest ids; a query beyond them is answered by the first k
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    placed = Table(every.withColumn("copy", copy).where(F.col("copy") <= k + 1), "ann-vectors")
    crowded = Table(placed.df.where(F.col("copy") == k + 1).select("v"), "ann-crowded")
    first = Table(placed.df.where(F.col("copy") <= k).join(broadcast_within(crowded, BROADCAST_BYTES), "v", "left_semi")
                  .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ann-first")
    beyond = (every.where("q").select("v", "id").join(broadcast_within(first, BROADCAST_BYTES), "v")
              .join(placed.df.select("v", "id"), ["v", "id"], "left_anti")
              .select(F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), F.lit(0.0).alias("score")))
    rows = placed.df.select("id", "v", "q")
    half_window = max(half_window, math.ceil(window_share * rows.count()))
    # scale of the grid: spread of the components' projections, from the rows' mean square around their mean
    stats = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s")).collect()
    mean = np.array([r["m"] for r in sorted(stats, key=lambda r: r["i"])])
    sigma = max(float(np.sqrt(np.mean([r["s"] for r in stats]))), 1e-30)
    dims = min(dims, length)
    maps, shifts = _maps(length, orderings, dims, seed)
    side = 1 << levels

    def order(batches):
        for b in batches:
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(-1, length)
            packed = pa.array([r.tobytes() for r in x], pa.binary())
            for o in range(orderings):
                u = ((x - mean) @ maps[o]) / (SPREAD * sigma) + 0.5 + shifts[o]
                key = hilbert_keys(np.clip(u * side, 0, side - 1).astype(np.int64), levels)
                yield pa.record_batch([pa.array(np.full(len(x), o, np.int32)), pa.array(key.astype(np.int64)), pa.array(u[:, 0]), b.column(0), packed,
                                       b.column(2)], ["o", "key", "tie", "id", "v", "q"])

    keyed = rows.mapInArrow(order, "o int, key long, tie double, id long, v binary, q boolean")
    # written in range order: partition number and place within it give each row's place in its ordering
    ranged = keyed.repartitionByRange("o", "key", "tie", "id").sortWithinPartitions("o", "key", "tie", "id")
    kept = Table(ranged.select("o", "id", "v", "q", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i")), "ann-order")
    starts = kept.df.groupBy("o", "p").agg(F.min("i").alias("lo"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("o").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(starts.select("o", "p", (before - F.col("lo")).alias("add")), "ann-starts")   # a row per ordering and partition
    numbered = kept.df.join(F.broadcast(starts), ["o", "p"]).select("o", (F.col("i") + F.col("add")).alias("at"), "id", "v", "q")
    size = min(2 * half_window, BLOCK_ROWS)
    member = numbered.select("o", F.floor(F.col("at") / size).alias("block"), "at", "id", "v", F.lit(False).alias("q"))
    touched = F.explode(F.sequence(F.floor((F.col("at") - half_window) / size), F.floor((F.col("at") + half_window) / size))).alias("block")
    asking = numbered.where("q").select("o", touched, "at", "id", "v", "q").where("block >= 0")

    def nearest(part: pa.Table) -> pa.Table:
        q = part.column("q").to_numpy(zero_copy_only=False)
        at, ids = part.column("at").to_numpy(), part.column("id").to_numpy()
        x = np.frombuffer(b"".join(part.column("v").to_pylist()), np.float64).reshape(-1, length)
        base, b_at, b_id = x[~q], at[~q], ids[~q]
        out_q, out_v, out_d = [], [], []
        for i in np.flatnonzero(q):
            near = np.flatnonzero((np.abs(b_at - at[i]) <= half_window) & (b_id != ids[i]))
            d = np.sqrt(((base[near] - x[i]) ** 2).sum(axis=1))
            best = near[np.lexsort((b_id[near], d))[:k]] if len(near) else near
            out_q.append(np.full(len(best), ids[i]))
            out_v.append(b_id[best])
            out_d.append(np.sqrt(((base[best] - x[i]) ** 2).sum(axis=1)))
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table({"query_id": cat(out_q, np.int64), "vec_id": cat(out_v, np.int64), "score": cat(out_d, np.float64)})

    found = (member.unionByName(asking).groupBy("o", "block").applyInArrow(nearest, "query_id long, vec_id long, score double"))
    merged = found.unionByName(beyond).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
