"""Vector code compression: product quantisation by dual-tree Lloyd rounds.

Components become integers floor(``scale`` x); a vector is cut into ``parts`` equal
parts, each with a codebook of ``entries`` entries.  A round assigns every part to
its nearest entry (squared Euclidean distance, ties to the lower index) and moves each
entry to the floor of its parts' mean; entries without parts stay.

Rows are gathered into blocks once.  For each part position a block gets a tree over
its parts, halved at the median of the widest side; the parts are written to the shared
folder in the order of the tree's leaves.  A round reads the blocks; every node's
bounding box and the sum of its parts come from one pass over that order.  Codebooks (``parts`` x ``entries`` vectors) get a tree of their own, and both
trees are descended together, level by level, with the pairs (node of parts, node of
entries) still open:

* a pair whose least distance exceeds the node's smallest greatest distance to any
  entries is dropped;
* an entry is dropped if another is nearer, or as near with a lower index, at every
  corner of the node's box;
* a node with one entry left is assigned whole, by its cached sum;
* in the last level the parts of open nodes are compared with the entries left.

All of it is integer arithmetic, so the codes are those of the plain method.  A task
gives one sum and count for each part and entry; the grouped sums of a round
(``parts`` x ``entries`` rows) make the next codebooks on the driver.

Defined cases: vectors that are null, empty, hold a null, non-finite or, after scaling,
not below 2^26 component, or are of another length than the most common one (the
smaller of equally common) take no part; a length that ``parts`` does not divide is
filled up with zeros; the first codebooks are the vectors of the smallest ids, null ids
last and repeated ids by their components (fewer rows, fewer entries); an empty table
gives no rows; other columns are only carried where ``carry`` names them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096.0
BLOCK = 16384        # vectors of a block
BLOCK_VALUES = 1 << 22       # and its components at most
LEAF = 16            # parts of a node in the last level, about
LIMIT = 1 << 26


@dataclass
class Codebooks:
    entries: np.ndarray      # (parts, entries, width), integers
    length: int              # of the vectors
    scale: float

    def text(self, i: int | None = None) -> str:
        """All integers by part, entry and place, joined by commas."""
        return ",".join(map(str, (self.entries if i is None else self.entries[i]).ravel().tolist()))


# --- trees ---

def _cuts(n: int, level: int) -> np.ndarray:
    """Bounds of the 2^level nodes of a tree over n points."""
    return (n * np.arange((1 << level) + 1)) >> level


def _levels(n: int, leaf: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, n) / leaf))))


class Tree:
    """A balanced tree over points (n, width), kept in the order of its leaves."""

    def __init__(self, points: np.ndarray, leaf: int, order: np.ndarray | None = None):
        n = len(points)
        self.levels = _levels(n, leaf)
        if order is None:
            order = np.arange(n)
            for level in range(self.levels):
                cut = _cuts(n, level)
                size = np.diff(cut)
                full = np.flatnonzero(size)
                low, high = (f.reduceat(points[order], cut[full], axis=0) for f in (np.minimum, np.maximum))
                widest = (high - low).argmax(axis=1)
                node = np.repeat(np.arange(len(full)), size[full])
                order = order[np.lexsort((points[order, widest[node]], node))]
        self.order, self.points = order, points[order]
        self.cut = [_cuts(n, k) for k in range(self.levels + 1)]
        self.low, self.high, self.sum = [], [], []
        total = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0)))
        for cut in self.cut:
            at = np.minimum(cut[:-1], n - 1)        # an empty node (only in trees of entries) borrows a point and is never reached
            self.low.append(np.minimum.reduceat(self.points, at, axis=0))
            self.high.append(np.maximum.reduceat(self.points, at, axis=0))
            self.sum.append(total[cut[1:]] - total[cut[:-1]])


def _runs(node: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))


def assign(tree: Tree, book: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | int, np.ndarray | None]]:
    """Descends ``tree`` and a tree over ``book`` together.  Yields (level, node, entry,
    None) for nodes assigned whole, as arrays, and last (-1, points, entries, distances)
    for the single parts."""
    own = Tree(book, 1)
    depth = 0, 0
    nodes, rivals = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        p, e = depth
        low, high = tree.low[p][nodes], tree.high[p][nodes]
        elow, ehigh = own.low[e][rivals], own.high[e][rivals]
        least = (np.maximum(0, np.maximum(low - ehigh, elow - high)) ** 2).sum(axis=1)
        most = (np.maximum(np.abs(high - elow), np.abs(ehigh - low)) ** 2).sum(axis=1)
        runs = _runs(nodes)
        bound = np.repeat(np.minimum.reduceat(most, runs), np.diff(np.append(runs, len(nodes))))
        keep = least <= bound
        nodes, rivals, most = nodes[keep], rivals[keep], most[keep]
        if e == own.levels:
            entry = own.order[own.cut[e][rivals]]
            # the rival of each node is the entry with the smallest greatest distance, the lowest index of equals
            runs = _runs(nodes)
            size = np.diff(np.append(runs, len(nodes)))
            first = np.lexsort((entry, most, nodes))[runs]
            best = np.repeat(entry[first], size)
            low, high = tree.low[p][nodes], tree.high[p][nodes]
            a, b = book[best], book[entry]
            # the greatest |x - a|^2 - |x - b|^2 in the box
            lead = (a ** 2 - b ** 2).sum(axis=1) + 2 * np.where(b > a, (b - a) * high, (b - a) * low).sum(axis=1)
            keep = (entry == best) | (lead > 0) | ((lead == 0) & (entry < best))
            nodes, rivals, entry = nodes[keep], rivals[keep], entry[keep]
            runs = _runs(nodes)
            alone = np.diff(np.append(runs, len(nodes))) == 1
            if alone.any():
                yield p, nodes[runs[alone]], entry[runs[alone]], None
                rest = ~np.repeat(alone, np.diff(np.append(runs, len(nodes))))
                nodes, rivals, entry = nodes[rest], rivals[rest], entry[rest]
            if not len(nodes):
                return
            if p == tree.levels:
                break
        # both trees go down by a level
        if p < tree.levels:
            nodes, rivals = (2 * nodes[:, None] + [0, 1]).ravel(), np.repeat(rivals, 2)
            p += 1
        if e < own.levels:
            nodes, rivals = np.repeat(nodes, 2), (2 * rivals[:, None] + [0, 1]).ravel()
            e += 1
            full = own.cut[e][rivals + 1] > own.cut[e][rivals]
            nodes, rivals = nodes[full], rivals[full]
        order = np.argsort(nodes, kind="stable")
        nodes, rivals = nodes[order], rivals[order]
        depth = p, e
    cut = tree.cut[tree.levels]
    size = (cut[1:] - cut[:-1])[nodes]
    pair = np.repeat(np.arange(len(nodes)), size)
    point = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + cut[nodes][pair]
    far = ((tree.points[point] - book[entry[pair]]) ** 2).sum(axis=1)
    best = np.lexsort((entry[pair], far, point))
    best = best[_runs(point[best])]
    yield -1, point[best], entry[pair][best], far[best]


# --- blocks ---

def _usable(c: Column, scale: float) -> Column:
    ok = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < float(LIMIT)))
    return c.isNotNull() & (F.size(c) > 0) & ok


def _integers(values: np.ndarray, length: int, parts: int) -> np.ndarray:
    """(n * length) integers -> (parts, n, width), filled up with zeros."""
    width = -(-length // parts)
    x = np.zeros((len(values) // length, parts * width), np.int64)
    x[:, :length] = values.reshape(-1, length)
    return np.ascontiguousarray(x.reshape(len(x), parts, width).transpose(1, 0, 2))


def _block_rows(length: int, parts: int):
    """(row, ints) -> a row per block: its rows, and for each part the points and their order."""
    size = max(1, min(BLOCK, BLOCK_VALUES // length))

    def block(rows: pa.Array, x: np.ndarray):
        trees = [Tree(p, LEAF) for p in _integers(x, length, parts)]
        points = np.concatenate([t.points.ravel() for t in trees]).astype(np.int32)
        order = np.concatenate([t.order for t in trees]).astype(np.int32)
        return pa.record_batch([pa.array([len(rows)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                                pa.array([points.tobytes()], pa.binary()), pa.array([order.tobytes()], pa.binary())], ["n", "rows", "points", "order"])

    def each(batches):
        held, values, n = [], [], 0
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                held.append(part.column(0))
                values.append(np.asarray(part.column(1).flatten(), np.int64))
                n += part.num_rows
                if n >= size:
                    rows, x = pa.concat_arrays(held), np.concatenate(values)
                    yield block(rows.slice(0, size), x[:size * length])
                    held, values, n = [rows.slice(size)], [x[size * length:]], n - size
        if n:
            yield block(pa.concat_arrays(held), np.concatenate(values))

    return each


def _trees(n: int, points: bytes, order: bytes, parts: int) -> list[Tree]:
    """The block's trees; their order is known, so boxes and sums are one pass."""
    p = np.frombuffer(points, np.int32).astype(np.int64).reshape(parts, n, -1)
    o = np.frombuffer(order, np.int32).reshape(parts, n)
    out = []
    for x, at in zip(p, o):
        t = Tree(x, LEAF, np.arange(n))
        t.order = at
        out.append(t)
    return out


class Blocks:
    """The blocks of a table, written once."""

    def __init__(self, table: DataFrame, id_col: str, vector_col: str, parts: int, scale: float, carry: Sequence[str]):
        vec = F.col(f"`{vector_col}`").cast("array<double>")
        carried = F.struct(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
        rows = table.select(carried.alias("row"), vec.alias("v")).where(_usable(F.col("v"), scale))
        common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        self.parts, self.scale, self.length = parts, scale, common["n"] if common else 0
        floors = F.transform("v", lambda x: F.floor(x * F.lit(scale)))
        self.rows = rows.where(F.size("v") == self.length).select("row", floors.alias("x"))
        self.row_type = self.rows.schema["row"].dataType.simpleString()
        if common:
            made = self.rows.mapInArrow(_block_rows(self.length, parts), f"n int, rows array<{self.row_type}>, points binary, order binary")
            self.df = stored(made, "code-blocks")


def fit(blocks: Blocks, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """The codebooks after ``rounds`` rounds; None without rows."""
    if not blocks.length:
        return None
    # the first codebooks: a top-k, so at most ``entries`` rows reach the driver
    first = blocks.rows.orderBy(F.col("row.id").asc_nulls_last(), "x").limit(entries).collect()
    books = _integers(np.array([r["x"] for r in first], np.int64).ravel(), blocks.length, blocks.parts)
    parts = blocks.parts
    for _ in range(rounds):

        def sums(batches, books=books):
            total = np.zeros(books.shape, np.int64)
            count = np.zeros(books.shape[:2], np.int64)
            for b in batches:
                for n, points, order in zip(*(b.column(i).to_pylist() for i in range(3))):
                    for p, tree in enumerate(_trees(n, points, order, parts)):
                        for level, at, entry, _ in assign(tree, books[p]):
                            if level >= 0:
                                np.add.at(total[p], entry, tree.sum[level][at])
                                np.add.at(count[p], entry, np.diff(tree.cut[level])[at])
                            else:
                                np.add.at(total[p], entry, tree.points[at])
                                np.add.at(count[p], entry, 1)
            p, e = np.nonzero(count)
            if len(p):
                sizes = np.arange(0, (len(p) + 1) * books.shape[2], books.shape[2], dtype=np.int32)
                yield pa.record_batch([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]),
                                       pa.ListArray.from_arrays(pa.array(sizes), pa.array(total[p, e].ravel()))], ["p", "e", "n", "x"])

        width = books.shape[2]
        found = (blocks.df.select("n", "points", "order").mapInArrow(sums, "p int, e int, n long, x array<long>").groupBy("p", "e")
                 .agg(F.sum("n").alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"x{i}") for i in range(width)]).collect())
        books = books.copy()
        for r in found:
            books[r["p"], r["e"]] = [r[f"x{i}"] // r["n"] for i in range(width)]
    return Codebooks(books, blocks.length, blocks.scale)


def encode(blocks: Blocks, books: Codebooks, carry: Sequence[str] = ()) -> DataFrame:
    """(row, codes, error) -> id and the carried columns, ``codes`` (an index for each
    part) and ``error`` (the squared distances' sum, in integers)."""
    parts, entries = blocks.parts, books.entries

    def each(batches):
        for b in batches:
            for n, points, order, rows in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                code, error = np.zeros((n, parts), np.int32), np.zeros(n, np.int64)
                for p, tree in enumerate(_trees(n, points, order, parts)):
                    chosen, known = np.zeros(n, np.int64), np.full(n, -1, np.int64)
                    for level, at, entry, far in assign(tree, entries[p]):
                        if level >= 0:
                            size = np.diff(tree.cut[level])[at]
                            place = np.repeat(tree.cut[level][at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                            chosen[place] = np.repeat(entry, size)
                        else:
                            chosen[at], known[at] = entry, far
                    open_ = known < 0
                    known[open_] = ((tree.points[open_] - entries[p][chosen[open_]]) ** 2).sum(axis=1)
                    code[tree.order, p] = chosen
                    error[tree.order] += known
                ends = np.arange(0, (n + 1) * parts, parts, dtype=np.int32)
                yield pa.record_batch([rows.values, pa.ListArray.from_arrays(pa.array(ends), pa.array(code.ravel())), pa.array(error)],
                                      ["row", "codes", "error"])

    out = blocks.df.select("n", "points", "order", "rows").mapInArrow(each, f"row {blocks.row_type}, codes array<int>, error long")
    return out.select("row.id", *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)], "codes", "error")


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: float = SCALE, carry: Sequence[str] = ()) -> tuple[DataFrame, Codebooks | None]:
    """The codes of all usable rows (id, carried columns, codes, error) and the codebooks."""
    blocks = Blocks(table, id_col, vector_col, parts, scale, carry)
    books = fit(blocks, entries, rounds)
    if books is None:
        none = blocks.rows.select("row.id", *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)],
                                  F.lit(None).cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return none.limit(0), None
    return encode(blocks, books, carry), books


def error_by(codes: DataFrame, key: str) -> DataFrame:
    """``codes`` with ``key_error``: the error summed over the rows of an equal key, nulls together."""
    kept = stored(codes, "codes")
    total = Table(kept.groupBy(F.col(f"`{key}`").alias("__key")).agg(F.sum("error").alias("key_error")), "code-errors").df
    return kept.join(total, F.col(f"`{key}`").eqNullSafe(F.col("__key"))).select(*[F.col(f"`{c}`") for c in kept.columns], "key_error")
