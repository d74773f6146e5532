r"""Substring dedup by prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one document.  A word goes if a window
that covers it also starts in a document with a smaller id.

Which suffixes can repeat.  A window is found by its anchor: of its runs of ``SHORT``
words the one with the smallest hash, the leftmost of equals.  Equal windows have
equal anchors at equal places, so only anchors that two different texts hold matter;
one aggregate over (anchor, text) finds them.

Prefix groups.  The windows of one anchor in a text start at consecutive words; from
the first to the last word of them is a piece, a bundle of the suffixes that start
there.  Pieces meet by their prefix.  The short prefix is the anchor itself; where it
has more than ``GROUP`` places it is lengthened, first to the whole piece: of equal
pieces only that of the smallest id goes on, every other is a repeat as it stands.  What
is left is broken into its suffixes and meets by whole windows, where the tree is a
single node and needs only its smallest id.  Both are aggregates, so no task holds more
than a batch and a group of the first kind, and a passage that every document holds is
never gathered.

Trees.  A task reads its groups in order, sorts their suffixes and takes the longest
common prefixes of neighbours: runs of neighbours that share d words are the nodes of
depth d of the group's suffix tree.  For every suffix the deepest node of at least
``window`` words that holds a smaller id is the end of a maximal repeat; the piece's
repeats are joined, and those of a document once more.

Exact copies of a text are one text with the smallest of their ids; the others go
whole if they have a window.  Texts are told apart by 64-bit hashes, words of a piece
by their bytes, whole windows by 128-bit hashes.

Defined cases: null text has no words; a text of fewer words than ``window`` keeps
all; rows with a null id (or one that is no integer) come after all others and not
before each other; rows of one id are never before each other; repeated rows each get
a row with the same result; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Table, stored

WINDOW = 13
SHORT = 4            # words of an anchor
GROUP = 2048         # places of an anchor that one task compares
SLICE = 1 << 20      # bytes of a text that are split into words at a time
ROWS = 1 << 17       # of an Arrow batch passed on, and its bytes, about
OUT_BYTES = 1 << 23
LAST = (1 << 63) - 1
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """``text`` in parts that end before white space."""
    at = 0
    while len(text) - at > size:
        cut = SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def hashes(text: bytes) -> np.ndarray:
    """XXH64 of every word."""
    parts = []
    for part in slices(text):
        words = part.split()      # bytes: splits at \x20, \x09-\x0D only
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def anchors(h: np.ndarray, window: int = WINDOW, short: int = SHORT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's word hashes: the anchors of its windows in order, as hashes, and the
    first and last start of each one's windows."""
    n = len(h)
    if n < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    g = np.zeros(n - short + 1, np.uint64)
    for j in range(short):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j:n - short + 1 + j]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    at = np.lib.stride_tricks.sliding_window_view(g, window - short + 1).argmin(axis=1) + np.arange(n - window + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return g[at[first]], first, np.append(first[1:], len(at)) - 1


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _anchor_rows(window: int, short: int):
    """(text, t) -> (g, t, m): anchor, text, places."""

    def each(batches):
        for b in batches:
            gs, ts, ms, held = [], [], [], 0
            for text, t in zip(b.column(0), _longs(b.column(1)).tolist()):
                g, m = np.unique(anchors(hashes(text.as_py()), window, short)[0], return_counts=True)
                gs.append(g), ms.append(m), ts.append(np.full(len(g), t, np.int64))
                held += len(g)
                if held > ROWS:
                    yield batch(gs, ts, ms)
                    gs, ts, ms, held = [], [], [], 0
            if held:
                yield batch(gs, ts, ms)

    def batch(gs, ts, ms):
        return pa.record_batch([pa.array(np.concatenate(gs).view(np.int64)), pa.array(np.concatenate(ts)),
                                pa.array(np.concatenate(ms).astype(np.int32))], ["g", "t", "m"])

    return each


PIECE_SCHEMA = "g long, w binary, no long, t long, at array<int>, words binary"


def _digest(words: bytes) -> bytes:
    return xxhash.xxh3_128_digest(words)


class _Out:
    """Rows of pieces, passed on in batches of bounded size."""

    def __init__(self, names: list[str], kinds: list[pa.DataType]):
        self.names, self.kinds, self.rows, self.size = names, kinds, [], 0

    def add(self, *row, size: int = 0):
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= ROWS or self.size > OUT_BYTES:
            yield from self.rest()

    def rest(self):
        if self.rows:
            cols = [pa.array(c, k) for c, k in zip(zip(*self.rows), self.kinds)]
            self.rows, self.size = [], 0
            yield pa.record_batch(cols, self.names)


def _piece_rows(window: int, short: int):
    """(text, t, no, few, many) -> the pieces of a text's short prefixes, by anchor, and
    those of its long ones, equal ones of a text as one row."""

    def each(batches):
        out = _Out(["g", "w", "no", "t", "at", "words"], [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()])
        for b in batches:
            for text, t, no, few, many in zip(b.column(0), *(_longs(b.column(i)).tolist() for i in (1, 2)), b.column(3), b.column(4)):
                text = text.as_py()
                g, first, last = anchors(hashes(text), window, short)
                few, many = (np.asarray(x.values, np.int64).view(np.uint64) for x in (few, many))
                words = [w for part in slices(text) for w in part.split()]
                for i in np.flatnonzero(np.isin(g, few)).tolist():
                    piece = b" ".join(words[first[i]:last[i] + window])
                    yield from out.add(int(g[i].view(np.int64)), None, no, t, [first[i]], piece, size=len(piece))
                places: dict[bytes, list[int]] = {}
                for i in np.flatnonzero(np.isin(g, many)).tolist():
                    places.setdefault(b" ".join(words[first[i]:last[i] + window]), []).append(first[i])
                for piece, at in places.items():
                    yield from out.add(None, _digest(piece), no, t, at, piece, size=len(piece) + 4 * len(at))
            yield from out.rest()

    return each


def _window_rows(window: int):
    """(no, t, at, words) -> the windows of pieces, with their places."""

    def each(batches):
        out = _Out(["w", "no", "t", "at"], [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32())])
        for b in batches:
            for no, t, at, piece in zip(*(_longs(b.column(i)).tolist() for i in (0, 1)), b.column(2), b.column(3)):
                words, at = piece.as_py().split(b" "), np.asarray(at.values)
                for i in range(len(words) - window + 1):
                    yield from out.add(_digest(b" ".join(words[i:i + window])), no, t, at + i, size=4 * len(at))
            yield from out.rest()

    return each


def tree_repeats(group: np.ndarray, no: np.ndarray, at: np.ndarray, pieces: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole groups of pieces: those that hold a repeat of a smaller id, and its first and last (exclusive) word."""
    lists = [p.split(b" ") for p in pieces]
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    word = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    starts = size - window + 1                               # suffixes of a piece with a whole window
    piece = np.repeat(np.arange(len(lists)), starts)
    skip = np.arange(len(piece)) - np.repeat(np.cumsum(starts) - starts, starts)
    depth = int(size.max(initial=window))
    place = begin[piece, None] + skip[:, None] + np.arange(depth)
    inside = place < (begin + size)[piece, None]
    # beyond its end a suffix shares nothing with any other
    suffix = np.where(inside, word[np.minimum(place, len(word) - 1)], -1 - np.arange(len(piece))[:, None])
    order = np.lexsort([*suffix.T[::-1], group[piece]])
    suffix, piece, skip = suffix[order], piece[order], skip[order]
    same = (suffix[1:] == suffix[:-1]) & (group[piece][1:] == group[piece][:-1])[:, None]
    shared = np.concatenate(([0], np.where(same.all(axis=1), depth, same.argmin(axis=1)))) if len(piece) else np.empty(0, np.int64)
    own, found = no[piece], np.zeros(len(piece), np.int64)
    for d in range(window, depth + 1):
        node = np.flatnonzero(shared < d)                    # the first leaf of each node of this depth
        if len(node) == len(piece):
            break
        low = np.repeat(np.minimum.reduceat(own, node), np.diff(np.append(node, len(piece))))
        found[low < own] = d
    hit = found > 0
    first, last = np.full(len(lists), LAST), np.zeros(len(lists), np.int64)
    np.minimum.at(first, piece[hit], at[piece[hit]] + skip[hit])
    np.maximum.at(last, piece[hit], at[piece[hit]] + skip[hit] + found[hit])
    hits = np.flatnonzero(last)
    return hits, first[hits], last[hits]


def _trees(window: int):
    """Pieces in the order of their prefix -> (no, t, s, e)."""

    def each(batches):
        held = None
        for b in batches:
            table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            g = table.column("g").to_numpy()
            open_at = int(np.searchsorted(g, g[-1])) if len(g) else 0
            held = table.slice(open_at)
            if open_at:
                yield from found(table.slice(0, open_at))
        if held is not None and held.num_rows:
            yield from found(held)

    def found(table):
        col = {c: table.column(c).to_numpy() for c in ("g", "no", "t", "at")}
        hits, first, last = tree_repeats(col["g"], col["no"], col["at"].astype(np.int64), table.column("words").to_pylist(), window)
        if len(hits):
            yield pa.record_batch([pa.array(col["no"][hits]), pa.array(col["t"][hits]), pa.array(first.astype(np.int32)),
                                   pa.array(last.astype(np.int32))], ["no", "t", "s", "e"])

    return each


def _numbered(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(*more, text.cast("binary").alias("__text"), F.xxhash64(text).alias("__t"),
                       F.coalesce(F.col(f"`{id_col}`").try_cast("long"), F.lit(LAST)).alias("__no"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, short: int = SHORT,
            group: int = GROUP) -> DataFrame:
    """(no, t, s, e): for each text (its hash t, the smallest id no) the word ranges that
    repeat one of a smaller id; ranges may overlap.  Other copies of a text have none."""
    rows = _numbered(docs, id_col, text_col)
    grams = Table(rows.select("__text", "__t").mapInArrow(_anchor_rows(window, short), "g long, t long, m int"), "substring-anchors")
    shared = (grams.df.groupBy("g").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.sum("m").alias("n"))
              .where("lo < hi").select("g", (F.col("n") > group).alias("long")))
    wanted = (grams.df.select("g", "t").join(shared, "g").groupBy("t")
              .agg(F.collect_set(F.when(~F.col("long"), F.col("g"))).alias("few"), F.collect_set(F.when(F.col("long"), F.col("g"))).alias("many")))
    first = rows.groupBy(F.col("__t").alias("t")).agg(F.min("__no").alias("no"))
    wanted = stored(wanted.join(first, "t"), "substring-texts")
    grams.drop()
    # of repeated rows one is enough, but all give the same
    read = rows.join(wanted, (F.col("__t") == F.col("t")) & (F.col("__no") == F.col("no"))).select("__text", "t", "no", "few", "many")
    pieces = Table(read.mapInArrow(_piece_rows(window, short), PIECE_SCHEMA), "substring-pieces")
    bundles = pieces.df.where("g is not null").select("g", "no", "t", F.get("at", F.lit(0)).alias("at"), "words")
    trees = bundles.repartition("g").sortWithinPartitions("g").mapInArrow(_trees(window), "no long, t long, s int, e int")
    low, later = _lowest(pieces.df.where("w is not null"))
    size = F.size(F.split(F.col("words").cast("string"), " "))
    copies = later.select("no", "t", F.explode("at").alias("s"), size.alias("n")).select("no", "t", "s", (F.col("s") + F.col("n")).alias("e"))
    windows = Table(low.select("no", "t", "at", "words").mapInArrow(_window_rows(window), "w binary, no long, t long, at array<int>"), "substring-windows")
    found = _lowest(windows.df)[1].select("no", "t", F.explode("at").alias("s")).select("no", "t", "s", (F.col("s") + window).alias("e"))
    out = stored(trees.unionByName(copies).unionByName(found), "substring-repeats")
    pieces.drop()
    windows.drop()
    return out


def _lowest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with the smallest no of their w, and the others."""
    marked = rows.join(rows.groupBy("w").agg(F.min("no").alias("low")), "w")
    return marked.where("no = low"), marked.where("no > low")


def _kept(window: int):

    @arrow_udf("struct<n_words:long,n_removed:long,kept:string>")
    def kept(text: pa.Array, ranges: pa.Array, whole: pa.Array) -> pa.Array:
        n_words, n_removed, out = [], [], []
        for t, r, all_of_it in zip(text, ranges, whole.to_pylist()):
            words = [w for part in slices(t.as_py()) for w in part.split()]
            gone = 0
            if all_of_it and len(words) >= window:
                keep, gone = [], len(words)
            elif r.is_valid and len(r.values):
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, r.values.field("s").to_numpy(), 1)
                np.add.at(edge, r.values.field("e").to_numpy(), -1)
                stays = np.cumsum(edge[:-1]) == 0
                keep = [words[i] for i in np.flatnonzero(stays).tolist()]
                gone = len(words) - len(keep)
            else:
                keep = words
            n_words.append(len(words)), n_removed.append(gone), out.append(b" ".join(keep))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                           pa.array(out, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept"])

    return kept


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, short: int = SHORT,
                   group: int = GROUP) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: the words that stay, joined by one space."""
    found = repeats(docs, id_col, text_col, window, short, group)
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    rows = _numbered(docs, id_col, text_col, *own)
    ranges = found.groupBy("t", "no").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    first = rows.groupBy(F.col("__t").alias("t")).agg(F.min("__no").alias("no"), F.max("__no").alias("__last"))
    marks = first.join(ranges, ["t", "no"], "left").where("ranges is not null or no < __last").select(
        F.col("t").alias("__mt"), F.col("no").alias("__first"), F.col("ranges").alias("__ranges"))
    rows = rows.join(marks, F.col("__t") == F.col("__mt"), "left")
    none = F.lit(None).cast("array<struct<s:int,e:int>>")
    copy = F.coalesce(F.col("__no") > F.col("__first"), F.lit(False))
    rows = rows.withColumn("__kept", _kept(window)(F.col("__text"), F.when(copy, none).otherwise(F.col("__ranges")), copy))
    return rows.select(*own, *[F.col(f"__kept.{c}").alias(c) for c in ("n_words", "n_removed", "kept")])
