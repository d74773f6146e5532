r"""Benchmark decontamination: a prefix-filtered containment join.

Every item is cut into windows of ``WINDOW`` consecutive words (an item of fewer
words, but not none, is one window).  A document holds a window only if it holds
all of its shingles, so it is enough to look for one: each window's shingles
(single words) are ordered by rarity in the whole corpus, and the rarest one, its
prefix, is joined with the documents' words.  A match fixes where the window would
lie; the positional and length bounds drop windows that would start before the
document or end after it, and the rest are verified word by word.  Words inside a
verified window are hit.

Items stay in tables: their distinct windows, the words of those, the words' counts
over all documents, the windows by their rarest word.  What tasks hold of them is a
bitmap of word hashes, of fixed size whatever the items: it lets through the item
words (for counting), then the prefix words with the words around them (for the
join), and a few others that the joins drop.  Hits are kept by text, so copies share
them.  Frequent words that are some window's rarest meet many windows: these joins
are plain equi-joins that adaptive execution splits.

Defined cases: null texts have no words (never hit, never an item with windows);
repeated rows each get a row; items with equal texts all count; an empty
documents table gives no rows, an empty item table no hits; a null item id is
skipped; item and document ids may be of any type that can be sorted; null and
repeated document ids are rows of their own in ``clean``; extra columns are ignored by
``contamination`` and kept by ``clean``.  Texts are told apart by a 64-bit hash and
their length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, Table, broadcast_within, stored

WINDOW = 10
BITS = 22            # of a word's hash: the bitmap holds 2^BITS of them
HELD_WORDS = 1 << 18
ROWS = 1 << 14
#: Bytes that are no part of a word become a space, A-Z lower case (word pattern: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+).
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def _text_key(text_col: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return F.xxhash64(text).alias("__t"), F.length(text).alias("__len")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"), *_text_key(text_col))


def _windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, w): the windows of each item as words joined by a space."""
    rows = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("binary").alias("t")).where("item is not null and t is not null")

    def each(batches):
        for b in batches:
            for i in range(b.num_rows):
                words = words_of(b.column(1)[i].as_py())
                found = {b" ".join(words[j:j + window]) for j in range(max(1, len(words) - window + 1))} if words else ()
                for lo in range(0, len(found), ROWS):
                    part = sorted(found)[lo:lo + ROWS]
                    yield pa.record_batch([b.column(0).take(pa.array([i] * len(part))), pa.array(part, pa.binary())], ["item", "w"])

    return rows.mapInArrow(each, T.StructType([rows.schema["item"], T.StructField("w", T.BinaryType())]))


def _bitmap(words: DataFrame, bits: int) -> bytes:
    """A bit for each hash of the column ``word``; at most 2^bits numbers reach the driver."""
    bits = max(bits, 3)       # whole bytes
    at = words.select(F.crc32("word").bitwiseAND((1 << bits) - 1).cast("int").alias("h")).distinct().toArrow().column("h").to_numpy()
    out = np.zeros(1 << bits, bool)
    out[at] = True
    return np.packbits(out).tobytes()


def _passing(words: list[bytes], bitmap: np.ndarray) -> np.ndarray:
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & np.uint32(len(bitmap) - 1)
    return np.flatnonzero(bitmap[h])


def _counts(docs: DataFrame, text_col: str, vocabulary: DataFrame, bits: int) -> DataFrame:
    """(word, n): how often the words of ``vocabulary`` occur in all documents."""
    packed = _bitmap(vocabulary, bits)

    def each(batches):
        bitmap = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                words = words_of(t.as_py())
                held.update([words[i] for i in _passing(words, bitmap).tolist()])
                if len(held) > HELD_WORDS:
                    yield batch(held)
                    held = Counter()
        if held:
            yield batch(held)

    def batch(held):
        return pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    found = docs.select(F.col(f"`{text_col}`").cast("binary").alias("t")).where("t is not null").mapInArrow(each, "word binary, n long")
    found = found.groupBy("word").agg(F.sum("n").alias("n"))
    return vocabulary.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def _prefixes(docs: DataFrame, windows: DataFrame, text_col: str, bits: int) -> DataFrame:
    """(w, n_w, word, off): each distinct window, its words, its rarest word and that one's place."""
    split = windows.select("w").distinct().select("w", F.posexplode(F.split(F.col("w").cast("string"), " ")).alias("off", "word"))
    split = stored(split.select("w", "off", F.col("word").cast("binary").alias("word")), "decon-words")
    counts = _counts(docs, text_col, split.select("word").distinct(), bits)
    rarest = split.join(counts, "word").groupBy("w").agg(F.min(F.struct("n", "word", "off")).alias("r"), F.count("*").cast("int").alias("n_w"))
    return stored(rarest.select("w", "n_w", "r.word", "r.off"), "decon-prefixes")


def hits(docs: DataFrame, windows: DataFrame, text_col: str = "text", window: int = WINDOW, bits: int = BITS) -> DataFrame:
    """(__t, __len, s, e, w): the verified windows of each text, as word ranges."""
    prefixes = _prefixes(docs, windows, text_col, bits)
    packed = _bitmap(prefixes.select("word").distinct(), bits)
    reach = window - 1

    def each(batches):
        bitmap = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for b in batches:
            out = []
            for t, key, size in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = words_of(t.as_py())
                for i in _passing(words, bitmap).tolist():
                    out.append((key, size, i, words[i], words[max(0, i - reach):i], words[i + 1:i + 1 + reach]))
                    if len(out) >= ROWS:
                        yield batch(out)
                        out = []
            if out:
                yield batch(out)

    def batch(rows):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()))
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["__t", "__len", "i", "word", "before", "after"])

    places = _texts(docs, text_col).where("text is not null").mapInArrow(
        each, "__t long, __len int, i int, word binary, before array<binary>, after array<binary>")
    met = places.join(broadcast_within(Table(prefixes, "decon-windows"), BROADCAST_BYTES), "word")
    # positional and length bounds, then the words themselves
    met = met.where((F.size("before") >= F.col("off")) & (F.size("after") >= F.col("n_w") - 1 - F.col("off")))
    texts = lambda c: F.transform(c, lambda x: x.cast("string"))
    there = F.concat(F.slice(texts("before"), F.size("before") - F.col("off") + 1, F.col("off")), F.array(F.col("word").cast("string")),
                     F.slice(texts("after"), 1, F.col("n_w") - 1 - F.col("off")))
    found = met.where(F.array_join(there, " ") == F.col("w").cast("string"))
    return found.select("__t", "__len", (F.col("i") - F.col("off")).alias("s"), (F.col("i") - F.col("off") + F.col("n_w")).alias("e"), "w").distinct()


def _covered(spans: Column) -> Column:
    """Words inside the union of spans (s, e)."""
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["at"]))).alias("n"),
                                   F.greatest(acc["at"], x["e"]).alias("at"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("at")), step, lambda acc: acc["n"]).cast("long")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, bits: int = BITS) -> DataFrame:
    """Per row of ``docs``: (id, n_words, n_hit, items), items being the sorted
    ids of those with a window in the document."""
    windows = stored(_windows(items, item_col, item_text_col, window), "decon-items")
    found = stored(hits(docs, windows, text_col, window, bits), "decon-hits")
    spans = found.groupBy("__t", "__len").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    held = (found.select("__t", "__len", "w").distinct().join(windows, "w").groupBy("__t", "__len")
            .agg(F.array_sort(F.collect_set("item")).alias("items")))
    marks = spans.join(held, ["__t", "__len"]).select("__t", "__len", _covered(F.col("spans")).alias("n_hit"), "items")

    def count(batches):
        for b in batches:
            n = [len(words_of(t.as_py())) for t in b.column(1)]
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), pa.array(n, pa.int64())], ["id", "__t", "__len", "n_words"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"), *_text_key(text_col))
    schema = T.StructType([rows.schema["id"], T.StructField("__t", T.LongType()), T.StructField("__len", T.IntegerType()), T.StructField("n_words", T.LongType())])
    none = F.array().cast(T.ArrayType(windows.schema["item"].dataType))
    return rows.mapInArrow(count, schema).join(marks, ["__t", "__len"], "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", window: int = WINDOW, bits: int = BITS) -> DataFrame:
    """``docs`` without the contaminated rows; each row goes by its own text,
    whatever its id."""
    windows = stored(_windows(items, item_col, item_text_col, window), "decon-items")
    held = Table(hits(docs, windows, text_col, window, bits).select(F.col("__t").alias("__ht"), F.col("__len").alias("__hlen")).distinct(), "decon-texts")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*own, *_text_key(text_col))
    return rows.join(broadcast_within(held, BROADCAST_BYTES), (F.col("__t") == F.col("__ht")) & (F.col("__len") == F.col("__hlen")), "left_anti").select(*own)
