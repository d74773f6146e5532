r"""Cross-tokenizer alignment from the tokenizers' own spans.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (pieces with byte
fallback) the text, to which it adds the space itself.  Byte offsets where tokens of
both end cut the tokens into groups.

Coarse cuts come from the spans that the tokenizers report, in characters: every place
where spans of both end is a cut.  Tokens that end within a character report no place of
their own (in A the pieces of a multibyte character share its span, in B its byte-fallback
tokens but the last have spans of no width); only where both tokenizers have such tokens
are their decoded bytes counted, and common ends become further cuts.

A text is read in units, cut before each single space between two other characters.
There both tokenizers begin a token whatever stands before it (B only if no piece holds
a space after another character, which is looked up), so the units' tokens are those of
the whole text.  Units repeat, as words do: a task aligns each once, as long as its table
of units has room, and puts the texts together from the table.

Statistics over the corpus: the count of an (A id, B id) pair is the number of
documents that hold it linked, linked being all pairs of tokens of one group.  They
are grouped aggregates of the pairs of each document; counts come back by a join,
broadcast only if the table of pairs is small.

Defined cases: null and empty texts, and texts whose decoded tokens of A or B are not
the space and the text (B reads U+2581 as a space, for one), have no tokens; repeated
rows each get a row and count as documents of their own; ids may be null or repeat; an
empty table gives no rows; extra columns are kept by ``align``.

The vocabularies are files named by path and read by every task; none is trained here.
sentencepiece's immutable proto is gone from current releases; its spans are read as
``offset_mapping``.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, broadcast_within

FOLDER = "/opt/tokenizers"
BYTE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"
BATCH_BYTES = 1 << 20      # of the texts put together at a time
KNOWN_TOKENS = 1 << 23     # of the units that a task keeps
UNITS = 1 << 14            # aligned at a time, in runs of about SLICE characters
SLICE = 1 << 15
BLANK = "▁"                # B's mark of a space is one in a text, too
CUT = re.compile(r"(?<=\S) (?=\S)")
PAIR_BYTES = 32 << 20      # of the files of the table of pairs that may be broadcast
B_BITS = 32


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's character of each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


@dataclass
class Aligned:
    """Many texts or units: the token ids of both tokenizers and the groups, one behind the
    other, with their numbers.  A part whose tokens are not its bytes is not sound and has none."""
    sound: np.ndarray
    a: np.ndarray
    a_n: np.ndarray           # tokens of a part
    b: np.ndarray
    b_n: np.ndarray
    a_size: np.ndarray        # tokens of a group
    b_size: np.ndarray
    groups_n: np.ndarray      # groups of a part


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _within(n: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one behind the other."""
    return np.arange(n.sum()) - np.repeat(_starts(n), n)


def _flat(lists, n: int) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, n)


class Aligner:
    """Both tokenizers, loaded by a task."""

    def __init__(self, folder: str, byte_file: str, piece_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # Spark's tasks are the parallel part
        import sentencepiece
        from tokenizers import Tokenizer

        self.byte = Tokenizer.from_file(os.path.join(folder, byte_file))
        self.byte.encode_special_tokens = True               # their strings in a text are plain text
        self.piece = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, piece_file))
        alphabet = _byte_alphabet()
        vocab = self.byte.get_vocab(with_added_tokens=False)
        with open(os.path.join(folder, byte_file), encoding="utf-8") as f:
            added = {x["content"] for x in json.load(f).get("added_tokens") or ()}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = token.encode() if token in added else bytes(alphabet[c] for c in token)
        self.b_bytes, splits = [], True
        for i in range(len(self.piece)):
            p = self.piece.id_to_piece(i)
            self.b_bytes.append(bytes([int(p[3:-1], 16)]) if self.piece.is_byte(i) else p.replace("▁", " ").encode())
            splits &= "▁" not in p.lstrip("▁")
        self.splits, self.n_pairs = splits, len(self.a_bytes) * len(self.b_bytes)
        self.a_length, self.b_length = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))

    def units(self, text: str) -> list[str]:
        return CUT.split(text) if self.splits else [text]

    def _joined(self, parts: list[str]) -> list[list[int]]:
        """The parts' numbers in runs that are encoded together: units stand beside each other as in a text."""
        runs, size, open_ = [], 0, False
        for i, p in enumerate(parts):
            clean = self.splits and p == p.strip() and p[-1] != BLANK
            if clean and open_ and size < SLICE:
                runs[-1].append(i)
                size += len(p)
            else:
                runs.append([i])
                size, open_ = len(p), clean
        return runs

    def align(self, parts: list[str]) -> Aligned:
        """The groups of texts or units (none empty), each as if read alone."""
        texts = [" ".join([parts[i] for i in run]) for run in self._joined(parts)]
        own = self.byte.encode_batch([" " + t for t in texts], add_special_tokens=False)
        spans = self.piece.encode(texts, return_type="offset_mapping", return_bytes=False, num_threads=1)
        a_tokens, b_tokens = (np.fromiter(map(len, x), np.int64, len(x)) for x in (own, [x["ids"] for x in spans]))
        a, b = _flat((x.ids for x in own), a_tokens.sum()), _flat((x["ids"] for x in spans), b_tokens.sum())
        # spans in characters of all parts, each behind a space
        size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        start = _starts(size)
        base = _starts(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        a_span = _flat(chain.from_iterable(x.offsets for x in own), 2 * len(a)).reshape(-1, 2) + np.repeat(base, a_tokens)[:, None]
        b_span = _flat(chain.from_iterable(x["offsets"] for x in spans), 2 * len(b)).reshape(-1, 2) + np.repeat(base + 1, b_tokens)[:, None]
        part_a, part_b = (np.searchsorted(start, x[:, 0], "right") - 1 for x in (a_span, b_span))
        b_first = _within(b_tokens) == 0
        a_n, b_n = (np.bincount(x, minlength=len(parts)) for x in (part_a, part_b))
        sound = self._sound(parts, a, a_n, b, b_n)
        if not sound.all():
            keep_a, keep_b = sound[part_a], sound[part_b]
            a, a_span, part_a = a[keep_a], a_span[keep_a], part_a[keep_a]
            b, b_span, part_b, b_first = b[keep_b], b_span[keep_b], part_b[keep_b], b_first[keep_b]
            a_n, b_n = np.where(sound, a_n, 0), np.where(sound, b_n, 0)
        # of the tokens of a character, which report one end, the last ends there; byte tokens
        # but the last have no width (nor has the added space where it is the first token)
        a_in = np.append(a_span[1:, 1] == a_span[:-1, 1], False) if len(a) else np.zeros(0, bool)
        b_in = (b_span[:, 0] == b_span[:, 1]) & ~b_first
        # places in half characters: a token that ends within a character gets the half before or after the reported end
        a_at, b_at = 2 * a_span[:, 1] - a_in, 2 * b_span[:, 1] + b_in
        both = (np.bincount(part_a, a_in, len(parts)) > 0) & (np.bincount(part_b, b_in, len(parts)) > 0)
        if both.any():                                          # there only the bytes tell; they get room behind all characters
            for at, part, n, length in ((a_at, part_a, a_n, self.a_length[a]), (b_at, part_b, b_n, self.b_length[b])):
                own_bytes = np.cumsum(length) - np.repeat(_starts(np.bincount(part, length, len(parts)).astype(np.int64)), n)
                room = _starts(np.bincount(part, length, len(parts)).astype(np.int64) * 2 + 2 * size + 4)
                at -= 2 * start[part] - room[part]
                at[both[part]] = (room[part] + 2 * own_bytes)[both[part]]
        near = np.minimum(np.searchsorted(b_at, a_at), max(0, len(b_at) - 1))
        cut = np.flatnonzero(b_at[near] == a_at) if len(a) else np.zeros(0, np.int64)
        # every part ends with a cut, so groups run from cut to cut
        return Aligned(sound, a, a_n, b, b_n, np.diff(cut, prepend=-1), np.diff(near[cut], prepend=-1), np.bincount(part_a[cut], minlength=len(parts)))

    def _sound(self, parts: list[str], a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray) -> np.ndarray:
        want = [(" " + p).encode() for p in parts]
        sound = np.ones(len(want), bool)
        size = np.fromiter(map(len, want), np.int64, len(want))
        for ids, n, words, length in ((a, a_n, self.a_bytes, self.a_length), (b, b_n, self.b_bytes, self.b_length)):
            got = b"".join(map(words.__getitem__, ids.tolist()))
            at = np.concatenate(([0], np.cumsum(length[ids])))[np.concatenate(([0], np.cumsum(n)))]
            if got == b"".join(want) and (np.diff(at) == size).all():
                continue
            sound &= [got[i:j] == w for i, j, w in zip(at[:-1].tolist(), at[1:].tolist(), want)]
        return sound


def written(x: Aligned) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3;`` for each part: a group's A ids, its B ids, the groups in order."""
    ids, back = np.unique(np.concatenate((x.a, x.b)), return_inverse=True)
    text = np.array(list(map(str, ids.tolist())), "S") if len(ids) else np.empty(0, "S1")
    digits = np.concatenate((text.view(np.uint8).reshape(len(ids), -1), np.full((len(ids), 1), ord(","), np.uint8)), axis=1)
    a_place = np.arange(len(x.a)) + np.repeat(_starts(x.b_size), x.a_size)
    b_place = np.arange(len(x.b)) + np.repeat(np.cumsum(x.a_size), x.b_size)
    out = np.empty((len(back), digits.shape[1]), np.uint8)
    out[np.concatenate((a_place, b_place))] = digits[back]
    out[a_place[np.cumsum(x.a_size) - 1], -1] = ord("|")
    out[b_place[np.cumsum(x.b_size) - 1], -1] = ord(";")
    flat = out.ravel()
    used = np.concatenate(([0], np.cumsum((out != 0).sum(axis=1))))
    ends = used[np.cumsum(x.a_n + x.b_n)].tolist()
    whole = flat[flat != 0].tobytes()
    return [whole[i:j] for i, j in zip([0, *ends], ends)]


def links(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each part the distinct linked pairs, A id << 32 | B id, ascending, how often each is linked, and the numbers of pairs."""
    part = np.repeat(np.arange(len(x.sound)), x.groups_n)
    a_from, b_from = _starts(x.a_size), _starts(x.b_size)
    wide = x.a_size * x.b_size > 1 << 12
    keys, parts, times = [], [], []
    for g in np.flatnonzero(wide).tolist():                     # a long group by its distinct ids
        (u, m), (v, k) = (np.unique(t[i:i + n], return_counts=True) for t, i, n in ((x.a, a_from[g], x.a_size[g]), (x.b, b_from[g], x.b_size[g])))
        keys.append(((u[:, None] << B_BITS) | v).ravel())
        times.append((m[:, None] * k).ravel())
        parts.append(np.full(len(keys[-1]), part[g]))
    a_size, b_size = np.where(wide, 0, x.a_size), np.where(wide, 0, x.b_size)
    per = np.repeat(b_size, a_size)                             # B tokens beside each A token
    a = x.a[np.repeat(a_from, a_size) + _within(a_size)]
    b = x.b[np.repeat(np.repeat(b_from, a_size), per) + _within(per)]
    keys.append((np.repeat(a, per) << B_BITS) | b)
    times.append(np.ones(len(b), np.int64))
    parts.append(np.repeat(part, a_size * b_size))
    key, time, part = np.concatenate(keys), np.concatenate(times), np.concatenate(parts)
    order = np.lexsort((key, part))
    key, time, part = key[order], time[order], part[order]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(time, first) if len(first) else time, np.bincount(part[first], minlength=len(x.sound))


#: What can be asked for beside the numbers of tokens, groups and links.
LISTS = {"a_ids": "int", "b_ids": "int", "a_ends": "int", "b_ends": "int", "pairs": "long", "times": "long"}


class Units(dict):
    """Unit -> its number, and what belongs to every unit, in lists one behind the other."""

    def __init__(self, aligner: Aligner, wanted: tuple[str, ...] = ("groups", *LISTS)):
        self.aligner, self.wanted = aligner, wanted
        self.kept = [c for c in LISTS if c in wanted or "pairs" in wanted and c == "times" or "times" in wanted and c == "pairs"]
        self.drop()

    def drop(self):
        self.clear()
        self.tokens = 0
        self.text: list[bytes] = []
        self.numbers = array("q")                             # of a unit: whether it is sound, n_a, n_b, n_groups, n_links
        self.lists = {c: array("q") for c in self.kept}
        self.ends = {c: array("q", [0]) for c in self.kept}

    def learn(self, units: list[str]):
        for lo in range(0, len(units), UNITS):
            some = units[lo:lo + UNITS]
            x = self.aligner.align(some)
            key, times, pairs_n = links(x)
            n_links = np.add.reduceat(np.append(x.a_size * x.b_size, 0), np.minimum(_starts(x.groups_n), len(x.a_size))) * (x.groups_n > 0)
            self.numbers.frombytes(np.stack((x.sound, x.a_n, x.b_n, x.groups_n, n_links), axis=1).astype(np.int64).tobytes())
            ends = [np.cumsum(size) - np.repeat(_starts(n), x.groups_n) for size, n in ((x.a_size, x.a_n), (x.b_size, x.b_n))]
            columns = ((x.a, x.a_n), (x.b, x.b_n), (ends[0], x.groups_n), (ends[1], x.groups_n), (key, pairs_n), (times, pairs_n))
            for c, (values, n) in zip(LISTS, columns):
                if c in self.kept:
                    self.ends[c].frombytes((len(self.lists[c]) + np.cumsum(n)).astype(np.int64).tobytes())
                    self.lists[c].frombytes(values.astype(np.int64).tobytes())
            self.update(zip(some, range(len(self), len(self) + len(some))))
            if "groups" in self.wanted:
                self.text.extend(written(x))
            self.tokens += len(x.a) + len(x.b)

    def together(self, texts: list[str | None]) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links and what is wanted, for each text."""
        parts = [self.aligner.units(t) if t else [] for t in texts]
        self.learn([u for u in set(chain.from_iterable(parts)) if u not in self])
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        unit = np.fromiter(map(self.__getitem__, chain.from_iterable(parts)), np.int64, int(count.sum()))
        text = np.repeat(np.arange(len(parts)), count)
        numbers = np.frombuffer(self.numbers, np.int64).reshape(-1, 5)      # views: the lists grow only in learn()
        unsound = np.bincount(text, 1 - numbers[unit, 0], len(parts)) > 0
        if unsound.any():
            unit, text, count = unit[~unsound[text]], text[~unsound[text]], np.where(unsound, 0, count)
        cut = np.concatenate(([0], np.cumsum(count)))
        out = []
        for i in range(1, 5):
            total = np.concatenate(([0], np.cumsum(numbers[unit, i])))
            out.append(pa.array(np.diff(total[cut])))
        found, size = {}, {}
        for c in self.kept:
            ends = np.frombuffer(self.ends[c], np.int64)
            n = np.diff(ends)[unit]
            size[c] = np.concatenate(([0], np.cumsum(n)))[cut]         # where each text begins in the gathered list
            found[c] = np.frombuffer(self.lists[c] or np.zeros(1, np.int64), np.int64)[np.repeat(ends[:-1][unit], n) + _within(n)]
            if c in ("a_ends", "b_ends"):                              # ends count from the text's first token
                tokens = numbers[unit, 1 if c == "a_ends" else 2]
                before = _starts(tokens)
                found[c] += np.repeat(before - before[np.minimum(cut[:-1], max(0, len(unit) - 1))][text], n) if len(unit) else 0
        if "pairs" in self.kept:
            part = np.repeat(np.arange(len(texts)), np.diff(size["pairs"]))
            # one number to sort by: text, A id, B id
            order = np.argsort(part * self.aligner.n_pairs + (found["pairs"] >> B_BITS) * len(self.aligner.b_bytes) + (found["pairs"] & ((1 << B_BITS) - 1)))
            key, part = found["pairs"][order], part[order]
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])))) if len(key) else np.zeros(0, np.int64)
            found["pairs"], found["times"] = key[first], np.add.reduceat(found["times"][order], first) if len(first) else key
            size["pairs"] = size["times"] = np.concatenate(([0], np.cumsum(np.bincount(part[first], minlength=len(texts)))))
        for c in self.wanted:
            if c == "groups":
                numbers_of = unit.tolist()
                out.append(pa.array([b"".join(map(self.text.__getitem__, numbers_of[i:j]))[:-1] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())],
                                    pa.binary()).cast(pa.string()))
            else:
                kind = np.int64 if LISTS[c] == "long" else np.int32
                out.append(pa.ListArray.from_arrays(pa.array(size[c].astype(np.int32)), pa.array(found[c].astype(kind))))
        if self.tokens > KNOWN_TOKENS:
            self.drop()
        return out


def _aligned(folder: str, byte_file: str, piece_file: str, wanted: tuple[str, ...]):
    """(row, text) -> row and the alignment of its text, passed on in batches of about ``BATCH_BYTES``."""

    def each(batches):
        units = Units(Aligner(folder, byte_file, piece_file), wanted)
        names = ["n_a", "n_b", "n_groups", "n_links", *wanted]
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            at, held = 0, 0
            for i, size in enumerate(sizes):
                held += size
                if held > BATCH_BYTES or i + 1 == len(sizes):
                    part = b.slice(at, i + 1 - at)
                    yield pa.record_batch([part.column(0), pa.StructArray.from_arrays(units.together(part.column(1).to_pylist()), names)], ["row", "align"])
                    at, held = i + 1, 0

    return each


def align(docs: DataFrame, text_col: str = "text", folder: str = FOLDER, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE,
          wanted: Sequence[str] = ("groups", *LISTS)) -> DataFrame:
    """``docs`` with ``__align``: n_a, n_b, n_groups and n_links, and of these the ``wanted``
    ones: the groups as text, token ids of both (a_ids, b_ids), the ends of each group's
    tokens in both lists (a_ends, b_ends), the distinct linked pairs (A id << 32 | B id) and
    how often each is linked (times)."""
    wanted = tuple(wanted)
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = ["n_a:long", "n_b:long", "n_groups:long", "n_links:long", *(f"{c}:string" if c == "groups" else f"{c}:array<{LISTS[c]}>" for c in wanted)]
    schema = T.StructType([rows.schema["row"], T.StructField("align", T.StructType.fromDDL(",".join(kinds)))])
    out = rows.mapInArrow(_aligned(folder, byte_file, piece_file, wanted), schema)
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("align").alias("__align"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pairs: array of distinct pairs, a row per document) -> pair, n (documents), best (of no pair of its A id are there more)."""
    counted = Table(pairs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a_id = F.shiftright("pair", B_BITS)
    most = counted.df.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))
    return counted.df.withColumn("a", a_id).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, byte_file: str = BYTE_FILE,
               piece_file: str = PIECE_FILE, digest: bool = True) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): per row its tokens,
    groups and links; links whose pair no other pair of its A id exceeds; the sum of its
    links' counts; the groups as text, with ``digest`` their SHA-256 ('' without tokens)."""
    part = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = align(part, "text", folder, byte_file, piece_file, ("groups", "pairs", "times"))
    text = F.col("__align.groups")
    rows = Table(found.select("id", *[F.col(f"__align.{c}") for c in ("n_a", "n_b", "n_groups", "n_links", "pairs", "times")],
                              (F.when(text != "", F.sha2(text, 256)).otherwise("") if digest else text).alias("groups"),
                              F.monotonically_increasing_id().alias("row")), "aligned").df
    counts = broadcast_within(Table(pair_counts(rows), "pair-table"), PAIR_BYTES)
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("m"))
    sums = (each.join(counts, "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum")))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(sums, "row", "left").select(
        "id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups")
