r"""Language-model scoring with sharded Elias-Fano n-gram tries.

The model is a bigram model with Dirichlet smoothing towards unigrams:
p(w | v) = (c(v w) + mu p(w)) / (c(v) + mu), p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).
The numerator depends on the pair and on w, the denominator on v alone, so that a
trie whose first level is the predicted word and whose second level is its contexts
holds all that a pair needs, and each token adds its own denominator as a context.

A shard's trie is one buffer: level 1 has the sorted word ids, counts and monotone
pointers into level 2; level 2 has the contexts of each word, relative to the word
(one monotone sequence of word rank and context id), with smoothed log-probabilities
quantised to 16 bits.  Monotone sequences are in Elias-Fano form.  A task reads its
shard in place from the Arrow buffer (executors share no local folder to map files
from) and looks pairs up by context-relative successor search.

Scale: shards are by hash of the predicted word, with about ``shard_tokens`` training
tokens each.  Words with at least 1/65,534 of the training tokens (so at most 65,534
of them, sent to every task) are spread over all shards by hash of the pair; their own
counts need no shard.  Tokens travel as compressed arrays, one row per batch of
documents and shard; per document only partial sums come back.  Batches hold at most
``BATCH_TOKENS`` tokens (or one document).

Ids are 64-bit hashes of words, contexts within a word 40 bits of them.

Defined cases: null text is one end token; a null id counts as the text '' for the
training rule; repeated rows each count and each get a row; an empty table gives no
rows; without training rows N = V = 0 and every token is unknown; only the id and
text columns are read.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .elias_fano import Sequence, encode

MU = 500.0
SHARD_TOKENS = 2_000_000
BATCH_TOKENS = 500_000
BATCH_DOCS = 50_000
DICTIONARY = 250_000
SEED = 7
HOT = 65_534
COLD = 65_535
END, START = b" end", b" start"      # no word holds a space
CONTEXT_BITS = np.uint64(40)
STEPS = 65_535
GROUP = 8        # batches that a look-up takes together


def word_id(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w, SEED)


def in_training(id_col: Column) -> Column:
    """Whether crc32 of the id as text is not 1 modulo 5."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 != 1


class _Words:
    """Local numbers of words: 0 is the end, 1 the start; their 64-bit ids, and their
    places among the hot words."""

    def __init__(self, hot: np.ndarray | None = None):
        self.hot = hot
        self.reset()

    def reset(self):
        self.number = defaultdict(itertools.count(2).__next__)
        self.ids = np.array([word_id(END), word_id(START)], np.uint64)
        self.code = self._codes(self.ids)

    def _codes(self, ids: np.ndarray) -> np.ndarray | None:
        if self.hot is None:
            return None
        at = np.minimum(np.searchsorted(self.hot, ids), len(self.hot) - 1)
        return np.where(self.hot[at] == ids, at, COLD).astype(np.uint16)

    def full(self) -> bool:
        return len(self.number) > DICTIONARY

    def renew(self):
        if self.full():
            self.reset()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def grow(self):
        """Ids and codes of the words met since the last call."""
        known = len(self.ids) - 2
        if len(self.number) > known:
            new = np.fromiter(map(word_id, itertools.islice(self.number, known, None)), np.uint64, len(self.number) - known)
            self.ids = np.concatenate((self.ids, new))
            if self.hot is not None:
                self.code = np.concatenate((self.code, self._codes(new)))


def _batches(stream, dictionary: _Words):
    """(ids, tokens, lengths) of batches of whole documents: local numbers of each
    document's words and its end."""
    ids, parts, sizes, total = [], [], [], 0
    for b in stream:
        for i, t in zip(b.column(0), b.column(1)):
            words = (t.as_py() or b"").lower().split()
            if ids and (total + len(words) >= BATCH_TOKENS or len(ids) >= BATCH_DOCS):
                dictionary.grow()
                yield ids, np.concatenate(parts), np.array(sizes)
                ids, parts, sizes, total = [], [], [], 0
                dictionary.renew()
            ids.append(i.as_py())
            parts += [dictionary.numbers(words), np.zeros(1, np.int64)]
            sizes.append(len(words) + 1)
            total += len(words) + 1
    if ids:
        dictionary.grow()
        yield ids, np.concatenate(parts), np.array(sizes)


def _contexts(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The local number before each token; 1 at the start of a document."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(sizes)[:-1]] = 1
    out[0] = 1
    return out


def _shard(words: _Words, w: np.ndarray, v: np.ndarray, shards: int) -> np.ndarray:
    """Of each pair: by the word, for hot words by the pair."""
    x = words.ids[w]
    hot = words.code[w] != COLD
    x = np.where(hot, (x ^ (words.ids[v] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93), x)
    return ((x >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return np.array([len(arrays), *[a.nbytes for a in arrays]], "<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    sizes = np.frombuffer(blob, "<i8", n, 8)
    body = zstandard.ZstdDecompressor().decompress(blob[8 * (n + 1):], max_output_size=max(1, int(sizes.sum()))) if sizes.sum() else b""
    ends = np.cumsum(sizes)
    return [np.frombuffer(body, k, int(s) // np.dtype(k).itemsize, int(e - s)) for k, s, e in zip(kinds, sizes, ends)]


def _pairs_blob(words: _Words, w: np.ndarray, v: np.ndarray, *rest: np.ndarray) -> bytes:
    """Pairs as codes of hot words, with the ids of the others aside."""
    cw, cv = words.code[w], words.code[v]
    low = (words.ids[v[cv == COLD]] >> (np.uint64(64) - CONTEXT_BITS)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return _pack(cw, cv, words.ids[w[cw == COLD]], low, *rest)


def _read_pairs(blob: bytes, hot: np.ndarray, *kinds):
    """(word ids, context ids of 40 bits, whether the word is hot, the rest)."""
    cw, cv, ids, low, *rest = _unpack(blob, np.uint16, np.uint16, np.uint64, np.uint8, *kinds)
    table = np.concatenate((hot, np.zeros(COLD + 1 - len(hot), np.uint64)))
    w, v = table[cw], table[cv] >> (np.uint64(64) - CONTEXT_BITS)
    w[cw == COLD] = ids
    wide = np.zeros((len(low) // 5, 8), np.uint8)
    wide[:, :5] = low.reshape(-1, 5)
    v[cv == COLD] = wide.view("<u8").ravel()
    return w, v, cw != COLD, rest


class Model:
    """Counts of the training tokens, the hot words, and the table of shards
    (shard, trie)."""

    def __init__(self, tokens: int, words: int, docs: int, hot: np.ndarray, hot_counts: np.ndarray, shards: int, tries: DataFrame | None):
        self.tokens, self.words, self.docs = tokens, words, docs
        self.hot, self.hot_counts, self.shards, self.tries = hot, hot_counts, shards, tries


class _Numbers:
    """What tasks need of the model besides its shards."""

    def __init__(self, tokens: int, words: int, hot: np.ndarray, hot_counts: np.ndarray, mu: float = MU):
        self.tokens, self.words, self.hot, self.hot_counts, self.mu = tokens, words, hot, hot_counts, mu
        self.floor = np.log10(mu * 0.5 / (tokens + 0.5 * (words + 1)))      # least numerator
        self.step = max(1e-9, (np.log10(tokens + mu + 1.0) - self.floor) / STEPS)

    def p(self, c):
        return (c + 0.5) / (self.tokens + 0.5 * (self.words + 1))

    def quantised(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x - self.floor) / self.step), 0, STEPS).astype("<u2")

    def value(self, code: np.ndarray) -> np.ndarray:
        return self.floor + code * self.step


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None, mu: float = MU,
        shard_tokens: int = SHARD_TOKENS) -> Model:
    """Learns from the rows of ``docs`` with ``where`` (all by default)."""
    rows = docs if where is None else docs.where(where)
    rows = rows.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))

    def count(stream):
        words, held = _Words(), np.zeros(2, np.int64)

        def flush():
            at = np.flatnonzero(held)
            return pa.record_batch([pa.array(words.ids[at].view(np.int64)), pa.array(held[at])], ["w", "n"])

        for _, tokens, _ in _batches(stream, words):
            held = np.concatenate((held, np.zeros(len(words.ids) - len(held), np.int64)))
            held += np.bincount(tokens, minlength=len(held))
            if words.full():                # renewed before the next batch
                yield flush()
                held = np.zeros(2, np.int64)
        yield flush()

    counts = stored(rows.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "lm-words")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("w") == _signed(END), F.col("n"))).alias("d")).first()
    tokens, n_words, n_docs = total["n"] or 0, total["v"], total["d"] or 0
    # at most HOT words can have this share of the tokens; the end is always among them
    top = counts.where((F.col("n") * HOT >= tokens) | (F.col("w") == _signed(END))).toArrow()
    ids, n = top.column("w").to_numpy().view(np.uint64), top.column("n").to_numpy()
    if not len(ids):
        ids, n = np.array([word_id(END)], np.uint64), np.zeros(1, np.int64)
    order = np.argsort(ids)
    hot, hot_counts = ids[order], n[order]
    shards = max(1, -(-tokens // shard_tokens))

    def pairs(stream):
        words = _Words(hot)
        for _, tokens, sizes in _batches(stream, words):
            key, n = np.unique((tokens << 32) | _contexts(tokens, sizes), return_counts=True)
            w, v = key >> 32, key & 0xFFFFFFFF
            shard = _shard(words, w, v, shards)
            order = np.argsort(shard, kind="stable")
            ends = np.cumsum(np.bincount(shard, minlength=shards))
            some = [(s, order[a:b]) for s, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends)) if b > a]
            yield pa.record_batch([pa.array([s for s, _ in some], pa.int32()),
                                   pa.array([_pairs_blob(words, w[at], v[at], n[at].astype("<u4")) for _, at in some], pa.binary())], ["shard", "blob"])

    numbers = _Numbers(tokens, n_words, hot, hot_counts, mu)

    def build(table: pa.Table) -> pa.Table:
        parts = [_read_pairs(x, hot, "<u4") for x in table.column("blob").to_pylist()]
        w = np.concatenate([p[0] for p in parts])
        v = np.concatenate([p[1] for p in parts])
        n = np.concatenate([p[3][0] for p in parts]).astype(np.int64)
        del parts
        shard = table.column("shard")[:1]
        del table
        return pa.table({"shard": shard, "trie": pa.array([_trie(w, v, n, numbers)], pa.binary())})

    blobs = rows.mapInArrow(pairs, "shard int, blob binary")
    tries = stored(blobs.groupBy("shard").applyInArrow(build, "shard int, trie binary"), "lm-tries")
    return Model(tokens, n_words, n_docs, hot, hot_counts, shards, tries)


def _signed(w: bytes) -> int:
    return int(np.array([word_id(w)], np.uint64).view(np.int64)[0])


def _trie(w: np.ndarray, v: np.ndarray, n: np.ndarray, numbers: _Numbers) -> bytes:
    """Levels of one shard from its pairs (repeats are summed)."""
    words, rank = np.unique(w, return_inverse=True)
    key = (rank.astype(np.uint64) << CONTEXT_BITS) | v
    del w, v, rank
    order = np.argsort(key)
    key, n = key[order], n[order]
    del order
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key, n = key[first], np.add.reduceat(n, first)
    rank = (key >> CONTEXT_BITS).astype(np.int64)
    counts = np.bincount(rank, weights=n, minlength=len(words)).astype(np.int64)
    pointers = np.concatenate(([0], np.cumsum(np.bincount(rank, minlength=len(words))))).astype(np.uint64)
    at = np.minimum(np.searchsorted(numbers.hot, words), len(numbers.hot) - 1)
    counts = np.where(numbers.hot[at] == words, numbers.hot_counts[at], counts)     # a hot word's pairs lie in all shards
    code = numbers.quantised(np.log10(n + numbers.mu * numbers.p(counts[rank])))
    parts = [encode(words), encode(pointers), encode(key), counts.astype("<i8").tobytes(), code.tobytes()]
    return np.array([len(x) for x in parts], "<i8").tobytes() + b"".join(parts)


class Trie:
    """One shard, read in place."""

    def __init__(self, buffer):
        sizes = np.frombuffer(buffer, "<i8", 5)
        at = 40 + np.concatenate(([0], np.cumsum(sizes)))
        cut = lambda i: memoryview(buffer)[int(at[i]):int(at[i + 1])]
        self.words, self.pointers, self.pairs = Sequence(cut(0)), Sequence(cut(1)), Sequence(cut(2))
        self.counts, self.codes = np.frombuffer(cut(3), "<i8"), np.frombuffer(cut(4), "<u2")

    def find(self, w: np.ndarray, v: np.ndarray):
        """(count of each word, code of each pair or -1)."""
        words, back = np.unique(w, return_inverse=True)
        rank = self.words.find(words)
        count = np.where(rank >= 0, self.counts[rank] if len(self.counts) else 0, 0)
        # words whose level-2 range is empty or that are unknown need no search
        known = rank >= 0
        code = np.full(len(w), -1, np.int64)
        at = np.flatnonzero(known[back])
        key, again = np.unique((rank[back[at]].astype(np.uint64) << CONTEXT_BITS) | v[at], return_inverse=True)
        place = self.pairs.find(key)
        code[at] = np.where(place >= 0, self.codes[place].astype(np.int64) if len(self.codes) else np.int64(0), np.int64(-1))[again]
        return count[back], code


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", mu: float = MU) -> DataFrame:
    """Per row: id, n_tokens, n_known, base_score, score (log10)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    hot, shards = model.hot, model.shards
    numbers = _Numbers(model.tokens, model.words, model.hot, model.hot_counts, mu)
    start_mass = np.log10(model.docs + mu)
    hot_base = np.log10(numbers.p(model.hot_counts))
    hot_mass = np.log10(model.hot_counts + mu)
    end_code = int(np.searchsorted(hot, word_id(END)))
    id_type = pa.list_(pa.string())

    def events(stream):
        words = _Words(hot)
        part = TaskContext.get().partitionId()
        for no, (ids, tokens, sizes) in enumerate(_batches(stream, words)):
            doc = np.repeat(np.arange(len(ids)), sizes)
            before = _contexts(tokens, sizes)
            code = words.code[tokens]
            is_hot = code != COLD
            at, hot_doc = code[is_hot], doc[is_hot]
            base = np.bincount(hot_doc, weights=hot_base[at], minlength=len(ids))
            known = np.bincount(hot_doc, weights=(model_counts[at] > 0), minlength=len(ids)).astype("<i8")
            mass = np.where(at == end_code, 0.0, hot_mass[at])          # the end is no context
            own = -np.bincount(hot_doc, weights=mass, minlength=len(ids)) - start_mass
            batch = (part << 32) + no
            shard = _shard(words, tokens, before, shards)
            order = np.argsort(shard.astype(np.uint16) if shards <= 65536 else shard, kind="stable")
            ends = np.cumsum(np.bincount(shard, minlength=shards))
            keys, blobs, names = [-1 - batch % shards], [_pack(base, known, own, sizes.astype("<i8"))], [[None if i is None else str(i) for i in ids]]
            for s, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends)):
                if b > a:
                    e = order[a:b]
                    step = np.diff(doc[e], prepend=0).astype("<u2")
                    keys.append(s)
                    blobs.append(_pairs_blob(words, tokens[e], before[e], step))
                    names.append(None)
            yield pa.record_batch([pa.array(keys, pa.int32()), pa.array([batch] * len(keys), pa.int64()),
                                   pa.array(names, id_type), pa.array(blobs, pa.binary())], ["shard", "batch", "ids", "blob"])

    model_counts = model.hot_counts

    def look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _sums.empty_table()
        if asked.column("shard")[0].as_py() < 0:       # the batches' own rows pass
            return pa.table({"batch": asked.column("batch"), "ids": asked.column("ids").cast(id_type), "blob": asked.column("blob").cast(pa.binary())}, _sums)
        trie = Trie(known.column("trie")[0].as_buffer()) if known.num_rows else None
        batches, blobs = [], []
        for some in range(0, asked.num_rows, GROUP):
            block = asked.slice(some, GROUP)
            parts = [_read_pairs(x, hot, "<u2") for x in block.column("blob").to_pylist()]
            w, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            is_hot = np.concatenate([p[2] for p in parts])
            if trie is None:
                count, code = np.zeros(len(w), np.int64), np.full(len(w), -1)
            else:
                count, code = trie.find(w, v)
            place = np.minimum(np.searchsorted(hot, w), len(hot) - 1)
            count = np.where(is_hot, model_counts[place], count)       # a hot word may have no pair here
            p = numbers.p(count)
            value = np.where(code >= 0, numbers.value(code), np.log10(numbers.mu * p)) - np.where(is_hot, 0.0, np.log10(count + numbers.mu))
            base = np.where(is_hot, 0.0, np.log10(p))
            hit = ~is_hot & (count > 0)
            lo = 0
            for b, pt in zip(block.column("batch").to_pylist(), parts):
                hi = lo + len(pt[0])
                doc = np.cumsum(pt[3][0].astype(np.int64))
                own, at = np.unique(doc, return_inverse=True)
                batches.append(b)
                blobs.append(_pack(own.astype("<u2"), np.bincount(at, value[lo:hi]).astype("<f4"), np.bincount(at, base[lo:hi]),
                                   np.bincount(at, hit[lo:hi]).astype("<u4")))
                lo = hi
        return pa.table({"batch": pa.array(batches, pa.int64()), "ids": pa.array([None] * len(blobs), id_type), "blob": pa.array(blobs, pa.binary())}, _sums)

    _sums = pa.schema([("batch", pa.int64()), ("ids", id_type), ("blob", pa.binary())])

    def total(table: pa.Table) -> pa.Table:
        ids, blobs = table.column("ids").to_pylist(), table.column("blob").to_pylist()
        head = next(i for i, x in enumerate(ids) if x is not None)
        base, known, own, sizes = (x.copy() for x in _unpack(blobs[head], "<f8", "<i8", "<f8", "<i8"))
        for i, blob in enumerate(blobs):
            if i != head:
                at, s, b, k = _unpack(blob, "<u2", "<f4", "<f8", "<u4")
                own[at] += s
                base[at] += b
                known[at] += k
        return pa.table({"id": pa.array(ids[head], pa.string()), "n_tokens": sizes, "n_known": known, "base_score": base, "score": own})

    asked = rows.mapInArrow(events, "shard int, batch long, ids array<string>, blob binary")
    sums = asked.groupBy("shard").cogroup(model.tries.groupBy("shard")).applyInArrow(look_up, "batch long, ids array<string>, blob binary")
    out = sums.groupBy("batch").applyInArrow(total, "id string, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_tokens", "n_known", "base_score", "score")
