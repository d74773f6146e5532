"""Language ID by Bayesian evidence fusion.

Posterior of a language = smoothed prior of the document's host
                        x likelihood of the text
                        x likelihood of the declared markup language
                        x likelihood of the address suffix.

* Text: character trigrams over folded bytes, one table of log-probabilities per
  language, learnt from a bounded sample of labelled rows (``sample_docs``).  Every
  label of the sample is a language, however many; a task holds the counts of
  ``HELD_LANGUAGES`` at a time and passes them on when another comes.  All
  bytes of every text count; the sum is tempered, since neighbouring trigrams are
  not independent.
* Declared language and suffix: P(value | language), from counts over all
  documents of (value, language that the text speaks for), smoothed.
* Host: counts over all documents by grouped aggregation, smoothed from the global
  prior to the host's last label and from that to the host.

The tables of declared values and suffixes and of hosts are joined back by key;
their size is checked before any is broadcast.  Text evidence is an Arrow
function over the text column only; the fusion is DataFrame expressions.

A document is rejected if its text has no letter, or if no wanted language reaches
``min_posterior``.

Defined cases: null or empty text has no text evidence and is rejected; null
declared language, suffix or host give no evidence (null is not a value); repeated
rows each get a row; without any labelled row every document is rejected with a
null language; an empty table gives no rows; extra columns are kept by ``accept``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import BROADCAST_BYTES, Table, ascii_lower, broadcast_within, sampled

SAMPLE_DOCS = 20_000
HELD_LANGUAGES = 64
CLASSES = 64
TABLE = CLASSES ** 3
PIECE = 1 << 20
HOST_STRENGTH = 20.0
SMOOTH = 1.0
#: Trigrams from which a text's evidence grows no further in proportion.
HALF_EVIDENCE = 100.0
MIN_POSTERIOR = 0.5

#: Byte classes: 0 other, 1-26 letters, 27 space, 28 digit, 29 punctuation, 32-63 bytes of non-ASCII letters.
FOLD = np.array([32 + (c & 31) if c >= 0x80 else c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90
                 else 28 if 48 <= c <= 57 else 27 if c in (9, 10, 11, 12, 13, 32) else 29 if 33 <= c <= 126 else 0
                 for c in range(256)], np.int32)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column and the offsets of its rows."""
    data = column.cast(pa.large_binary())
    _, offsets, values = data.buffers()
    offsets = np.frombuffer(offsets, np.int64)[data.offset:data.offset + len(data) + 1]
    return (np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)), offsets


def _pieces(values: np.ndarray, offsets: np.ndarray):
    """(row, trigram codes) over whole texts, long ones in overlapping pieces."""
    for i in range(len(offsets) - 1):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        for at in range(lo, hi - 2, PIECE):
            c = FOLD[values[at:min(hi, at + PIECE + 2)]]
            yield i, (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def _has_letter(values: np.ndarray, lo: int, hi: int) -> bool:
    v = FOLD[values[lo:hi]]
    return bool(((v >= 1) & (v <= 26) | (v >= 32)).any())


class TextModel:
    """Log-probabilities by language: of the trigrams seen, a row each, and in row 0 of any other."""

    def __init__(self, languages: list[str], rows: np.ndarray, logp: np.ndarray):
        self.languages, self.rows, self.logp = languages, rows, logp   # rows: trigram -> row; one gather serves all languages

    def column(self, text: Column) -> Column:
        """Tempered log-likelihood of each language; null without a letter."""
        rows, logp, n_lang = self.rows, self.logp, len(self.languages)

        @arrow_udf("array<double>")
        def evidence(t: pa.Array) -> pa.Array:
            values, offsets = _texts(t)
            total = np.zeros((len(t), n_lang))
            count = np.zeros(len(t))
            for i, codes in _pieces(values, offsets):
                total[i] += logp[rows[codes]].sum(axis=0, dtype=np.float64)
                count[i] += len(codes)
            none = np.array([not _has_letter(values, int(lo), int(hi)) for lo, hi in zip(offsets[:-1], offsets[1:])], bool)
            total /= (1.0 + count / HALF_EVIDENCE)[:, None]
            ends = np.arange(0, (len(t) + 1) * n_lang, n_lang, dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel()), mask=pa.array(none))

        return evidence(text)


def learn_text(docs: DataFrame, text_col: str, label_col: str, id_col: str, sample_docs: int = SAMPLE_DOCS) -> TextModel | None:
    """Trigram tables from about ``sample_docs`` of the distinct labelled rows (id, text, label), chosen by a hash of the row."""
    labelled = docs.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    labelled = labelled.select(F.col(f"`{label_col}`").alias("lang"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{id_col}`").alias("id"))
    part = sampled(labelled, sample_docs, "language").select("lang", "t")

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for i, codes in _pieces(*_texts(b.column(1))):
                if langs[i] not in held:
                    if len(held) == HELD_LANGUAGES:
                        yield from flush(held)
                    held[langs[i]] = np.zeros(TABLE, np.int64)
                held[langs[i]] += np.bincount(codes, minlength=TABLE)
        yield from flush(held)

    def flush(held):
        for lang, c in held.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "at", "n"])
        held.clear()

    rows = part.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    table = rows.toArrow()          # the sample's distinct trigrams of each language
    lang = table.column("lang").combine_chunks().dictionary_encode()
    langs = lang.dictionary.to_pylist()
    if not langs:
        return None
    at, n = table.column("at").to_numpy(), table.column("n").to_numpy()
    lang = lang.indices.to_numpy()
    seen, place = np.unique(at, return_inverse=True)
    index = np.zeros(TABLE, np.int32)
    index[seen] = np.arange(1, len(seen) + 1)
    total = np.bincount(lang, n, len(langs)) + 0.1 * TABLE
    names = sorted(langs)
    column = np.array([names.index(x) for x in langs])
    logp = np.empty((len(seen) + 1, len(langs)), np.float32)
    logp[:, column] = np.log(0.1 / total)
    logp[place + 1, column[lang]] = np.log((n + 0.1) / total[lang])
    return TextModel(names, index, logp)


def _best(ll: Column) -> Column:
    return F.array_position(ll, F.array_max(ll)).cast("int") - 1


def _log_shares(table: DataFrame, keys: list[str], n_lang: int) -> DataFrame:
    """Counts (keys, best, n) -> keys, lp: log P(key | language), smoothed."""
    by_lang = {r["best"]: r["n"] for r in table.groupBy("best").agg(F.sum("n").alias("n")).collect()}
    kinds = table.select(*keys).distinct().count()
    lp = F.array(*[F.log((F.coalesce(F.sum(F.when(F.col("best") == i, F.col("n"))), F.lit(0)) + SMOOTH)
                         / F.lit(float(by_lang.get(i, 0) + SMOOTH * (kinds + 1)))) for i in range(n_lang)])
    return table.groupBy(*keys).agg(lp.alias("lp"))


def _host_priors(counts: DataFrame, n_lang: int) -> DataFrame:
    """Counts (host, best, n) -> host, lp: its prior, smoothed by that of its last
    label, which is smoothed by the global one; by the global one alone where the host
    has no other label, as its own counts would come in twice."""
    per = [F.coalesce(F.sum(F.when(F.col("best") == i, F.col("n"))), F.lit(0)).cast("double") for i in range(n_lang)]
    total = counts.agg(*[c.alias(f"c{i}") for i, c in enumerate(per)]).first()
    n = sum(total)
    world = [(x + SMOOTH) / (n + SMOOTH * n_lang) for x in total]
    hosts = counts.groupBy("host").agg(F.array(*per).alias("c"))
    hosts = hosts.withColumn("zone", F.when(F.contains("host", F.lit(".")), F.element_at(F.split("host", r"\."), -1)))
    zones = (hosts.groupBy("zone").agg(F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(n_lang)]).alias("zc")))
    total_of = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    zones = zones.select("zone", F.zip_with("zc", F.array(*[F.lit(w) for w in world]), lambda c, w: (c + HOST_STRENGTH * w)
                                            / (total_of(F.col("zc")) + HOST_STRENGTH)).alias("zp"))
    prior = F.coalesce("zp", F.array(*[F.lit(w) for w in world]))
    return hosts.join(zones.where("zone is not null"), "zone", "left").select("host", F.zip_with("c", prior, lambda c, w: F.log((c + HOST_STRENGTH * w)
                                            / (total_of(F.col("c")) + HOST_STRENGTH))).alias("lp"))


def identify(docs: DataFrame, text_col: str = "text", declared: Column | None = None, suffix: Column | None = None,
             host: Column | None = None, id_col: str = "doc_id", label_col: str | None = None, wanted: Sequence[str] | None = None,
             min_posterior: float = MIN_POSTERIOR, sample_docs: int = SAMPLE_DOCS, model: TextModel | None = None) -> DataFrame:
    """``docs`` with ``__language``, ``__posterior`` and ``__keep``.  Labels for the
    text model are ``label_col``'s; missing evidence columns may be left out."""
    if model is None:
        model = learn_text(docs, text_col, label_col, id_col, sample_docs)
    own = [F.col(f"`{c}`") for c in docs.columns]
    if model is None:
        return docs.select(*own, F.lit(None).cast("string").alias("__language"), F.lit(0.0).alias("__posterior"), F.lit(False).alias("__keep"))
    n_lang = len(model.languages)
    null = F.lit(None).cast("string")
    keys = {"__declared": declared if declared is not None else null, "__suffix": suffix if suffix is not None else null,
            "__host": host if host is not None else null}
    rows = docs.select(*own, *[c.cast("string").alias(k) for k, c in keys.items()])
    rows = rows.withColumn("__ll", model.column(F.col(f"`{text_col}`")))
    counts = Table(rows.where("__ll is not null").select(*keys, _best(F.col("__ll")).alias("best"))
                   .groupBy(*keys, "best").agg(F.count("*").alias("n")), "language-counts").df
    tables = [("__declared", lambda t: _log_shares(t, ["__declared"], n_lang)),
              ("__suffix", lambda t: _log_shares(t, ["__suffix"], n_lang)),
              ("__host", lambda t: _host_priors(t.withColumnRenamed("__host", "host"), n_lang).withColumnRenamed("host", "__host"))]
    evidence = [F.col("__ll")]
    for (key, made), given in zip(tables, (declared, suffix, host)):
        if given is None:
            continue
        part = Table(made(counts.where(F.col(key).isNotNull())).withColumnRenamed("lp", f"__lp{key}"), "language-evidence")
        rows = rows.join(broadcast_within(part, BROADCAST_BYTES), key, "left")
        evidence.append(F.coalesce(F.col(f"__lp{key}"), F.array_repeat(F.lit(0.0), n_lang)))
    log_joint = evidence[0]
    for e in evidence[1:]:
        log_joint = F.zip_with(log_joint, e, lambda a, b: a + b)
    rows = rows.withColumn("__lj", log_joint)
    top = F.array_max("__lj")
    posterior = 1.0 / F.aggregate(F.transform("__lj", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    names = F.array(*[F.lit(x) for x in model.languages])
    language = F.get(names, _best(F.col("__lj")))
    keep = F.col("__lj").isNotNull() & (posterior >= min_posterior)
    if wanted is not None:
        keep = keep & language.isin(list(wanted))
    return rows.select(*own, language.alias("__language"), F.coalesce(posterior, F.lit(0.0)).alias("__posterior"),
                       F.coalesce(keep, F.lit(False)).alias("__keep"))


def accept(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` without the rejected documents."""
    return identify(docs, **kw).where("__keep").select(*[F.col(f"`{c}`") for c in docs.columns])


# --- evidence columns of raw pages ---

def markup_language(html: Column) -> Column:
    """The ``lang`` of the ``<html>`` tag, its primary part in lower case; else null."""
    tag = F.regexp_extract(html, r"(?i)<html\b([^>]*)>", 1)
    lang = ascii_lower(F.regexp_extract(tag, r"""(?i)\blang\s*=\s*["']?([A-Za-z]+)""", 1))
    return F.when(lang != "", lang)


def address_suffix(host: Column, path: Column) -> Column:
    """Last label of the host, with a two-letter first part of the path."""
    zone = F.element_at(F.split(host, r"\."), -1)
    return F.when(host != "", F.concat_ws("/", zone, F.nullif(ascii_lower(F.regexp_extract(path, r"^/([A-Za-z]{2})(?:/|$)", 1)), F.lit(""))))


def visible_text(html: Column) -> Column:
    """Text outside tags, scripts and styles, for language evidence only."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&#?[A-Za-z0-9]+;", " ")
