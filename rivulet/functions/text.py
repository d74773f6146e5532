"""Text functions: sentence split, truncation, summary format, counts,
readability, prompt rendering (F5–F8, F10e–F10g, F23, F25).

All are native Column expressions (whole-stage codegen, no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ._col import as_col, let
from ._regex import WS, WS_CHARS, fold_ws, strip_ws

# U+E000 is private use; the original also reserves it as a separator.
_SEP = "\ue000"
_SENTENCE_END = f"([.!?]){WS}+"


def sentences(text) -> Column:
    """Split text into sentences: a sentence ends at ``.``, ``!`` or ``?``
    followed by whitespace.  Rule-based stand-in for a trained sentence model (no
    abbreviation list).  Empty pieces are dropped; NULL gives NULL."""
    t = strip_ws(as_col(text))
    marked = F.regexp_replace(t, _SENTENCE_END, "$1" + _SEP)
    return F.filter(F.split(marked, _SEP), lambda s: s != "")


def truncate_markdown(text, max_sentences: int = 0, max_chars: int = 0, pieces: Column | None = None) -> Column:
    """First ``max_sentences`` sentences joined by one space; then, if longer
    than ``max_chars``, cut to ``max_chars``, drop what follows the last line
    break and strip.  A limit of 0 is off.  NULL or empty gives ''.  ``pieces`` are
    the text's sentences where they come from elsewhere (corpus statistics)."""
    out = F.coalesce(as_col(text), F.lit(""))
    if max_sentences > 0:
        own = sentences(out) if pieces is None else F.coalesce(pieces, F.array().cast("array<string>"))
        out = F.array_join(F.slice(own, 1, max_sentences), " ")
    if max_chars > 0:
        def cut(x):
            short = strip_ws(F.regexp_replace(F.substring(x, 1, max_chars), "\n[^\n]*\\z", ""))
            return F.when(F.length(x) > max_chars, short).otherwise(x)
        out = let(out, cut)
    return out


def truncate_by_sentences(text, max_sentences: int, max_chars: int, pieces: Column | None = None) -> Column:
    """Add whole sentences (each followed by a space) while the running text
    plus the next sentence stays within ``max_chars``; stop at the first that
    does not fit; at most ``max_sentences``; strip the result.  ``pieces`` are the
    text's sentences where they come from elsewhere."""
    init = F.struct(F.lit("").alias("r"), F.lit(False).alias("stop"))

    def step(acc, s):
        full = acc["stop"] | ((F.length(acc["r"]) + F.length(s)) > max_chars)
        return F.when(full, F.struct(acc["r"].alias("r"), F.lit(True).alias("stop"))) \
                .otherwise(F.struct(F.concat(acc["r"], s, F.lit(" ")).alias("r"),
                                    F.lit(False).alias("stop")))

    return F.aggregate(F.slice(sentences(text) if pieces is None else pieces, 1, max_sentences), init, step,
                       lambda acc: strip_ws(acc["r"]))


def format_summary(text) -> Column:
    """Strip, upper-case the first character, lower-case all the others."""
    s = strip_ws(as_col(text))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 2147483647)))


def word_count(text) -> Column:
    """Number of whitespace-separated words (Python ``len(t.split())``)."""
    return F.regexp_count(fold_ws(as_col(text)), F.lit("[^ ]+")).cast("long")


def sentence_mark_count(text) -> Column:
    """Occurrences of ``.``, ``!`` and ``?``."""
    t = as_col(text)
    return (F.length(t) - F.length(F.translate(t, ".!?", ""))).cast("long")


def nonspace_char_count(text) -> Column:
    """Characters that are not whitespace (sum of word lengths)."""
    return F.length(F.translate(as_col(text), WS_CHARS, "")).cast("long")


def readability_raw(text) -> Column:
    """206.835 − 1.015·words/max(1,marks) − 84.6·chars/max(1,words).

    Characters per word stand in for syllables per word, as in the original
    approximation.  Operation order matches it so results are bit-identical.
    """
    # repeated sub-expressions here are unconditional, so whole-stage codegen
    # evaluates each count once (subexpression elimination)
    w = word_count(text)
    s = sentence_mark_count(text)
    c = nonspace_char_count(text)
    return (F.lit(fixed.READABILITY_BASE)
            - F.lit(fixed.READABILITY_WORDS_PER_SENTENCE) * (w / F.greatest(F.lit(1), s))
            - F.lit(fixed.READABILITY_CHARS_PER_WORD) * (c / F.greatest(F.lit(1), w)))


def round2(x) -> Column:
    """Two-decimal rounding as floor(x·100 + 0.5)/100: the same IEEE steps in
    every engine, so results compare bit for bit."""
    return F.floor(as_col(x) * 100 + 0.5) / 100


def readability(text) -> Column:
    return round2(readability_raw(text))


def readability_cents(text) -> Column:
    """Readability ×100 as an exact integer, for exact sums and means."""
    return F.floor(readability_raw(text) * 100 + 0.5).cast("long")


def render_prompt(text, template: str = fixed.ENGAGEMENT_USER_TEMPLATE) -> Column:
    """Substitute ``{content_text}`` in a user prompt template."""
    return F.replace(F.lit(template), F.lit("{content_text}"), as_col(text))


def chat_messages(system: str, user) -> Column:
    """``[{role: system, content}, {role: user, content}]`` for one row."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                   F.struct(F.lit("user").alias("role"), as_col(user).alias("content")))


def preview(text, n: int = fixed.TEXT_PREVIEW_CHARS) -> Column:
    return F.substring(as_col(text), 1, n)


def sentinel_to_null(content) -> Column:
    """Missing content is NULL; the private-use sentinel and '' map to NULL."""
    c = as_col(content)
    return F.when((c == fixed.MISSING_CONTENT_SENTINEL) | (c == ""), F.lit(None).cast("string")).otherwise(c)


def first_line(text) -> Column:
    return F.regexp_extract(as_col(text), "^([^\n]*)", 1)
