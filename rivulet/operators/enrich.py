"""Scoring and enrichment (U3a–U3f, U4, U5).

Model calls are pluggable: a *model factory* is a picklable callable that
builds a client once per task and returns ``predict(list[str]) -> list``.
:func:`score_text` runs it over Arrow batches of the text column, retries a
failing batch with exponential backoff, then its rows one by one, and applies an
error policy to the rows that still fail.
The default offline models are native column expressions (lexicon
sentiment, first-sentence summary) or Spark ML (hashing embedding), so
the pipeline runs without any outside service.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Iterator, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructType, _parse_datatype_string

from .. import fixed
from ..functions._col import as_col, let
from ..functions.html import clean_summary
from ..functions.structured import parse_sentiment_reply
from ..functions.text import format_summary, readability, truncate_by_sentences

# Offline sentiment lexicon of this engine (not part of the original,
# which calls a hosted model).  Lower-case words, four languages.
POSITIVE_WORDS = [
    "good", "great", "excellent", "love", "happy", "best", "wonderful", "positive", "success",
    "win", "bon", "bien", "heureux", "super", "meilleur", "gut", "toll", "glücklich", "besten",
    "bueno", "excelente", "feliz", "mejor", "éxito",
]
NEGATIVE_WORDS = [
    "bad", "poor", "terrible", "hate", "sad", "worst", "awful", "negative", "failure", "lose",
    "mauvais", "mal", "triste", "pire", "schlecht", "traurig", "schlimm", "malo", "peor",
    "fracaso",
]
TOKEN_SPLIT = r"[^\p{L}]+"
MIXED_BAND = 0.2


def tokens(text) -> Column:
    """Lower-cased letter runs; NULL text has no tokens."""
    return F.filter(F.split(F.lower(F.coalesce(as_col(text), F.lit(""))), TOKEN_SPLIT), lambda t: t != "")


def lexicon_sentiment(text) -> Column:
    """U3b offline model: struct(sentiment, score, positive, negative).

    score = (pos − neg) / max(1, pos + neg); no hits → Neutral; score above
    +0.2 → Positive, below −0.2 → Negative, otherwise Mixed."""
    def counts(toks):
        return F.struct(F.size(F.filter(toks, lambda t: t.isin(POSITIVE_WORDS))).cast("long").alias("p"),
                        F.size(F.filter(toks, lambda t: t.isin(NEGATIVE_WORDS))).cast("long").alias("n"))

    def build(c):
        pos, neg = c["p"], c["n"]
        score = (pos - neg) / F.greatest(F.lit(1), pos + neg)
        label = (F.when(pos + neg == 0, F.lit("Neutral"))
                 .when(score > MIXED_BAND, F.lit("Positive"))
                 .when(score < -MIXED_BAND, F.lit("Negative")).otherwise(F.lit("Mixed")))
        return F.struct(label.alias("sentiment"), score.cast("double").alias("score"),
                        pos.alias("positive"), neg.alias("negative"))
    # tokenised and counted once per row (bound by let, see functions._col)
    return let(let(tokens(text), counts), build)


def sentiment_reply(text) -> Column:
    """The offline model's answer in the hosted model's reply format."""
    s = lexicon_sentiment(text)
    return F.to_json(F.struct(s["sentiment"].alias("sentiment"), s["score"].alias("score")))


def first_sentence_summary(text) -> Column:
    """U3a offline model: the first sentence, formatted, within the limit."""
    return let(truncate_by_sentences(text, 1, fixed.MAX_SUMMARY_CHARACTERS), format_summary)


# ------------------------------------------------------------ registry --

class ModelRegistry(dict):
    """U3f: role → model factory.  Roles are checked before a job starts."""

    def require(self, *roles: str) -> None:
        missing = [r for r in roles if r not in self]
        if missing:
            raise ValueError(f"model roles not configured: {missing}")


def offline_registry() -> ModelRegistry:
    """The five roles of the original deployment, served by offline
    factories (summary, light summary, ranking, fast and deep embedding)."""
    def summary():
        import re as _re
        split = _re.compile(r"(?<=[.!?])\s+")
        return lambda texts: [None if t is None else split.split(t.strip(), 1)[0] for t in texts]

    def ranking():
        # the lexicon's answer in the hosted model's reply format
        import json as _json
        import re as _re
        good, bad, split = set(POSITIVE_WORDS), set(NEGATIVE_WORDS), _re.compile(r"[\W\d_]+")

        def reply(t):
            words = split.split((t or "").lower())
            pos, neg = sum(w in good for w in words), sum(w in bad for w in words)
            score = (pos - neg) / max(1, pos + neg)
            label = ("Neutral" if pos + neg == 0 else "Positive" if score > MIXED_BAND
                     else "Negative" if score < -MIXED_BAND else "Mixed")
            return _json.dumps({"sentiment": label, "score": score})
        return lambda texts: [reply(t) for t in texts]

    def embedding(dims):
        def factory():
            import numpy as np
            import zlib

            def predict(texts):
                out = []
                for t in texts:
                    v = np.zeros(dims, dtype=np.float32)
                    for w in (t or "").lower().split():
                        v[zlib.crc32(w.encode()) % dims] += 1.0
                    n = float(np.linalg.norm(v))
                    out.append((v / n if n else v).tolist())
                return out
            return predict
        return factory

    return ModelRegistry(MODEL_SUMMARY=summary, MODEL_SUMMARY_LIGHT=summary, MODEL_RANKING=ranking,
                         EMBEDDING_FAST=embedding(64), EMBEDDING_DEEP=embedding(256))


# ------------------------------------------------------ batch scoring --

def retry_call(fn: Callable, *args, retries: int = 3, delay_ms: int = 1000, backoff: float = 2.0,
               sleep=time.sleep):
    """Call ``fn``; on failure wait ``delay_ms`` (×``backoff`` each time)
    and try again, ``retries`` times; 1 + retries calls at most."""
    attempt, wait = 0, delay_ms
    while True:
        try:
            return fn(*args)
        except Exception:
            if attempt >= retries:
                raise
            sleep(wait / 1000.0)
            wait *= backoff
            attempt += 1


class ChatPrompt(NamedTuple):
    """System prompt, user template (``{content_text}`` is the text) and the
    reply's token limit of a hosted chat model."""
    system: str
    user: str = "{content_text}"
    max_tokens: int | None = None

    def request(self, text: str | None) -> dict:
        return {"messages": [{"role": "system", "content": self.system},
                             {"role": "user", "content": self.user.replace("{content_text}", text or "")}],
                "max_tokens": self.max_tokens}


def score_text(df: DataFrame, text_col: str, model_factory: Callable, out_col: str,
               out_type: str = "string", on_error: str = "null", default=None,
               retries: int = 1, delay_ms: int = 2000, backoff: float = 1.0,
               prompt: ChatPrompt | None = None) -> DataFrame:
    """Add ``out_col`` = model(text) for every row, in Arrow batches of
    the text column alone.

    ``model_factory()`` runs once per task (one client per task).  A client with
    a true ``chat`` attribute gets chat requests made from ``prompt`` (messages
    and token limit), any other the bare texts.  A batch that still fails after
    the retries is tried row by row; a row that fails follows ``on_error``:
    ``raise`` fails the task (Spark retries it, then the job fails), ``null``
    gives NULL, ``default`` gives ``default``; an ``{out_col}_error`` column
    keeps the message so failures can be reported once per message (A3).
    """
    schema = StructType().add("value", _parse_datatype_string(out_type)).add("error", "string")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = model_factory()
        asks = prompt is not None and getattr(predict, "chat", False)

        def call(some):
            out = retry_call(predict, some, retries=retries, delay_ms=delay_ms, backoff=backoff)
            if len(out) != len(some):
                raise ValueError(f"the model gave {len(out)} answers to {len(some)} texts")
            return list(out)

        for texts in batches:
            given = [prompt.request(t) for t in texts] if asks else texts.tolist()
            try:
                values, errors = call(given), [None] * len(given)
            except Exception as batch_error:
                values, errors = [], []
                for one in given:
                    try:
                        if len(given) == 1:
                            raise batch_error
                        values += call([one])
                        errors.append(None)
                    except Exception as e:  # policy decides
                        if on_error == "raise":
                            raise
                        values.append(default if on_error == "default" else None)
                        errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"value": pd.Series(values, dtype="object"), "error": pd.Series(errors, dtype="object")})

    model = pandas_udf(run, schema)
    cols = [c for c in df.columns if c not in (out_col, f"{out_col}_error")]
    scored = df.select(*cols, model(F.col(text_col).cast("string")).alias("__scored"))
    return scored.select(*cols, F.col("__scored.value").alias(out_col), F.col("__scored.error").alias(f"{out_col}_error"))


def hashing_embedding(df: DataFrame, text_col: str, out_col: str = "embedding",
                      dims: int = 64) -> DataFrame:
    """U3c offline model: hashed term frequencies, L2-normalised, as
    ``array<float>`` (Spark ML, runs in the JVM)."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array
    tmp = df.withColumn("__tok", tokens(F.col(text_col)))
    tf = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=dims).transform(tmp)
    nv = Normalizer(inputCol="__tf", outputCol="__nv", p=2.0).transform(tf)
    return nv.withColumn(out_col, vector_to_array("__nv", "float32")).drop("__tok", "__tf", "__nv")


def enrich(entries: DataFrame, text_col: str = "summary", embed: bool = True) -> DataFrame:
    """U3e: summary → sentiment → readability → embedding, all feeds in one
    job (offline models; swap in :func:`score_text` for hosted ones)."""
    outputs = {"ai_summary", "sentiment", "sentiment_score", "readability", "embedding"}
    cols = [c for c in entries.columns if c.lower() not in outputs]   # outputs replace same-named inputs
    text = F.col(text_col)       # scored whole, not its summary
    s = entries.select(*entries.columns, first_sentence_summary(text).alias("__sum"), lexicon_sentiment(text).alias("__sent"),
                       readability(text).alias("__read"))
    if embed:
        s = hashing_embedding(s, text_col, "__emb")
    return s.select(*cols, F.col("__sum").alias("ai_summary"), F.col("__sent.sentiment").alias("sentiment"),
                    F.col("__sent.score").alias("sentiment_score"), F.col("__read").alias("readability"),
                    *([F.col("__emb").alias("embedding")] if embed else []))


def clean_then_enrich(items: DataFrame, text_col: str = "summary") -> DataFrame:
    return enrich(items.withColumn(text_col, clean_summary(F.col(text_col))), text_col)


# ----------------------------------------------- pluggable model steps --

def improve_summary(df: DataFrame, text_col: str, model_factory: Callable, out_col: str = "ai_summary",
                    **policy) -> DataFrame:
    """Model summary of ``text_col``; the reply is stripped."""
    from ..functions._regex import strip_ws
    policy.setdefault("prompt", ChatPrompt(fixed.SUMMARY_SYSTEM_PROMPT, max_tokens=fixed.SUMMARY_MAX_TOKENS))
    s = score_text(df, text_col, model_factory, out_col, **policy)
    return s.withColumn(out_col, strip_ws(F.col(out_col)))


def analyze_sentiment(df: DataFrame, text_col: str, model_factory: Callable, **policy) -> DataFrame:
    """Model reply ``{"sentiment", "score"}`` parsed (F21); a failed
    call or a bad reply gives (Error, 0.0)."""
    policy.setdefault("prompt", ChatPrompt(fixed.SENTIMENT_SYSTEM_PROMPT, max_tokens=fixed.SENTIMENT_MAX_TOKENS))
    s = score_text(df, text_col, model_factory, "__reply", **policy)
    p = parse_sentiment_reply(F.col("__reply"))
    return (s.withColumn("sentiment", p["sentiment"]).withColumn("sentiment_score", p["score"])
            .withColumnRenamed("__reply_error", "sentiment_error").drop("__reply"))


def generate_embedding(df: DataFrame, text_col: str, model_factory: Callable, out_col: str = "embedding",
                       **policy) -> DataFrame:
    """Model embedding as ``array<float>``."""
    return score_text(df, text_col, model_factory, out_col, "array<float>", **policy)


def rank_content(df: DataFrame, text_col: str, model_factory: Callable, out_col: str = "ranking", **policy) -> DataFrame:
    """U3d: summary and score 1..10 in one reply, asked with the engagement prompt
    pair; parsed by F22 into ``{out_col}`` = struct(summary, score, ok)."""
    from ..functions.structured import parse_summary_reply
    policy.setdefault("prompt", ChatPrompt(fixed.ENGAGEMENT_SYSTEM_PROMPT, fixed.ENGAGEMENT_USER_TEMPLATE))
    s = score_text(df, text_col, model_factory, out_col, **policy)
    return s.withColumn(out_col, parse_summary_reply(out_col))


def enrich_with_models(entries: DataFrame, registry: ModelRegistry, text_col: str = "summary",
                       summary_role: str = "MODEL_SUMMARY", embedding_role: str = "EMBEDDING_FAST", **policy) -> DataFrame:
    """U3e with U3f routing: summary → sentiment → readability → embedding
    with the registry's models; roles are checked before any work.  The light
    summary model and the deep embedding are chosen by their role's name."""
    registry.require(summary_role, "MODEL_RANKING", embedding_role)
    s = improve_summary(entries, text_col, registry[summary_role], **policy)
    s = analyze_sentiment(s, "ai_summary", registry["MODEL_RANKING"], **policy)
    s = s.withColumn("readability", readability(F.col("ai_summary")))
    return generate_embedding(s, "ai_summary", registry[embedding_role], **policy)
