"""Array, map and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from .. import fixed
from ._col import as_col, let


def tags_to_terms(col, dtype: DataType) -> Column:
    """F16: NULL → []; a string → [s]; a list of ``{term}`` → the terms;
    a list of strings passes.  ``dtype`` is the input column's type."""
    c = as_col(col)
    empty = F.array().cast("array<string>")
    if isinstance(dtype, StringType):
        return F.when(c.isNull(), empty).otherwise(F.array(c))
    if isinstance(dtype, ArrayType) and isinstance(dtype.elementType, StructType):
        return F.coalesce(F.transform(c, lambda x: x["term"]), empty)
    if isinstance(dtype, ArrayType):
        return F.coalesce(c.cast("array<string>"), empty)
    raise TypeError(f"tags must be string or array, got {dtype.simpleString()}")


def full_content(col, dtype: DataType) -> Column:
    """``content[0].value`` of a list, a plain string as is, else the
    default text."""
    c = as_col(col)
    default = F.lit(fixed.DEFAULT_CONTENT)
    if isinstance(dtype, StringType):
        return F.coalesce(c, default)
    if isinstance(dtype, ArrayType) and isinstance(dtype.elementType, StructType):
        return F.coalesce(F.get(c, 0)["value"], default)
    return default


def image_to_json(col) -> Column:
    """image map → JSON text; NULL or empty map → NULL."""
    c = as_col(col)
    return F.when(c.isNotNull() & (F.size(c) > 0), F.to_json(c))


def image_from_json(col) -> Column:
    """JSON text → ``map<string,string>``; NULL/empty/bad → NULL."""
    return let(as_col(col), lambda c: F.when(c.isNotNull() & (c != ""),
                                             F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"})))


def embedding_to_json(col) -> Column:
    """F19."""
    return F.to_json(as_col(col))


def json_path(col, path: str) -> Column:
    """value at a JSON path as text; missing → NULL."""
    return F.get_json_object(as_col(col), path)


SENTIMENT_REPLY_SCHEMA = "sentiment string, score double"
SUMMARY_REPLY_SCHEMA = "summary string, score double"


def parse_sentiment_reply(reply) -> Column:
    """``{"sentiment": .., "score": ..}`` → struct(sentiment, score);
    anything unparsable or incomplete → (Error, 0.0)."""
    def build(r):
        ok = r.isNotNull() & r["sentiment"].isNotNull() & r["score"].isNotNull()
        return F.struct(
            F.when(ok, r["sentiment"]).otherwise(F.lit(fixed.ERROR_SENTIMENT)).alias("sentiment"),
            F.when(ok, r["score"]).otherwise(F.lit(0.0)).alias("score"))
    # parsed once: a struct of fields over one parse would be inlined per field
    return let(F.from_json(F.trim(as_col(reply)), SENTIMENT_REPLY_SCHEMA), build)


def parse_summary_reply(reply) -> Column:
    """``{"summary": .., "score": 1..10}`` → struct(summary, score, ok)."""
    lo, hi = fixed.REPLY_SCORE_RANGE

    def build(r):
        ok = (r.isNotNull() & r["summary"].isNotNull() & r["score"].between(lo, hi))
        return F.struct(F.when(ok, r["summary"]).alias("summary"),
                        F.when(ok, r["score"]).alias("score"),
                        F.coalesce(ok, F.lit(False)).alias("ok"))
    return let(F.from_json(F.trim(as_col(reply)), SUMMARY_REPLY_SCHEMA), build)
