"""Booleans and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ._col import as_col
from ._regex import strip_ws


def str_to_bool(col, on_error: str = "null", default: bool | None = None) -> Column:
    """true/t/yes/1 → True, false/f/no/0 → False (trimmed, any case),
    NULL → False.  Other text follows ``on_error``: ``raise`` fails the
    task with the value in the message, ``null`` gives NULL, ``default``
    gives ``default``."""
    c = as_col(col)
    v = F.lower(strip_ws(c.cast("string")))
    out = (F.when(c.isNull(), F.lit(False))
           .when(v.isin(fixed.TRUE_WORDS), F.lit(True))
           .when(v.isin(fixed.FALSE_WORDS), F.lit(False)))
    if on_error == "raise":
        return out.otherwise(F.raise_error(F.concat(F.lit("Invalid boolean value: "), v)).cast("boolean"))
    if on_error == "default":
        return out.otherwise(F.lit(default))
    return out


def engagement_score(likes, shares, comments) -> Column:
    """0.4·likes + 0.4·shares + 0.2·comments, in that order."""
    wl, ws, wc = fixed.ENGAGEMENT_WEIGHTS
    return (as_col(likes) * wl + as_col(shares) * ws + as_col(comments) * wc)
