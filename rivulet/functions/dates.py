"""Date parsing and formatting.

Parsing tries a list of formats with ``try_to_timestamp`` and keeps the
first success; nothing raises, a failure is NULL.  Spark cannot parse
day-of-week names, so a leading ``Mon,`` is removed first.  Times without
an offset are read as UTC (the session time zone is pinned to UTC).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType, TimestampType

from ._col import as_col, let
from ._regex import strip_ws

# Formats by the shape of the text (after a leading weekday is removed);
# inside a shape the first format that parses wins.  A format of one shape
# cannot parse text of another, so dispatching on the shape only saves the
# failed attempts (each one a caught parse exception).
SHAPES = [
    # (shape pattern, formats; None = Spark's ISO-8601 cast)
    (r"^\d{4}-\d{2}-\d{2}", [None, "yyyy-MM-dd HH:mm:ss Z"]),
    (r"^\d{1,2} [A-Za-z]{3,9} \d{4}", ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z",
                                        "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm",
                                        "d MMM yyyy", "d MMMM yyyy HH:mm:ss Z", "d MMMM yyyy HH:mm:ss z",
                                        "d MMMM yyyy HH:mm:ss", "d MMMM yyyy HH:mm", "d MMMM yyyy"]),
    (r"^\d{1,2} [A-Za-z]{3,9} \d{2}( |$)", ["d MMM yy HH:mm:ss Z", "d MMM yy HH:mm:ss z", "d MMM yy HH:mm:ss",
                                             "d MMM yy HH:mm Z", "d MMM yy HH:mm z", "d MMM yy HH:mm", "d MMM yy"]),
    (r"^[A-Za-z]{3,9} \d{1,2} \d{2}:", ["MMM d HH:mm:ss yyyy", "MMM d HH:mm:ss z yyyy", "MMM d HH:mm:ss Z yyyy"]),
    (r"^[A-Za-z]{3,9} \d{1,2},? \d{4}", ["MMMM d, yyyy HH:mm:ss", "MMM d, yyyy HH:mm:ss", "MMMM d, yyyy h:mm a",
                                          "MMM d, yyyy h:mm a", "MMMM d, yyyy h:mm:ss a", "MMM d, yyyy h:mm:ss a",
                                          "MMMM d, yyyy HH:mm", "MMM d, yyyy HH:mm", "MMMM d, yyyy", "MMM d, yyyy",
                                          "MMM d yyyy", "MMMM d yyyy"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}", ["yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}", ["MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy"]),
    (r"^\d{8}", ["yyyyMMdd'T'HHmmss'Z'", "yyyyMMdd"]),
]
# Spark cannot parse weekday names.
WEEKDAY = r"^(?:[A-Za-z]{3,9},\s*|(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?\s+)"

EPOCH = "1970-01-01 00:00:00"


def parse_date_text(text) -> Column:
    """Parse a date string in many formats; NULL or unparsable → NULL."""
    def body(s):
        t = F.regexp_replace(F.regexp_replace(s, WEEKDAY, ""), r"\s+", " ")
        out = F.lit(None).cast("timestamp")
        for shape, fmts in reversed(SHAPES):
            tries = [F.try_to_timestamp(s) if f is None else F.try_to_timestamp(t, F.lit(f)) for f in fmts]
            out = F.when(t.rlike(shape), F.coalesce(*tries)).otherwise(out)
        return out
    return let(strip_ws(as_col(text)), body)


def parse_date(col, dtype: DataType = StringType()) -> Column:
    """NULL → NULL; timestamp passes; number → Unix seconds; string →
    :func:`parse_date_text`."""
    c = as_col(col)
    if isinstance(dtype, TimestampType):
        return c
    if isinstance(dtype, NumericType):
        return F.timestamp_micros((c.cast("double") * 1_000_000).cast("long"))
    return parse_date_text(c.cast("string"))


def parse_date_or_epoch(col, dtype: DataType = StringType()) -> Column:
    """Absent → epoch; present but unparsable stays NULL (validator flags it)."""
    c = as_col(col)
    return F.when(c.isNull(), F.lit(EPOCH).cast("timestamp")).otherwise(parse_date(c, dtype))


def month_key(ts) -> Column:
    """``yyyy-MM`` partition key."""
    return F.date_format(as_col(ts), "yyyy-MM")


def rfc1123(ts) -> Column:
    """``Wed, 26 Feb 2025 18:42:40 +0000`` for a UTC timestamp."""
    return F.concat(F.date_format(as_col(ts), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def iso_utc(ts) -> Column:
    """ISO-8601 with offset, fraction only when non-zero
    (``datetime.isoformat()`` of an aware UTC time)."""
    t = as_col(ts)
    micros = F.unix_micros(t.cast("timestamp")) % 1000000
    frac = F.when(micros != 0, F.concat(F.lit("."), F.date_format(t, "SSSSSS"))).otherwise(F.lit(""))
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), frac, F.lit("+00:00"))


def epoch_default(ts) -> Column:
    return F.coalesce(as_col(ts), F.lit(EPOCH).cast("timestamp"))
