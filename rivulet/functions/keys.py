"""Stable hashed keys (F2, F3) and the title-derived partition key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import as_col

# Spark's xxhash64 starts from seed 42 and feeds each column's hash in as the
# seed of the next column.  XXH64 of one 64-bit value is a bijection, so one
# long hashes to 0 under seed 42; putting it first makes the next column be
# hashed with seed 0, i.e. plain XXH64 — computed in codegen, no UDF.
_SEED_ZERO_PREFIX = -365884300664092260


def xxh64_hex(col) -> Column:
    """XXH64 (seed 0) of the UTF-8 bytes of a string, 16 lower-case hex digits.

    NULL stays NULL (a NULL column would otherwise leave the seed unchanged).
    """
    c = as_col(col).cast("string")
    h = F.xxhash64(F.lit(_SEED_ZERO_PREFIX).cast("long"), c)
    return F.when(c.isNotNull(), F.lpad(F.lower(F.hex(h)), 16, "0"))


def entry_key(entry_id) -> Column:
    """Row key of an entry: hash of its source id (as text)."""
    return xxh64_hex(as_col(entry_id).cast("string"))


def feed_key(link) -> Column:
    """Row key of a feed: hash of its normalised link."""
    return xxh64_hex(link)


def iso_datetime(ts) -> Column:
    """Python ``datetime.isoformat()`` of a naive UTC timestamp.

    The fraction is printed only when the microseconds are not zero.
    """
    t = as_col(ts)
    base = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(t.cast("timestamp")) % 1000000
    return F.when(t.isNotNull(),
                  F.concat(base, F.when(micros != 0, F.concat(F.lit("."), F.date_format(t, "SSSSSS")))
                           .otherwise(F.lit(""))))


def post_key(title, content, draft_date) -> Column:
    """Row key of a post: hash of ``title_content_isoformat(draft_date)``.

    All three parts are required; any NULL or empty part gives NULL (which
    the validator reports).
    """
    t, c, d = as_col(title), as_col(content), as_col(draft_date)
    ok = t.isNotNull() & (t != "") & c.isNotNull() & (c != "") & d.isNotNull()
    return F.when(ok, xxh64_hex(F.concat_ws("_", t, c, iso_datetime(d))))


def partition_key_from_title(title) -> Column:
    """Snake-case a feed title into a storage partition key.

    ``_`` goes before every upper-case ASCII letter that is not the first
    character, the result is lower-cased and every character outside
    ``[a-z0-9_-]`` is dropped (which also removes surrounding whitespace).
    """
    t = as_col(title)
    snake = F.regexp_replace(t, "(?<!^)(?=[A-Z])", "_")
    return F.regexp_replace(F.lower(snake), "[^a-z0-9_-]", "")
