"""Relative references and hosts in other scripts (F1, P10, V5).

``resolve_url`` is the resolution of RFC 3986, its dot segments taken out by a fold
with a stack; ``punycode`` and ``ascii_host`` are the encoding of RFC 3492, a fold
over the code points in ascending order.  Both are native expressions.

Hosts are lower-cased and the ideographic full stops divide labels; no other mapping
of characters is applied (no compatibility or composed forms).  NULL gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import as_col, let
from ._regex import strip_ws

# scheme, authority, path, query, fragment, each with its sign
PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"

# Fixed values of RFC 3492.
BASE, TMIN, TMAX, SKEW, DAMP, INITIAL_BIAS, INITIAL_N = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
MAX_DIGITS = 12          # of one number: more than a label of any length in use needs


def _parts(url: Column) -> Column:
    return F.struct(*[F.regexp_extract(url, PARTS, i + 1).alias(n) for i, n in enumerate(("scheme", "authority", "path", "query", "fragment"))])


def remove_dot_segments(path) -> Column:
    """A path without ``.`` and ``..``; a path without a leading slash stays."""
    def fold(p):
        step = lambda acc, s: (F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(s == ".", acc)
                               .otherwise(F.concat(acc, F.array(s))))
        segments = F.split(p, "/", -1)
        kept = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.array(F.lit("")), step)
        closed = F.when(p.rlike(r"(?s)(^|/)\.{1,2}$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
        return F.when(p.rlike(r"^/(?s:.*)") & p.contains("."), F.array_join(closed, "/")).otherwise(p)
    return let(as_col(path), fold)


def resolve_url(base, ref) -> Column:
    """The address that ``ref`` means in a document at ``base``.  White space around it goes, and
    line breaks and tabs within; NULL without a scheme in either."""
    def join(x):
        b, r = x["b"], x["r"]
        own, there = r["scheme"] != "", r["authority"] != ""
        merged = F.when((b["path"] == "") & (b["authority"] != ""), F.concat(F.lit("/"), r["path"])).otherwise(
            F.concat(F.regexp_replace(b["path"], r"[^/]*$", ""), r["path"]))
        path = F.when(own | there | r["path"].startswith("/"), r["path"]).when(r["path"] == "", b["path"]).otherwise(merged)
        kept = ~own & ~there & (r["path"] == "")
        scheme = F.when(own, r["scheme"]).otherwise(b["scheme"])
        out = F.concat(F.lower(scheme), F.when(own | there, r["authority"]).otherwise(b["authority"]),
                       F.when(kept, path).otherwise(remove_dot_segments(path)),
                       F.when(kept & (r["query"] == ""), b["query"]).otherwise(r["query"]), r["fragment"])
        return F.when(F.coalesce(scheme, F.lit("")) != "", out)
    clean = lambda c: F.translate(strip_ws(as_col(c)), "\t\r\n", "")
    given = F.struct(let(F.coalesce(clean(base), F.lit("")), _parts).alias("b"), let(clean(ref), _parts).alias("r"))
    return F.when(as_col(ref).isNotNull(), let(given, join))


def _digit(d: Column) -> Column:
    return F.substring(F.lit(DIGITS), (d + 1).cast("int"), F.lit(1))


def _number(delta: Column, bias: Column) -> Column:
    """A generalised variable-length integer."""
    start = F.struct(delta.cast("long").alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(acc, i):
        t = F.least(F.greatest(i * BASE - bias, F.lit(TMIN)), F.lit(TMAX)).cast("long")
        last = acc["q"] < t
        digit = F.when(last, acc["q"]).otherwise(t + F.pmod(acc["q"] - t, BASE - t))
        rest = F.when(last, acc["q"]).otherwise(F.floor((acc["q"] - t) / (BASE - t)))
        return F.struct(F.when(acc["done"], acc["q"]).otherwise(rest).cast("long").alias("q"),
                        F.when(acc["done"], acc["out"]).otherwise(F.concat(acc["out"], _digit(digit))).alias("out"), (acc["done"] | last).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_DIGITS)), start, step, lambda acc: acc["out"])


def _adapt(delta: Column, points: Column, first: Column) -> Column:
    d = F.floor(delta / F.when(first, DAMP).otherwise(2))
    limit = (BASE - TMIN) * TMAX // 2

    def step(acc, _):
        more = acc["d"] > limit
        return F.struct(F.when(more, F.floor(acc["d"] / (BASE - TMIN))).otherwise(acc["d"]).cast("long").alias("d"),
                        (acc["k"] + F.when(more, BASE).otherwise(0)).cast("long").alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_DIGITS)), F.struct((d + F.floor(d / points)).cast("long").alias("d"), F.lit(0).cast("long").alias("k")), step,
                       lambda acc: (acc["k"] + F.floor((BASE - TMIN + 1) * acc["d"] / (acc["d"] + SKEW))).cast("long"))


def punycode(label) -> Column:
    """The punycode of a label, without the ``xn--`` before it."""
    def encode(points):
        basic = F.filter(points, lambda c: c < INITIAL_N)
        plain = F.array_join(F.transform(basic, lambda c: F.char(c)), "")
        state = "struct<out:string,delta:long,n:long,h:long,bias:long,first:boolean>"
        start = F.struct(F.concat(plain, F.when(F.size(basic) > 0, "-").otherwise("")).alias("out"), F.lit(0).alias("delta"), F.lit(INITIAL_N).alias("n"),
                         F.size(basic).alias("h"), F.lit(INITIAL_BIAS).alias("bias"), F.lit(True).alias("first")).cast(state)

        def char(acc, c, m):
            before = F.when(c < m, acc["delta"] + 1).otherwise(acc["delta"])
            here = c == m
            return F.struct(F.when(here, F.concat(acc["out"], _number(acc["delta"], acc["bias"]))).otherwise(acc["out"]).alias("out"),
                            F.when(here, 0).otherwise(before).alias("delta"), acc["n"], F.when(here, acc["h"] + 1).otherwise(acc["h"]).alias("h"),
                            F.when(here, _adapt(acc["delta"], acc["h"] + 1, acc["first"])).otherwise(acc["bias"]).alias("bias"),
                            (acc["first"] & ~here).alias("first")).cast(state)

        def point(acc, m):
            entered = F.struct(acc["out"], (acc["delta"] + (m - acc["n"]) * (acc["h"] + 1)).alias("delta"), m.cast("long").alias("n"), acc["h"], acc["bias"],
                               acc["first"]).cast(state)
            return let(F.aggregate(points, entered, lambda a, c: char(a, c, m)), lambda a: F.struct(
                a["out"], (a["delta"] + 1).alias("delta"), (a["n"] + 1).alias("n"), a["h"], a["bias"], a["first"]).cast(state))
        rare = F.array_sort(F.array_distinct(F.filter(points, lambda c: c >= INITIAL_N)))
        return F.aggregate(rare, start, point, lambda acc: acc["out"])
    return let(F.transform(F.regexp_extract_all(as_col(label), F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c)), encode)


def ascii_host(host) -> Column:
    """A host with the labels of other scripts as ``xn--`` labels, in lower case."""
    def build(h):
        labels = F.transform(F.split(F.translate(h, "。．｡", "..."), r"\.", -1),
                             lambda s: F.when(s.rlike(r"[^\x00-\x7f]"), F.concat(F.lit("xn--"), punycode(s))).otherwise(s))
        return F.when(h.rlike(r"[^\x00-\x7f]"), F.array_join(labels, ".")).otherwise(h)
    return let(F.lower(as_col(host)), build)
