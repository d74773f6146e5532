"""URL filter: a cascade of Bloom filters over the corpus's key universe.

A page's keys are its host and the host's parent domains.  Level 1 encodes the
listed keys.  Every other key of the corpus is tested against it; the ones that
pass by chance are encoded in level 2, the listed keys that pass level 2 in
level 3, and so on until no key passes by chance.  For every key of the
universe the first level that it fails then tells exactly whether it is listed:
pages are judged without a join, from filters of a few bits per listed key.

Everything is built from DataFrame functions.  A filter is a constant array of
64-bit words in the plan.  Its size is computed from the counted keys before it
is built; a list that needs more than ``max_bytes`` is matched by a join on
distinct keys instead.

Defined cases: a null url or one without ``://`` has empty host and path, no
rule and the verdict ``allow``; hosts of over 127 labels are looked up by their
last 127 labels (a name of 253 characters has no more); repeated rows are judged
each; an empty table gives no rows; only the id and url columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

WORDS_PER_CHUNK = 1024
MAX_LEVELS = 64


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_keys(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.slice(F.reverse(F.split(host, r"\.")), 1, 127)
    n = F.size(labels)
    keys = F.transform(F.sequence(F.lit(0), n - 1),
                       lambda i: F.array_join(F.reverse(F.slice(labels, 1, n - i)), "."))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule string, its verdict) of the longest rule that fits, else nulls.
    A rule is (verdict, ``host/path``)."""
    name = verdict = F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _bit(key: Column, level: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits).cast("bigint"))


def _shape(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes) of a filter over n keys that others pass with chance p."""
    k = max(1, round(-math.log2(p)))
    return max(64, math.ceil(n * k / math.log(2) / 64) * 64), k


class Cascade:
    """The built levels (words, bits, hashes); ``contains`` is exact for keys of the universe."""

    def __init__(self, levels: list[tuple[Column, int, int]]):
        self.levels = levels

    def passes(self, key: Column, level: int) -> Column:
        words, bits, k = self.levels[level]
        out = F.lit(True)
        for j in range(k):
            b = _bit(key, level, j, bits)
            out = out & (F.getbit(F.get(words, F.floor(b / 64).cast("int")), (b % 64).cast("int")) == 1)
        return out

    def contains(self, key: Column) -> Column:
        listed = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            listed = F.when(self.passes(key, level), listed).otherwise(F.lit(level % 2 == 1))
        return listed


def _filter_words(keys: DataFrame, level: int, bits: int, k: int) -> Column:
    """The filter over ``keys`` as a constant array of 64-bit words.  Words are
    built by a grouped ``bit_or`` and packed by chunk, so that the last step sees
    one row per 1,024 words of a filter whose size is bounded beforehand."""
    at = F.explode(F.array(*[_bit(F.col("key"), level, j, bits) for j in range(k)])).alias("b")
    words = (keys.select(at)
             .select(F.floor(F.col("b") / 64).alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("v"))
             .unionByName(keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("v")))
             .groupBy("w").agg(F.bit_or("v").alias("v")))
    ordered = lambda c, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, v))), lambda x: x["v"]), ",")
    chunks = (words.groupBy(F.floor(F.col("w") / WORDS_PER_CHUNK).alias("c"))
              .agg(ordered("w", F.col("v").cast("string").alias("v")).alias("v")))
    text = chunks.agg(ordered("c", "v").alias("t")).first()["t"]
    return F.split(F.lit(text), ",").cast("array<bigint>")   # a constant: folded once per plan


def build_cascade(universe: DataFrame, listed: DataFrame, max_bytes: int = 8 << 20) -> Cascade | None:
    """``universe``: distinct ``key``s of the corpus, ``listed``: ``key``s on the
    list.  None if the first filter would need more than ``max_bytes``."""
    marks = listed.select("key").where("key is not null").distinct().withColumn("l", F.lit(True))
    keys = stored(universe.join(marks, "key", "left").select("key", F.col("l").isNotNull().alias("listed")), "url-keys")
    n = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    n_in, n_out = n.get(True, 0), n.get(False, 0)
    if n_in == 0:
        return Cascade([])
    cascade = Cascade([])
    p = min(0.5, n_in / (math.sqrt(2) * max(1, n_out)))
    inside = True
    alive = {True: keys.where("listed"), False: keys.where("not listed")}
    size = n_in
    for level in range(MAX_LEVELS):
        bits, k = _shape(size, p)
        if bits // 8 > max_bytes:
            return None
        cascade.levels.append((_filter_words(alive[inside].select("key"), level, bits, k), bits, k))
        alive[not inside] = alive[not inside].where(cascade.passes(F.col("key"), level))
        size = alive[not inside].count()
        if size == 0:
            return cascade
        inside, p = not inside, 0.5
    raise RuntimeError(f"the cascade did not close in {MAX_LEVELS} levels")


def judge_urls(pages: DataFrame, listed_of, rules: Sequence[tuple[str, str]], id_col: str = "page_id",
               url_col: str = "url", max_bytes: int = 8 << 20) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, listed_key (the longest
    listed key of its host, else null).  ``listed_of(universe)`` gives the listed
    ``key``s, from the corpus's keys or from a table of its own."""
    urls = pages.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").alias("u"))
    rows = urls.select(id_col, url_host(F.col("u")).alias("host"), url_path(F.col("u")).alias("path"))
    universe = stored(rows.select("host").distinct().select(F.explode(host_keys(F.col("host"))).alias("key")).distinct(), "url-universe")
    listed = listed_of(universe)
    cascade = build_cascade(universe, listed, max_bytes)
    if cascade is not None:
        hit = F.get(F.filter(host_keys(F.col("host")), cascade.contains), 0)
        rows = rows.withColumn("listed_key", hit)
    else:
        hosts = rows.select("host").distinct()
        found = (hosts.select("host", F.posexplode(host_keys(F.col("host"))).alias("i", "key"))
                 .join(listed.select("key").distinct(), "key").groupBy("host").agg(F.min_by("key", "i").alias("listed_key")))
        rows = rows.join(found, "host", "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("listed_key").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "listed_key")
