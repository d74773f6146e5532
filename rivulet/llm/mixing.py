"""Mixing sources to target weights by temperature.

Weights are token shares raised to an exponent between 0 (uniform) and 1
(natural).  The exponent is the largest whose weights reach ``entropy_share`` of
the greatest possible entropy; if some source would then be repeated more than
``max_repeats`` times, it is raised until none is.  Both are found by sectioning
the interval, each round one aggregate over the table of source totals.

A source's budget is its weight times ``budget`` tokens.  Whole epochs take every
document.  The last, partial epoch takes blocks of documents in a permuted order
while they fit, and of the block at the edge the documents, permuted, that still
fit.  Blocks hold about the square root of their source's documents, so neither
a block nor the list of a source's blocks grows with the input in proportion:
running sums are taken over blocks first, then within one block per source, and
a source of any size is never sorted as a whole.

Everything is DataFrame functions.

Defined cases: null text has no tokens; documents without tokens are never taken;
null source is a source of its own; null ids and repeated rows are rows like any
other (rows of one id and text share a place in the order); ties in the order are
broken by id; an empty table, or one without tokens, gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Table, broadcast_within, stored

ENTROPY_SHARE = 0.95
MAX_REPEATS = 4.0
SECTIONS = 32
ROUNDS = 7
SEED = 42


def token_count(text: Column) -> Column:
    """Words between white space (x20, x09-x0D)."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("bigint")


def _section(totals: DataFrame, lo: float, hi: float, measure, fits) -> float:
    """The least exponent in [lo, hi] that ``fits``, given that hi does and that
    fitting is monotone; ``measure(exponent)`` is an aggregate over the totals."""
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)]
        row = totals.agg(*[measure(a).alias(f"m{i}") for i, a in enumerate(grid)]).first()
        at = next((i for i, m in enumerate(row) if fits(m)), SECTIONS)
        if at == 0:
            return grid[0]
        lo, hi = grid[at - 1], grid[at]
    return hi


def _powers(a: float) -> Column:
    return F.pow(F.col("share"), F.lit(float(a)))


def _entropy(a: float) -> Column:
    z = F.sum(_powers(a))
    return F.log(z) - F.lit(float(a)) * F.sum(_powers(a) * F.log("share")) / z


def exponent(totals: DataFrame, repeats_at_natural: float, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS) -> float:
    """For ``totals`` (share > 0, summing to 1).  ``repeats_at_natural``: budget over corpus tokens."""
    if repeats_at_natural > max_repeats:
        raise ValueError("the budget needs more repetitions than max_repeats allows")
    n = totals.count()
    if n < 2:
        return 1.0
    target = entropy_share * float(totals.agg(F.log(F.count("*").cast("double"))).first()[0])
    # entropy falls as the exponent grows: the largest that reaches the target, or the natural one
    flipped = lambda b: _entropy(1.0 - b)
    a = 1.0 - _section(totals, 0.0, 1.0, flipped, lambda h: h >= target)
    most = lambda x: F.lit(repeats_at_natural) * F.max(F.pow(F.col("share"), F.lit(float(x) - 1.0))) / F.sum(_powers(x))
    return _section(totals, a, 1.0, most, lambda r: r <= max_repeats * (1 + 1e-12))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None,
        entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """One row per document and epoch it is taken in: (id, source, n_tokens, weight,
    epoch, block, block_key, doc_key).  The order of training is by epoch, block_key,
    doc_key.  ``budget``: tokens, as many as the corpus holds by default."""
    rows = stored(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                              token_count(F.col(f"`{text_col}`")).alias("n_tokens"),
                              F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit(seed)).alias("h"))
                  .where("n_tokens > 0"), "mix-docs")
    sums = stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "mix-sources")
    corpus = sums.agg(F.sum("tokens")).first()[0] or 0
    want = corpus if budget is None else budget
    totals = sums.withColumn("share", F.col("tokens") / F.lit(float(max(1, corpus))))
    a = exponent(totals, want / max(1, corpus), entropy_share, max_repeats) if corpus else 1.0
    z = totals.agg(F.sum(_powers(a))).first()[0] or 1.0
    weight = _powers(a) / F.lit(z)
    tokens = F.floor(weight * F.lit(float(want))).cast("bigint")
    # a budget within rounding of whole epochs is whole epochs
    full = F.floor(tokens / F.col("tokens") + 1e-9).cast("int")
    plan = Table(totals.select("source", weight.alias("weight"), full.alias("full"), (tokens - full * F.col("tokens")).alias("rest"),
                               F.ceil(F.sqrt(F.col("docs").cast("double"))).cast("bigint").alias("blocks")), "mix-plan")
    planned = (rows.join(broadcast_within(plan, BROADCAST_BYTES).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
               .drop("s").withColumn("block", F.pmod(F.xxhash64("h", F.lit("block")), F.col("blocks")).cast("int")))
    # the partial epoch: blocks in permuted order, with the tokens before them
    key = lambda epoch: F.xxhash64(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull(), F.col("block"), epoch, F.lit(seed))
    each = planned.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"), F.first("full").alias("full"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy("bk", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = (each.withColumn("bk", key(F.col("full"))).withColumn("upto", F.sum("t").over(order))
              .select(F.col("source").alias("s"), F.col("block").alias("b"), (F.col("rest") - F.col("upto") + F.col("t")).alias("room"), "t"))
    blocks = Table(blocks.where("room > 0").select("s", "b", "room", (F.col("room") < F.col("t")).alias("edge")), "mix-blocks")
    marked = planned.join(broadcast_within(blocks, BROADCAST_BYTES), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")
    doc_key = lambda epoch: F.xxhash64("h", epoch)
    inside = Window.partitionBy("source", "block").orderBy("dk", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = (marked.where("edge").withColumn("dk", doc_key(F.col("full"))).withColumn("upto", F.sum("n_tokens").over(inside))
               .withColumn("extra", (F.col("upto") <= F.col("room")).cast("int")).drop("dk", "upto"))
    others = marked.where("edge is null or not edge").withColumn("extra", F.col("edge").isNotNull().cast("int"))
    taken = others.unionByName(at_edge).withColumn("times", F.col("full") + F.col("extra")).where("times > 0")
    return (taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
            .select(F.col("id").alias(id_col), "source", "n_tokens", "weight", "epoch", "block",
                    key(F.col("epoch")).alias("block_key"), doc_key(F.col("epoch")).alias("doc_key")))
