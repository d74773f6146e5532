"""Polarity of words read off the corpus, and texts scored by it.

A word that stands in the same contexts as the seed words of one side more often
than chance has that side's sign.  A context is a stretch of a text (a line by
default).  For a word in ``n`` of ``N`` contexts, ``k`` of them among the ``K`` that
hold a seed of a side, the side counts if Dunning's log-likelihood ratio of the
two rates (``k / K`` and the rate outside) passes ``MIN_RATIO``, with the weight
``log2(k N / (n K))``, their pointwise mutual information, taken at the low end of
what ``k`` may stand for (``DEVIATIONS``) and ``MIN_BITS`` at least.  Polarity is the
positive side's weight less the negative side's; seeds need no test.

Which contexts hold a seed is seen within the row, so no pair of words is ever
formed: the corpus is one grouped aggregation by word, combined on the map side.
Totals and the table of polar words are joined (broadcast by adaptive execution
only if they turn out small); nothing reaches the driver.  In a corpus of several
languages rates are taken within each, or a seed would colour its whole language.

Weights are integers (1024ths) before anything is summed.

Defined cases: NULL and empty texts hold no context and are Neutral with score 0;
equal texts count once in the statistics; a corpus without a seed gives an empty
table; a word counts once in a context; every row of the input gives a row, and
columns of the input named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .boundaries import _rate_ll, digest
from .enrich import MIXED_BAND, NEGATIVE_WORDS, POSITIVE_WORDS, tokens

MIN_RATIO = 10.83        # one in a thousand by chance (chi-squared, one degree)
DEVIATIONS = 2.0         # a count k stands for k less two standard deviations (its square root)
MIN_BITS = 2.0           # mutual information: less is the company that a whole language or topic keeps
SCALE = 1024
CONTEXT = r"[\r\n]+"
RESULTS = ("sentiment", "score", "positive", "negative")


def _ratio(k: Column, kk: Column, n: Column, nn: Column) -> Column:
    """Dunning's ratio of the rates k of kk and n - k of nn - kk."""
    rest, others = n - k, F.greatest(nn - kk, F.lit(1))
    return 2.0 * (_rate_ll(k, kk, k / kk) + _rate_ll(rest, others, rest / others) - _rate_ll(k, kk, n / nn) - _rate_ll(rest, others, n / nn))


def _group(within: str | None) -> Column:
    return F.coalesce(F.col(f"`{within}`").cast("string"), F.lit("")) if within else F.lit("")


def _distinct_texts(df: DataFrame, text_col: str, within: str | None) -> DataFrame:
    return df.select(_group(within).alias("g"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null").distinct()


def word_contexts(texts: DataFrame, positive: list[str], negative: list[str], text_col: str = "text", within: str | None = None,
                  context: str = CONTEXT) -> DataFrame:
    """(g, words, p, q): the distinct words of each context of the distinct texts, and whether it holds a seed of either side."""
    stretches = _distinct_texts(texts, text_col, within).select("g", F.explode_outer(F.split("text", context)).alias("stretch"))
    words = stretches.select("g", F.array_distinct(tokens("stretch")).alias("words")).where(F.size("words") > 0)
    holds = lambda seeds: F.arrays_overlap("words", F.array(*map(F.lit, seeds))) if seeds else F.lit(False)
    return words.select("g", "words", holds(positive).alias("p"), holds(negative).alias("q"))


def learn_polarity(texts: DataFrame, positive: list[str] = POSITIVE_WORDS, negative: list[str] = NEGATIVE_WORDS, text_col: str = "text",
                   within: str | None = None, context: str = CONTEXT, min_ratio: float = MIN_RATIO, deviations: float = DEVIATIONS,
                   min_bits: float = MIN_BITS) -> DataFrame:
    """(g, word, polarity): the words that are not neutral, in 1024ths; ``within`` names a column
    (the language) in whose groups the rates are taken."""
    contexts = word_contexts(texts, positive, negative, text_col, within, context)
    # the empty word stands for the context itself, so that totals are counted in the same pass;
    # a word that never meets a seed is neutral: it leaves before anything is joined
    words = F.concat("words", F.array(F.lit("")))
    counts = (contexts.select("g", F.explode_outer(words).alias("word"), "p", "q").groupBy("g", "word")
              .agg(F.count(F.lit(1)).alias("n"), F.count_if("p").alias("p"), F.count_if("q").alias("q")))
    counts = materialise(counts.where((F.col("p") > 0) | (F.col("q") > 0)), "word-contexts")
    total = materialise(counts.where("word = ''").select("g", F.col("n").alias("nn"), F.col("p").alias("pp"), F.col("q").alias("qq")), "contexts")

    def weight(k: str, held: str, seeds: list[str]) -> Column:
        n, nn, kk = F.col("n"), F.col("nn"), F.col(held)
        seed = F.col("word").isin(seeds)
        low = F.when(seed, F.col(k)).otherwise(F.col(k) - deviations * F.sqrt(k))
        bits = F.when(low > 0, F.floor(F.log2(low * nn / (n * kk)) * SCALE)).otherwise(0)
        sure = seed | ((bits >= int(min_bits * SCALE)) & (_ratio(F.col(k), kk, n, nn) >= min_ratio))
        return F.when((F.col(k) > 0) & (bits > 0) & sure, bits).otherwise(0)
    return (counts.where("word <> ''").join(total, "g")
            .select("g", "word", (weight("p", "pp", positive) - weight("q", "qq", negative)).alias("polarity")).where(F.col("polarity") != 0))


def score_polarity(df: DataFrame, polarity: DataFrame, text_col: str = "text", within: str | None = None) -> DataFrame:
    """``df`` with ``positive`` and ``negative`` (the polar weight of the text on either side,
    in 1024ths), ``score`` (their difference by their sum) and ``sentiment``."""
    # written once, as the keys must not change between the passes
    keyed = materialise(_distinct_texts(df, text_col, within).select(F.monotonically_increasing_id().alias("key"), "g", "text"), "polar-texts")
    # so are the polar words: a small table is then known as one, and the words of the texts stay where they are
    polarity = materialise(polarity, "polar-words")
    hits = (keyed.select("key", "g", F.explode_outer(tokens("text")).alias("word")).join(polarity, ["g", "word"]).groupBy("key")
            .agg(F.sum(F.greatest("polarity", F.lit(0))).alias("__p"), F.sum(F.greatest(-F.col("polarity"), F.lit(0))).alias("__n")))
    found = keyed.select("key", F.col("g").alias("__g"), digest("text").alias("__digest")).join(hits, "key").drop("key")
    own = [F.col(f"`{c}`") for c in df.columns if c not in RESULTS]
    pos, neg = F.coalesce("__p", F.lit(0).cast("long")), F.coalesce("__n", F.lit(0).cast("long"))
    score = F.when(pos + neg > 0, (pos - neg) / (pos + neg)).otherwise(0.0)
    label = (F.when(pos + neg == 0, "Neutral").when(score > MIXED_BAND, "Positive").when(score < -MIXED_BAND, "Negative").otherwise("Mixed"))
    rows = df.withColumn("__g", _group(within)).withColumn("__digest", digest(F.col(f"`{text_col}`")))
    return rows.join(found, ["__g", "__digest"], "left").select(
        *own, label.alias("sentiment"), score.alias("score"), pos.alias("positive"), neg.alias("negative"))
