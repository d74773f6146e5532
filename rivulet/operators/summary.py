"""Extractive summary and its score (U3a, U3d): the sentences that stand for the text.

A text's sentences (F5, by corpus statistics) are vectors of their words,
weighted by frequency in the sentence and rarity in the corpus.  A sentence's
centrality is the sum of its cosine similarities to all sentences of the text
(the degree centrality of the similarity graph).  As that sum is the product
with the sum of all the text's unit vectors, no pair of sentences is formed:
the work is linear in the words, in grouped aggregations within each text.

The summary is the most central sentences that fit, in the order of the text;
its score, 1 to 10, is the share of the text's centrality that they hold.

Weights are scaled to integers before anything is summed, so results do not
depend on the order of the rows.

Defined cases: NULL texts and texts without a sentence have a NULL summary and
score; ties go to the earlier sentence; a first sentence that is too long is cut;
sentences without a word rank last with centrality 0; equal texts count once in
the corpus and get equal results; every row of the input gives a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions._col import let
from ..session import materialise
from .boundaries import Boundaries, boundaries, keyed_texts, learn_boundaries, of_texts, split_at

MAX_SENTENCES = 3
IDF_SCALE = 1024         # log(1 + texts / texts with the word), in 1024ths
IDF_BITS = 16            # a weight has fewer: log of all numbers of texts, scaled
UNIT_SCALE = 1 << 16     # components of unit vectors
WORDS_PER_TASK = 500_000  # distinct words of texts whose sentences are weighed in one task
BROADCAST = 100_000      # of all counts of words in texts: what is above one part of so many is broadcast
WORD = r"[\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _weights(keyed: DataFrame) -> tuple[DataFrame, int]:
    """(key, idf): for each text with a word the weights of its distinct words in their order;
    and the number of partitions by key that they are dealt to, which grows with the words.

    A text's words meet the corpus's counts by a join and come back as one list of numbers.
    Words that more than one in ``BROADCAST`` of all counts belong to are that many at most;
    they are broadcast, and only the others are dealt by word."""
    words = keyed.select("key", F.posexplode_outer(F.sort_array(F.array_distinct(_words(F.col("text"))))).alias("i", "word")).where("word is not null")
    counts = materialise(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word-texts")
    texts, total = keyed.count(), counts.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
    idf = counts.select("word", F.floor(F.log(1 + F.lit(texts) / F.col("df")) * IDF_SCALE).alias("idf"), (F.col("df") * BROADCAST > total).alias("often"))
    often, others = F.broadcast(idf.where("often").select("word", "idf")), idf.where("not often").select("word", "idf")
    pack = F.shiftleft(F.col("i").cast("long"), IDF_BITS) + F.col("idf")
    found = (words.join(often, "word").select("key", pack.alias("x"))
             .unionByName(words.join(often, "word", "left_anti").join(others, "word").select("key", pack.alias("x"))))
    n = -(-total // WORDS_PER_TASK) or 1
    lists = found.repartition(n, "key").groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return lists.select("key", F.transform("x", lambda x: x.bitwiseAND(F.lit((1 << IDF_BITS) - 1).cast("long"))).alias("idf")), n


def _dealt(keyed: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """(key, text, ends) by key, to a number of partitions of its own, as a task makes many
    rows of each byte that is dealt to it.  Where it stands twice Spark deals it once."""
    return keyed.repartition(n, "key").join(found.repartition(n, "key"), "key", "left")


def _centralities(keyed: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, s, centrality): one row for each sentence of the texts, given their boundaries; and the texts as they were dealt.
    All of it is grouped within a text: rows are numbers, dealt once by the text's key."""
    weights, n = _weights(keyed)
    parts = _dealt(keyed, found, n).join(weights, "key", "left").select("key", "idf", split_at("text", "ends").alias("sentences"))
    # the words in their order, each with its sentences, cut where the next word begins
    listed = F.sort_array(F.flatten(F.transform("sentences", lambda x, s: F.transform(_words(x), lambda w: F.struct(w.alias("w"), s.alias("s"))))))
    first = lambda t: F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda k: (k == 0) | (t[k]["w"] != F.get(t, k - 1)["w"]))
    cell = lambda i, s, idf: F.struct(i.cast("int").alias("i"), s.cast("int").alias("s"), idf.cast("long").alias("idf"))
    cells = let(listed, lambda t: F.when(F.size(t) > 0, let(first(t), lambda at: F.flatten(F.transform(at, lambda k, i: F.transform(
        F.slice(t, k + 1, F.coalesce(F.get(at, i + 1), F.size(t)) - k), lambda x: cell(i, x["s"], F.get(F.col("idf"), i))))))))
    # a sentence without a word has a row, too
    every = F.transform("sentences", lambda x, s: cell(F.lit(-1), s, F.lit(0)))
    rows = parts.select("key", F.explode_outer(F.concat(every, F.coalesce(cells, F.slice(every, 1, 0)))).alias("c")).where("c is not null").select("key", "c.*")
    weighted = rows.groupBy("key", "i", "s").agg((F.count(F.lit(1)) * F.max("idf")).alias("w"))
    sq = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key", "s"))
    unit = F.when(F.col("w") > 0, F.floor(F.col("w") * UNIT_SCALE / F.sqrt(F.col("sq").cast("double")))).otherwise(0)
    units = weighted.select("key", "i", "s", "w", sq.alias("sq")).select("key", "i", "s", unit.alias("u"))
    centre = units.select("key", "s", "u", F.sum("u").over(Window.partitionBy("key", "i")).alias("c"))
    return centre.groupBy("key", "s").agg(F.sum(F.col("u") * F.col("c")).alias("centrality")), _dealt(keyed, found, n)


def ranked_sentences(keyed: DataFrame, known: Boundaries) -> DataFrame:
    """(key, s, sentence, centrality): all sentences of ``keyed`` (key, text), numbered from 0."""
    found = materialise(boundaries(keyed, known), "ends")
    scores, dealt = _centralities(keyed, found)
    sentences = dealt.select("key", F.posexplode_outer(split_at("text", "ends")).alias("s", "sentence")).where("s is not null")
    return sentences.join(scores, ["key", "s"])


def summarise(keyed: DataFrame, known: Boundaries, max_sentences: int = MAX_SENTENCES, max_chars: int = fixed.MAX_SUMMARY_CHARACTERS) -> DataFrame:
    """(key, summary, score): for each text that has a sentence."""
    found = materialise(boundaries(keyed, known), "ends")
    by_key = Window.partitionBy("key")
    scores, dealt = _centralities(keyed, found)
    ranked = scores.select("key", "s", "centrality", F.row_number().over(by_key.orderBy(F.desc("centrality"), "s")).alias("rank"),
                                                F.sum("centrality").over(by_key).alias("mass"))
    chosen = ranked.where(F.col("rank") <= max_sentences).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("rank", "s", "centrality"))).alias("ranks"), F.max("mass").alias("mass"))
    # the chosen sentences are cut out of the text again: nothing but numbers was ranked
    top = let(split_at("text", "ends"), lambda x: F.transform("ranks", lambda r: F.struct(
        r["rank"].alias("rank"), r["s"].alias("s"), x[r["s"]].alias("sentence"), r["centrality"].alias("centrality"))))
    chosen = dealt.join(chosen, "key").select("key", top.alias("top"), "mass")
    # in the order of their rank, while they fit with a space between
    empty = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<struct<s:int,sentence:string>>").alias("out"),
                     F.lit(0).cast("long").alias("mass"))

    def add(acc, x):
        n = acc["n"] + F.length(x["sentence"]) + F.when(acc["n"] > 0, 1).otherwise(0)
        fits = ~acc["full"] & ((n <= max_chars) | (acc["n"] == 0))
        return F.struct(F.when(fits, n).otherwise(acc["n"]).alias("n"), (~fits).alias("full"),
                        F.when(fits, F.concat(acc["out"], F.array(F.struct(x["s"].alias("s"), F.substring(x["sentence"], 1, max_chars).alias("sentence")))))
                        .otherwise(acc["out"]).alias("out"),
                        F.when(fits, acc["mass"] + x["centrality"]).otherwise(acc["mass"]).alias("mass"))

    picked = chosen.select("key", F.aggregate("top", empty, add).alias("p"), "mass")
    summary = F.array_join(F.transform(F.array_sort("p.out"), lambda x: x["sentence"]), " ")
    share = F.when(F.col("mass") > 0, F.col("p.mass") / F.col("mass")).otherwise(1.0)
    score = (1 + F.floor(share * 9)).cast("int")
    return picked.select("key", summary.alias("summary"), score.alias("score"))


def extractive_summary(df: DataFrame, text_col: str = "text", max_sentences: int = MAX_SENTENCES, max_chars: int = fixed.MAX_SUMMARY_CHARACTERS,
                       known: Boundaries | None = None) -> DataFrame:
    """``df`` with ``summary`` and ``score``."""
    keyed = keyed_texts(df, text_col)
    found = summarise(keyed, known or learn_boundaries(keyed), max_sentences, max_chars).select(
        "key", F.col("summary").alias("__summary"), F.col("score").alias("__score"))
    own = [F.col(f"`{c}`") for c in df.columns if c not in ("summary", "score")]
    return of_texts(df, keyed, found, text_col).select(*own, F.col("__summary").alias("summary"), F.col("__score").alias("score"))
