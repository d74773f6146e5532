"""Sentence boundaries from corpus statistics (F5): no word list, nothing trained
by hand.

Every token that ends with ``.``, ``!`` or ``?`` (closing quotes and brackets
aside) is a candidate.  Which words are abbreviations and which begin
sentences is read off the corpus, as in Kiss and Strunk (2006), by grouped
aggregation:

* *abbreviations*: words that nearly always stand before a period.  Dunning's
  log-likelihood ratio between "a period follows by chance" and "a period
  nearly always follows", times exp(-letters), the number of periods, and
  letters^-(occurrences without a period);
* *sentence starters*: words that stand after a sure boundary far more often
  than elsewhere (log-likelihood ratio of the two rates).

A period after an abbreviation, an initial, a number or an ellipsis is a
boundary only if what follows asks for one; every other candidate is.

Statistics count every distinct text once.  Tables of words grow with the
vocabulary, so they are joined, and adaptive execution broadcasts them only if
they turn out small; two totals are the only values that reach the driver.

Defined cases: NULL and empty texts have no boundary; boundaries are token
positions (from 1, white space divides tokens), the end of the text is none;
the result of equal texts is equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._col import let
from ..functions._regex import WS_CHARS
from ..session import materialise

# Published constants of the method.
ALWAYS = 0.99            # the rate of periods after an abbreviation
ABBREVIATION_SCORE = 0.3
STARTER_SCORE = 30.0

# The characters of WS by their category: Java asks a class of many ranges one by one,
# which costs ten times as much on every character.  Printable ASCII is matched first.
SPACE = r"\p{Z}\x{9}-\x{D}\x{1C}-\x{1F}\x{85}"
TOKEN = f"[!-~]+[^{SPACE}]*|[^{SPACE}]+"
PIECE = f"[!-~]+[^{SPACE}]*[{SPACE}]*|[^{SPACE}]+[{SPACE}]*"
OPENING = "\"'([{«“‘¿¡*_"
CLOSING = "\"')]}»”’*_"
TAIL = ".,;:!?…"
MARKED = "[.!?…][\"')\\]}»”’*_]*$"


def keyed_texts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, text): the distinct non-NULL texts, each with a number of its own.
    Written once, as the numbers must not change between the passes."""
    distinct = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null").distinct()
    return materialise(distinct.select(F.monotonically_increasing_id().alias("key"), "text"), "texts")


def _tokens() -> Column:
    return F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))


def _bare(c) -> Column:
    """Without the quotes and brackets around it."""
    return F.rtrim(F.ltrim(c, F.lit(OPENING)), F.lit(CLOSING))


def _word(c) -> Column:
    return F.lower(F.rtrim(c, F.lit(TAIL)))


def _ends_with(c: Column, *marks: str) -> Column:
    return reduce(lambda x, y: x | y, [c.endswith(m) for m in marks])


def _candidates(keyed: DataFrame) -> DataFrame:
    """(key, pos, word, next_word, stop, decided, upper): the tokens that end with a mark and
    have a token after them, both as words; whether the mark is one of ``.!?``; what is
    decided without the statistics (NULL: nothing); whether the next token has a capital.
    Tokens without a mark are left out inside the text, before anything is made of them."""
    pairs = let(_tokens(), lambda a: let(
        F.filter(F.transform(a, lambda x, i: F.when(x.rlike(MARKED), i)), lambda i: i.isNotNull()),
        lambda at: F.transform(F.filter(at, lambda i: i + 1 < F.size(a)), lambda i: F.struct((i + 1).alias("pos"), a[i].alias("tok"), a[i + 1].alias("next")))))
    rows = keyed.select("key", F.explode_outer(pairs).alias("x")).where("x is not null")
    rows = rows.select("key", "x.pos", _bare(F.col("x.tok")).alias("core"), _bare(F.col("x.next")).alias("after"))
    core, upper = F.col("core"), F.col("after").rlike(r"^\p{Lu}")
    decided = F.when(_ends_with(core, "!", "?"), True).when(_ends_with(core, "..", "…") | _word("core").rlike("^[0-9]+$"), upper)
    return rows.where(_ends_with(core, ".", "!", "?", "…")).select(
        "key", "pos", _word("core").alias("word"), _word("after").alias("next_word"), _ends_with(core, ".", "!", "?").alias("stop"),
        decided.alias("decided"), upper.alias("upper"))


def _rate_ll(k: Column, n: Column, p: Column) -> Column:
    """log-likelihood of k of n at rate p; nothing times log 0 is 0."""
    return (F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(0.0))


class Boundaries:
    """The statistics of a corpus: ``abbreviations`` (word) and ``starters`` (word); of
    the texts that they were learnt from (``learnt_from``) the ``candidates``, too."""

    def __init__(self, abbreviations: DataFrame, starters: DataFrame, learnt_from: DataFrame | None = None, candidates: DataFrame | None = None):
        self.abbreviations, self.starters = abbreviations, starters
        self.learnt_from, self.candidates = learnt_from, candidates


def learn_boundaries(keyed: DataFrame) -> Boundaries:
    # tokens are counted as they stand: patterns are then run once for each form, not for each occurrence
    forms = keyed.select(F.explode_outer(_tokens()).alias("tok")).where("tok is not null").groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    cores = forms.select(_bare("tok").alias("core"), "n").select(_word("core").alias("word"), F.col("core").endswith(".").alias("dotted"), "n")
    words = materialise(cores.groupBy("word").agg(F.sum(F.when(F.col("dotted"), F.col("n")).otherwise(0)).alias("n_dot"),
                                                  F.sum(F.when(F.col("dotted"), 0).otherwise(F.col("n"))).alias("n_plain")), "words")
    total = words.agg(F.coalesce(F.sum(F.col("n_dot") + F.col("n_plain")), F.lit(0)).alias("n"), F.coalesce(F.sum("n_dot"), F.lit(0)).alias("dots")).first()
    n, dots = total["n"], total["dots"]
    letters = F.length(F.regexp_replace("word", r"\.", ""))
    periods = F.length("word") - letters + 1
    chance = F.lit(min(max(dots / n, 1e-9), 1 - 1e-9) if n else 0.5)
    a, b = F.col("n_dot"), F.col("n_plain")
    ratio = -2.0 * ((a * F.log(chance) + b * F.log(1 - chance)) - (a * F.log(F.lit(ALWAYS)) + b * F.log(F.lit(1 - ALWAYS))))
    score = ratio * F.exp(-letters.cast("double")) * periods * F.pow(letters.cast("double"), -b.cast("double"))
    abbreviations = materialise(words.where((a > 0) & F.col("word").rlike(r"\p{L}") & (score >= ABBREVIATION_SCORE)).select("word"), "abbreviations")
    # sure boundaries: no abbreviation before, a word with a letter after
    candidates = materialise(_candidates(keyed), "candidates")
    sure = (candidates.where(F.col("stop") & F.col("next_word").rlike(r"\p{L}"))
            .join(abbreviations, "word", "left_anti").groupBy(F.col("next_word").alias("word")).agg(F.count(F.lit(1)).alias("k")))
    sure = materialise(sure, "after-boundaries")
    breaks = sure.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")).first()["n"]
    k, c = F.col("k"), (a + b)
    here, rest = F.lit(breaks), F.lit(n - breaks)
    p, p1, p2 = c / F.lit(max(n, 1)), k / F.lit(max(breaks, 1)), (c - k) / F.lit(max(n - breaks, 1))
    ratio = -2.0 * (_rate_ll(k, here, p) + _rate_ll(c - k, rest, p) - _rate_ll(k, here, p1) - _rate_ll(c - k, rest, p2))
    starters = materialise(sure.join(words, "word").where((p1 > p2) & (ratio >= STARTER_SCORE)).select("word"), "starters")
    return Boundaries(abbreviations, starters, keyed, candidates)


def boundaries(keyed: DataFrame, known: Boundaries) -> DataFrame:
    """(key, ends): for each text with any, the positions of the tokens that end a sentence, ascending."""
    rows = known.candidates if known.learnt_from is keyed else _candidates(keyed)
    flagged = (rows.join(known.abbreviations.select("word", F.lit(True).alias("abbreviation")), "word", "left")
               .join(known.starters.select(F.col("word").alias("next_word"), F.lit(True).alias("starter")), "next_word", "left"))
    initial = F.col("word").rlike(r"^\p{L}$")
    ends = (F.when(F.col("decided").isNotNull(), F.col("decided"))
            .when(F.col("abbreviation").isNotNull() | initial, F.col("upper") & F.col("starter").isNotNull())
            .otherwise(True))
    return flagged.where(ends).groupBy("key").agg(F.sort_array(F.collect_list("pos")).alias("ends"))


def split_at(text, ends) -> Column:
    """The sentences of a text, given its ``ends`` (NULL: one sentence); white
    space inside a sentence stays, around it goes.  NULL text gives NULL."""
    text, ends = (F.col(c) if isinstance(c, str) else c for c in (text, ends))
    cuts = F.coalesce(ends, F.array().cast("array<int>"))
    # a piece begins with a token, so only white space behind a sentence is to go
    made = let(F.struct(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)).alias("p"), cuts.alias("c")), lambda x: F.transform(
        F.concat(x["c"], F.array(F.size(x["p"]))),
        lambda end, i: F.rtrim(F.array_join(F.slice(x["p"], F.when(i > 0, F.get(x["c"], i - 1)).otherwise(0) + 1,
                                                    end - F.when(i > 0, F.get(x["c"], i - 1)).otherwise(0)), ""), F.lit(WS_CHARS))))
    return F.when(text.isNotNull(), F.filter(made, lambda s: s != ""))


def digest(text) -> Column:
    """SHA-256 of a text: what tables of results by text are joined on, in place of the text."""
    return F.sha2((F.col(text) if isinstance(text, str) else text).cast("string"), 256)


def of_texts(df: DataFrame, keyed: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the columns that ``found`` has for its text (NULL without).  Only
    ``df`` itself is dealt with its texts; ``found`` (key, ...) comes by their digests."""
    by_digest = keyed.select("key", digest("text").alias("__digest")).join(found, "key").drop("key")
    return df.withColumn("__digest", digest(F.col(f"`{text_col}`"))).join(by_digest, "__digest", "left").drop("__digest")


def with_sentences(df: DataFrame, text_col: str = "text", out: str = "sentences", known: Boundaries | None = None) -> DataFrame:
    """``df`` with the sentences of each text, by the statistics of ``known`` or
    of ``df`` itself.  Rows of one text share their boundaries."""
    keyed = keyed_texts(df, text_col)
    found = boundaries(keyed, known or learn_boundaries(keyed)).withColumnRenamed("ends", "__ends")
    own = [F.col(f"`{c}`") for c in df.columns if c != out]
    return of_texts(df, keyed, found, text_col).select(*own, split_at(F.col(f"`{text_col}`").cast("string"), "__ends").alias(out))
