"""Polarity read off the corpus: planted company of the seeds, held-out texts, brute force, edge cases."""

import math
import random
import re

from pyspark.sql import functions as F

from rivulet.operators.enrich import lexicon_sentiment
from rivulet.operators.polarity import learn_polarity, score_polarity

POS, NEG = ["good", "great"], ["bad", "awful"]
FILLER = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]


def corpus(seed=5, n=1500):
    """Lines of filler; one in ten holds a seed of a side, mostly with a word that the side likes."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lines = []
        for _ in range(4):
            words = rnd.sample(FILLER, 8) + ["the"]
            r = rnd.random()
            if r < 0.1:
                side = rnd.random() < 0.5
                words.append(rnd.choice(POS if side else NEG))
                if rnd.random() < 0.8:
                    words.append(rnd.choice(["lovely", "superb"] if side else ["nasty", "dreadful"]))
            rnd.shuffle(words)
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines)))
    return rows


def plain(rows, pos, neg):
    """The definition, with dictionaries."""
    n, k, total = {}, ({}, {}), [0, 0, 0]
    for text in {t for _, t in rows if t is not None}:
        for line in re.split(r"[\r\n]+", text):
            words = set(re.findall(r"[^\W\d_]+", line.lower()))
            if not words:
                continue
            held = [bool(words & set(pos)), bool(words & set(neg))]
            total = [total[0] + 1, total[1] + held[0], total[2] + held[1]]
            for w in words:
                n[w] = n.get(w, 0) + 1
                for side in (0, 1):
                    k[side][w] = k[side].get(w, 0) + held[side]

    def ll(a, b, p):
        return (a * math.log(p) if a else 0.0) + ((b - a) * math.log(1 - p) if b - a else 0.0)

    def weight(w, side, seeds):
        a, kk, nn, c = k[side][w], total[side + 1], total[0], n[w]
        low = a if w in seeds else a - 2 * math.sqrt(a)
        if a == 0 or low <= 0:
            return 0
        bits = math.floor(math.log2(low * nn / (c * kk)) * 1024)
        ratio = 2 * (ll(a, kk, a / kk) + ll(c - a, nn - kk, (c - a) / max(nn - kk, 1)) - ll(a, kk, c / nn) - ll(c - a, nn - kk, c / nn))
        return bits if bits > 0 and (w in seeds or (bits >= 2048 and ratio >= 10.83)) else 0
    out = {w: weight(w, 0, pos) - weight(w, 1, neg) for w in n}
    return {w: p for w, p in out.items() if p}


def test_planted_company_and_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows + rows[:200], "id int, text string")
    got = {r["word"]: r["polarity"] for r in learn_polarity(df, POS, NEG).collect()}
    assert got == plain(rows, POS, NEG)
    assert {w for w, p in got.items() if p > 0} == {"good", "great", "lovely", "superb"}
    assert {w for w, p in got.items() if p < 0} == {"bad", "awful", "nasty", "dreadful"}


def test_held_out_texts_without_seeds(spark):
    """Texts that hold only the seeds' company: the fixed list knows none of them."""
    learnt = learn_polarity(spark.createDataFrame(corpus(), "id int, text string"), POS, NEG)
    rnd = random.Random(8)
    held = [(i, " ".join(rnd.sample(FILLER, 5) + [w]), want) for i, (w, want) in enumerate(
        [("lovely", "Positive"), ("superb", "Positive"), ("nasty", "Negative"), ("dreadful", "Negative"), ("the", "Neutral")] * 10)]
    df = spark.createDataFrame(held, "id int, text string, want string")
    scored = score_polarity(df, learnt).collect()
    assert len(scored) == 50 and all(r["sentiment"] == r["want"] for r in scored)
    fixed = df.select("want", lexicon_sentiment("text")["sentiment"].alias("s")).where(F.col("want") == F.col("s")).count()
    assert fixed == 10


def test_rates_are_taken_within_a_language(spark):
    """A seed that only one language has does not colour that language's common words."""
    rnd = random.Random(2)
    rows = [("en", " ".join(rnd.sample(FILLER, 4)) + " the") for _ in range(600)]
    rows += [("de", " ".join(rnd.sample(FILLER, 4)) + " das" + (" gut" if i % 2 else "")) for i in range(100)]
    df = spark.createDataFrame(rows, "lang string, text string")
    words = lambda within: {r["word"] for r in learn_polarity(df, ["gut"], ["schlecht"], within=within).collect()}
    assert "das" in words(None) and words("lang") == {"gut"}


def test_nulls_empty_texts_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, None, 9.0), (2, "", "en", 8.0), (3, "good\ngood", "en", 7.0), (3, "good\ngood", "en", 7.0), (4, "12 34", None, 6.0)],
                               "id int, text string, lang string, score double")
    learnt = learn_polarity(df, POS, NEG, within="lang")
    rows = sorted((r["id"], r["sentiment"], r["score"]) for r in score_polarity(df, learnt, within="lang").collect())
    assert [r[0] for r in rows] == [1, 2, 3, 3, 4] and all(r[1] == "Neutral" and r[2] == 0.0 for r in rows)
    assert learn_polarity(df.limit(0), POS, NEG).collect() == [] and score_polarity(df.limit(0), learnt).collect() == []
    assert learn_polarity(df, [], []).collect() == []


def test_polar_words_meet_the_texts_where_they_are(spark):
    """A small table of polar words is broadcast as planned, and no join is by the texts."""
    rows = spark.createDataFrame(corpus(n=300), "id long, text string")
    polarity = spark.createDataFrame([("", "lovely", 3000)], "g string, word string, polarity long").repartition(2)
    plan = score_polarity(rows, polarity)._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning" in line and "word" in line for line in plan.splitlines())
    assert not any("Join" in line and "text" in line for line in plan.splitlines())


def test_contexts_and_their_words_are_counted_in_one_pass(spark):
    """Totals come with the counts: nothing behind them reads the texts again."""
    plan = learn_polarity(spark.createDataFrame(corpus(n=300), "id long, text string"), POS, NEG)._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "Generate" not in plan
