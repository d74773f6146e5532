"""Sentences by corpus statistics and the summaries made of them."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rivulet.functions import text as RT
from rivulet.operators import boundaries as B
from rivulet.operators import summary as S

NAMES = ["Smith", "Brown", "Jones", "Miller", "Clark", "Adams", "Baker", "Evans"]
VERBS = ["visited", "called", "thanked", "met", "saw", "asked", "told", "paid"]
PLACES = ["the office", "the river bank", "our old school", "a small museum", "the central station", "the market hall"]


def text_of(sentences):
    return " ".join(sentences).replace(" Why", "\nWhy")


def planted(n=160):
    """Sentences of texts with titles before names, and the same verbs and places inside and at the end of sentences."""
    out = []
    for i in range(n):
        a, b, v, p, q = NAMES[i % 8], NAMES[(i // 8 + 3) % 8], VERBS[i % 8], PLACES[i % 6], PLACES[(i + 1) % 6]
        out.append((i, [f"Dr. {a} {v} {p} with Mrs. {b} again.", f"The two then {VERBS[(i + 1) % 8]} Prof. {b} in {q}.", f"He {v} Dr. {b} at {p}!",
                        f"The rest went home after {q} and {p}.", "Why not?", f"They again {v}."]))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    odd = [(900, None), (901, ""), (902, " \n "), (903, "no mark at all"), (904, "One. Two. Three."), (905, "...!?"), (None, "A row without number. It stays.")]
    return spark.createDataFrame([(i, text_of(x)) for i, x in planted()] + odd + [(5000, text_of(planted()[0][1]))], "doc_id long, text string").repartition(4)


def test_titles_do_not_end_sentences(spark, texts):
    known = B.learn_boundaries(B.keyed_texts(texts))
    words = {r["word"] for r in known.abbreviations.collect()}
    assert {"dr", "mrs", "prof"} <= words and not words & {"again", "station", "bank", "school"}
    assert "the" in {r["word"] for r in known.starters.collect()}
    rows = {r["doc_id"]: r["sentences"] for r in B.with_sentences(texts).collect()}
    assert len(rows) == texts.count()
    for i, sentences in planted():
        assert rows[i] == sentences
    assert rows[900] is None and rows[901] == [] and rows[902] == [] and rows[903] == ["no mark at all"] and rows[905] == ["...!?"]
    assert rows[5000] == rows[0] and rows[None] == ["A row without number.", "It stays."]


def test_the_rule_splits_where_the_statistics_do_not(spark, texts):
    df = B.with_sentences(texts.where("doc_id = 0"), known=B.learn_boundaries(B.keyed_texts(texts)))
    r = df.select(RT.sentences("text").alias("by_rule"), "sentences", RT.truncate_markdown("text", 1, 0, F.col("sentences")).alias("f6"),
                  RT.truncate_by_sentences("text", 2, 2000, F.col("sentences")).alias("f7")).first()
    assert r["by_rule"][0] == "Dr." and r["sentences"][0].startswith("Dr. Smith visited")
    assert r["f6"] == r["sentences"][0] and r["f7"] == " ".join(r["sentences"][:2])


def brute(sentences_of, idf_texts, limit=3, max_chars=2000):
    """The same from every pair of sentences, in floating point."""
    words = lambda s: Counter(re.findall(r"[^\W_]+", s.lower()))
    df = Counter(w for ss in idf_texts for w in {w for s in ss for w in words(s)})
    n = len(idf_texts)
    vec = lambda s: {w: tf * math.log(1 + n / df[w]) for w, tf in words(s).items()}

    def cosine(a, b):
        na, nb = (math.sqrt(sum(x * x for x in v.values())) for v in (a, b))
        return sum(x * b.get(w, 0) for w, x in a.items()) / (na * nb) if na and nb else 0

    out = {}
    for key, ss in sentences_of.items():
        vs = [vec(s) for s in ss]
        out[key] = [sum(cosine(a, b) for b in vs) for a in vs]
    return out


def test_centrality_is_that_of_all_pairs(spark, texts):
    keyed = B.keyed_texts(texts)
    rows = S.ranked_sentences(keyed, B.learn_boundaries(keyed)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["key"], r["s"])):
        by.setdefault(r["key"], []).append(r)
    # texts without a sentence count in the corpus, too
    empty = [[] for _ in range(keyed.count() - len(by))]
    want = brute({k: [r["sentence"] for r in v] for k, v in by.items()}, [[r["sentence"] for r in v] for v in by.values()] + empty)
    for k, v in by.items():
        for r, w in zip(v, want[k]):
            assert abs(r["centrality"] / S.UNIT_SCALE ** 2 - w) < 0.01


def test_summaries(spark, texts):
    out = S.extractive_summary(texts.withColumn("score", F.lit("clash")).withColumn("key", F.lit(1)))
    assert out.columns == ["doc_id", "text", "key", "summary", "score"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == texts.count()
    for i in (900, 901, 902):
        assert rows[i]["summary"] is None and rows[i]["score"] is None
    assert (rows[903]["summary"], rows[903]["score"]) == ("no mark at all", 10)
    assert (rows[905]["summary"], rows[905]["score"]) == ("...!?", 10)
    assert rows[904]["summary"] == "One. Two. Three."
    assert rows[5000]["summary"] == rows[0]["summary"]
    for i, sentences in planted():
        chosen = [x for x in sentences if x in rows[i]["summary"]]
        assert len(chosen) == 3 and rows[i]["summary"] == " ".join(chosen) and 1 <= rows[i]["score"] <= 10


def test_limits_and_ties(spark):
    long = "word " * 30 + "end."
    rows = [(1, " ".join([f"Alpha beta gamma {i}." for i in range(5)])), (2, f"{long} {long.replace('end', 'stop')} Tail."), (3, "x" * 50 + " y."), (4, "Same words here. Same words here. Other.")]
    out = {r["doc_id"]: r for r in S.extractive_summary(spark.createDataFrame(rows, "doc_id long, text string"), max_sentences=2, max_chars=40).collect()}
    assert out[1]["summary"] == "Alpha beta gamma 0. Alpha beta gamma 1."      # ties go to the earlier
    assert len(out[2]["summary"]) == 40 and len(out[3]["summary"]) == 40         # a first sentence that is too long is cut
    assert out[4]["summary"] == "Same words here. Same words here."
    assert S.extractive_summary(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_short_class_of_white_space_is_that_of_all_white_space(spark):
    chars = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    assert chars.where(F.col("c").rlike(f"^[{B.SPACE}]$") != F.translate("c", B.WS_CHARS, "").eqNullSafe("")).count() == 0
    text = F.lit("a bé é x​.\u001cy,\u0085 ü z　")
    got = spark.range(1).select(F.regexp_extract_all(text, F.lit(B.TOKEN), F.lit(0)), F.array_join(F.regexp_extract_all(text, F.lit(B.PIECE), F.lit(0)), "") == text).first()
    assert got[0] == ["a", "bé", "é", "x​.", "y,", "ü", "z"] and got[1]


def test_results_return_to_their_rows_without_the_texts(spark, texts):
    """Only the input itself is dealt with its texts, and a candidate is cut out of a text once."""
    keyed = B.keyed_texts(texts)
    known = B.learn_boundaries(keyed)
    assert "regexp_extract_all" not in B.boundaries(keyed, known)._jdf.queryExecution().executedPlan().toString()
    plan = B.with_sentences(texts, known=known)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("text" in line for line in joins)


def test_words_are_dealt_within_their_text(spark, texts):
    """No exchange by sentence or by word of a text: rows of a text stay together, words come back as numbers."""
    keyed = B.keyed_texts(texts)
    plan = S.ranked_sentences(keyed, B.learn_boundaries(keyed))._jdf.queryExecution().optimizedPlan().toString()
    lists = [line for line in plan.splitlines() if "Aggregate [key" in line]
    assert lists and not any("word" in line for line in lists)


def test_rare_and_frequent_words_weigh_alike(spark, texts, monkeypatch):
    keyed = B.keyed_texts(texts)
    weights = lambda: {r["key"]: r["idf"] for r in S._weights(keyed)[0].collect()}
    got = weights()
    monkeypatch.setattr(S, "BROADCAST", 20)     # most words go the other way
    assert weights() == got and len(got) > 100


def test_tasks_of_the_weighing_grow_in_number_with_the_words(spark, texts, monkeypatch):
    keyed = B.keyed_texts(texts)
    known = B.learn_boundaries(keyed)
    ranked = lambda: sorted(map(tuple, S.ranked_sentences(keyed, known).collect()))
    few = ranked()
    monkeypatch.setattr(S, "WORDS_PER_TASK", 300)
    assert S._weights(keyed)[1] > 5 and ranked() == few
    plan = S._centralities(keyed, B.boundaries(keyed, known))[0]._jdf.queryExecution().executedPlan().toString()
    n = S._weights(keyed)[1]
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(key" in line]
    assert exchanges and any(f", {n})" in line for line in exchanges) and not any("i#" in line or "s#" in line for line in exchanges)
