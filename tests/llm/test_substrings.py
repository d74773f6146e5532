"""Substring dedup against plain windows, and its defined cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import substrings
from rivulet.llm.common import read

from .conftest import TEXTS

W = substrings.WINDOW


def plain(rows, window=W):
    """(words, removed, kept) of each (id, text): windows that also start in a smaller id."""
    words = [(substrings.LAST if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - window + 1):
            k = tuple(w[j:j + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < i:
                gone[j:j + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def run(df, **kw):
    return df, [tuple(r) for r in substrings.remove_repeats(df, **kw).select("doc_id", "text", "n_words", "n_removed", "kept").collect()]


def check(got, window=W):
    want = plain([r[:2] for r in got], window)
    assert [r[2:] for r in got] == want
    return sum(w[1] for w in want)


@pytest.mark.parametrize("group", [substrings.GROUP, 2])
def test_given_documents(spark, group):
    """With short prefixes and with prefixes lengthened to whole windows."""
    _, got = run(read(spark, "/root/testdata/sf0.001", "documents"), group=group)
    assert len(got) == 200 and check(got) > 1000


@pytest.mark.parametrize("group,window,short", [(2048, 13, 4), (5, 13, 4), (2048, 6, 2), (3, 6, 5), (2048, 5, 5)])
def test_random_passages(spark, group, window, short):
    """Few words, shared passages of all lengths, periodic texts, copies, edits."""
    rnd = random.Random(window * group)
    words = [f"w{i}" for i in range(6)] + ["é", "中文", "W0", " ", "a b"]
    shared = [[rnd.choice(words) for _ in range(rnd.randint(3, 60))] for _ in range(8)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rnd.randint(0, 6)):
            w += rnd.choice(shared) if rnd.random() < 0.5 else [rnd.choice(words) for _ in range(rnd.randint(0, 15))]
        if rnd.random() < 0.1:
            w = [rnd.choice(words)] * rnd.randint(1, 60)
        rows.append((rnd.choice([i, i, i, rnd.randint(0, 120), None]), rnd.choice([" ", "\n", " \t\x0b"]).join(w)))
        if rnd.random() < 0.2:
            rows.append((200 + i, rows[rnd.randint(0, len(rows) - 1)][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _, got = run(df, group=group, window=window, short=short)
    assert len(got) == len(rows) and check(got, window) > 0


def test_a_passage_in_every_document(spark):
    passage = " ".join(f"common{i}" for i in range(20))
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("a"), "id"), F.lit(passage), F.concat(F.lit("b"), "id")).alias("text"))
    _, got = run(df.repartition(4), group=50)
    assert check(got) == 599 * 20


def test_odd_rows(odd):
    out = substrings.remove_repeats(odd)
    assert out.columns == odd.columns + ["n_words", "n_removed", "kept"]
    rows = out.collect()
    got = [(r["doc_id"], r["text"], r["n_words"], r["n_removed"], r["kept"]) for r in rows]
    assert len(got) == len(TEXTS)
    check(got)
    by = {r[0]: r for r in got}
    assert by[3][2:] == by[4][2:] == by[5][2:] == (0, 0, "")
    assert by[2][3] == by[2][2] == 15 and by[1][3] == 0                 # the copy goes, repeated rows of the first id stay
    assert {r["fp"] for r in rows} == {"clash-fp"}


def test_empty_and_other_ids(spark, nothing):
    assert substrings.remove_repeats(nothing).count() == 0
    assert substrings.repeats(nothing).count() == 0
    text = " ".join(map(str, range(20)))
    df = spark.createDataFrame([("x", text), ("7", text), ("9", text)], "doc_id string, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(df).collect()}
    assert got == {"7": 0, "9": 20, "x": 20}                             # an id that is no integer comes last


def test_long_texts_are_read_in_slices():
    text = b" ".join(b"w%d" % i for i in range(5000)) + b" " + b"x" * 9000 + b" end "
    parts = list(substrings.slices(text, 1000))
    assert len(parts) > 10 and [w for p in parts for w in p.split()] == text.split() and b"".join(parts) == text
    assert list(substrings.slices(b"")) == [b""]


def test_tree_gives_maximal_repeats():
    """Within one group: the repeat goes on to where the texts part, to either side of the anchor."""
    a = [b"l%d" % i for i in range(9)] + [b"k1", b"k2", b"k3", b"k4"] + [b"r%d" % i for i in range(9)]
    b = [b"x"] * 3 + a[3:18] + [b"y"] * 4
    hits, first, last = substrings.tree_repeats(np.array([5, 5, 6]), np.array([1, 2, 0]), np.array([100, 50, 0]),
                                                [b" ".join(a), b" ".join(b), b" ".join(a)])
    assert hits.tolist() == [1] and (first.tolist(), last.tolist()) == ([53], [68])     # the group 6 holds id 0, but no other
