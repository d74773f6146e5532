"""Token alignment against byte by byte merging, and its defined cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rivulet.llm import token_alignment as ta
from rivulet.llm.common import read

from .conftest import TEXTS

ODD = ["é𓀀x\r\n  𓀁𓀀" * 5, "   a   b  ", "🙂🙂x 中文字符 <s> </s> <|endoftext|> <unk>", "x" * 3000, " " * 500, "‍́é½Ⅷ ﻿", "ა" * 50,
       "a " * 9000 + "é𓀀 " * 9000, "\x00\x01\x02 a", "𓀁" * 3000, " ", " \u0085 z"]


@pytest.fixture(scope="module")
def aligner():
    return ta.Aligner(ta.FOLDER, ta.BYTE_FILE, ta.PIECE_FILE)


def plain(aligner, text):
    """Groups of the whole text, by the bytes of its tokens."""
    if not text:
        return []
    a, b = aligner.byte.encode(" " + text, add_special_tokens=False).ids, aligner.piece.encode(text)
    a_bytes, b_bytes = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return []
    out, one, two, i, j, a_at, b_at = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if a_at <= b_at and i < len(a):
            one.append(a[i])
            a_at += len(a_bytes[i])
            i += 1
        else:
            two.append(b[j])
            b_at += len(b_bytes[j])
            j += 1
        if a_at == b_at and one and two:
            out.append((one, two))
            one, two = [], []
    assert not one and not two
    return out


def plain_statistics(aligner, rows):
    groups = [plain(aligner, t) for _, t in rows]
    pairs = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for c in pairs for p in c)
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), g, c in zip(rows, groups, pairs):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                    sum(m for p, m in c.items() if count[p] == most[p[0]]), sum(m * count[p] for p, m in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


COLUMNS = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def statistics(df, **kw):
    return sorted((tuple(r) for r in ta.statistics(df, **kw).select(*COLUMNS).collect()), key=str)


def test_given_documents(spark, aligner):
    df = read(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert statistics(df) == plain_statistics(aligner, rows)


def test_odd_texts(spark, aligner):
    rows = [*enumerate(ODD), (100, None), (101, ""), (102, "a▁b"), (0, "again"), (None, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = statistics(df)
    assert got == plain_statistics(aligner, rows)
    by = {r[0]: r[1:] for r in got}
    assert by[100] == by[101] == by[102] == (0, 0, 0, 0, 0, 0, "")


def groups_of(a, b, a_end, b_end):
    out, a_at, b_at = [], 0, 0
    for p, q in zip(a_end, b_end):
        out.append((list(a[a_at:p]), list(b[b_at:q])))
        a_at, b_at = p, q
    return out


def test_random_texts_and_units(aligner, monkeypatch):
    """Mixed scripts, byte fallback and white space, whole and in units, with tables dropped on the way."""
    rnd = random.Random(5)
    some = ["é", "𓀀", "𓀁", "中", "🙂", "👩‍👩‍👧", "a", "the", "ing", " ", " ", " ", "  ", "\n", "\t", ".", "1", "23", "\u00a0", "ﬁ", "Å", "ა", "'s", "<s>", "�"]
    monkeypatch.setattr(ta, "KNOWN_TOKENS", 300)
    units = ta.Units(aligner)
    assert aligner.splits                                      # no piece holds a space after another character
    for _ in range(100):
        texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 40))) for _ in range(4)]
        n_a, n_b, n_groups, n_links, text, *lists = (c.to_pylist() for c in units.together(texts))
        for i, t in enumerate(texts):
            want = plain(aligner, t)
            a, b, a_end, b_end, key, times = (x[i] for x in lists)
            assert groups_of(a, b, a_end, b_end) == want, t
            assert text[i] == ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in want)
            linked = Counter(u << 32 | v for p, q in want for u in p for v in q)
            assert dict(zip(key, times)) == linked
            assert (n_a[i], n_b[i], n_groups[i], n_links[i]) == (len(a), len(b), len(want), sum(linked.values()))
        # whole texts beside each other, not cut into units
        x = aligner.align([t for t in texts if t])
        assert x.groups_n.tolist() == [len(plain(aligner, t)) for t in texts if t]
        assert [w.decode().rstrip(";") for w in ta.written(x)] == [w for w, t in zip(text, texts) if t]


def test_long_groups_are_linked_by_distinct_ids():
    rng = np.random.default_rng(1)
    x = ta.Aligned(np.array([True, False, True]), rng.integers(0, 9, 707), np.array([705, 0, 2]), rng.integers(0, 7, 605), np.array([604, 0, 1]),
                   np.array([2, 700, 3, 2]), np.array([3, 600, 1, 1]), np.array([3, 0, 1]))
    want, a, b = [Counter(), Counter()], 0, 0
    for g, (n, m) in enumerate(zip(x.a_size, x.b_size)):
        want[g == 3].update(int(u) << 32 | int(v) for u in x.a[a:a + n] for v in x.b[b:b + m])
        a, b = a + n, b + m
    key, times, n = ta.links(x)
    assert n.tolist() == [len(want[0]), 0, len(want[1])]
    assert list(zip(key.tolist(), times.tolist())) == [kv for w in want for kv in sorted(w.items())]


def test_odd_rows_keep_their_columns(odd, nothing, aligner):
    out = ta.align(odd, wanted=("groups", "b_ids"))
    assert out.columns == odd.columns + ["__align"]
    rows = out.collect()
    assert len(rows) == len(TEXTS) and {r["row"] for r in rows} == {"clash-row"}
    for r in rows:
        want = plain(aligner, r["text"])
        assert r["__align"]["n_groups"] == len(want) and r["__align"]["b_ids"] == [y for _, b in want for y in b]
    assert statistics(odd) == plain_statistics(aligner, [t[:2] for t in TEXTS])
    assert ta.statistics(nothing).count() == 0 and ta.align(nothing).count() == 0
