"""Vector codes against plain Lloyd rounds, and their defined cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import vector_codes as vc
from rivulet.llm.common import read


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes and errors of rows ((id, vector), in the order of the ids), and the codebooks."""
    x = np.floor(np.array([v for _, v in rows], np.float64) * scale).astype(np.int64)
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)
    books = [x[:entries, p].copy() for p in range(parts)]
    nearest = lambda p: ((x[:, p, None] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(parts):
            a = nearest(p).argmin(axis=1)
            for e in set(a.tolist()):
                books[p][e] = x[a == e, p].sum(axis=0) // (a == e).sum()
    far = [nearest(p) for p in range(parts)]
    return [([int(f[i].argmin()) for f in far], int(sum(f[i].min() for f in far))) for i in range(len(rows))], np.array(books)


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(c) for c in v] if v is not None else None) for i, v in rows], "vec_id long, embedding array<double>")


def check(spark, rows, **kw):
    codes, books = vc.compress(frame(spark, rows).repartition(3), **kw)
    want, want_books = plain(rows, **kw)
    got = {r["id"]: (r["codes"], r["error"]) for r in codes.collect()}
    assert got == {i: w for (i, _), w in zip(rows, want)}
    assert (books.entries == want_books).all()


def test_given_vectors(spark):
    rows = [tuple(r) for r in read(spark, "/root/testdata/sf0.01", "embeddings").select("vec_id", "embedding").orderBy("vec_id").collect()]
    check(spark, rows)


@pytest.mark.parametrize("n,length,parts,entries", [(500, 16, 8, 16), (700, 6, 2, 16), (300, 10, 4, 7), (5, 8, 8, 16), (1, 4, 2, 3), (200, 3, 8, 16)])
def test_random_vectors(spark, n, length, parts, entries):
    """Clusters, ties and copies; lengths that the parts do not divide; fewer rows than entries."""
    rng = np.random.default_rng(n)
    x = rng.integers(-3, 4, (n, length)) + rng.choice([0, 0, 0.01, 0.3], (n, length)) * rng.standard_normal((n, length))
    x[n // 2:] = x[rng.integers(0, n, n - n // 2)]
    check(spark, [(i * 3, v) for i, v in enumerate(x)], parts=parts, entries=entries, scale=16)


@pytest.mark.parametrize("width,entries,n", [(1, 16, 3000), (2, 16, 4000), (8, 16, 500), (3, 5, 1000), (2, 1, 300)])
def test_dual_tree_assigns_as_the_plain_method(width, entries, n):
    rng = np.random.default_rng(width)
    x = np.concatenate([rng.integers(-20, 21, (n // 2, width)), 1000 * rng.integers(-2, 3, (n - n // 2, width)) + rng.integers(-5, 6, (n - n // 2, width))])
    book = np.concatenate((x[rng.integers(0, n, max(1, entries - 2))], x[:2]))[:entries]
    tree = vc.Tree(x, vc.LEAF)
    got, whole = np.full(n, -1), 0
    for level, at, entry, far in vc.assign(tree, book):
        if level < 0:
            assert (far == ((tree.points[at] - book[entry]) ** 2).sum(axis=1)).all()
            got[at] = entry
        else:
            for a, e in zip(at, entry):
                lo, hi = tree.cut[level][a:a + 2]
                assert (got[lo:hi] == -1).all() and (tree.sum[level][a] == tree.points[lo:hi].sum(axis=0)).all()
                got[lo:hi], whole = e, whole + hi - lo
    want = ((tree.points[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (got == want).all()
    assert whole > n / 3 or width > 2              # nodes are assigned whole where there are clusters


def test_unusable_vectors_take_no_part(spark):
    good = [(i, [i % 5 - 2.5, i % 3, i / 7, 1.0]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [math.nan] * 4), (104, [math.inf, 0, 0, 0]), (105, [1.0]), (106, [1e9, 0, 0, 0])]
    schema = "vec_id long, embedding array<double>"
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in good + bad]
    df = spark.createDataFrame(rows, schema).withColumn("id", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("error", F.lit("x"))
    codes, books = vc.compress(df, parts=2, entries=4)
    want, want_books = plain(good, 2, 4)
    assert {r["id"]: (r["codes"], r["error"]) for r in codes.collect()} == {i: w for (i, _), w in zip(good, want)}
    assert (books.entries == want_books).all()


def test_null_and_repeated_ids_and_labels(spark):
    rows = [(None, [9.0, 9.0], None), (2, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (1, [0.5, 0.5], None), (1, [0.5, 0.5], "b"), (3, [5.0, 5.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    codes, books = vc.compress(df, parts=1, entries=2, rounds=0, carry=["label"])
    assert (books.entries[0] == np.array([[2048, 2048], [2048, 2048]])).all()         # the two rows of id 1
    out = vc.error_by(codes, "label").collect()
    assert len(out) == 6
    total = {}
    for r in out:
        total[r["label"]] = total.get(r["label"], 0) + r["error"]
    assert all(r["key_error"] == total[r["label"]] for r in out)
    twos, _ = vc.compress(df, parts=1, entries=6, rounds=0)
    by = sorted((str(r["id"]), r["codes"], r["error"]) for r in twos.collect())
    assert by == [("1", [0], 0), ("1", [0], 0), ("2", [2], 0), ("2", [3], 0), ("3", [4], 0), ("None", [5], 0)]   # ids tie by components, null last


def test_empty(spark):
    codes, books = vc.compress(frame(spark, [(1, None)]).limit(0), carry=["vec_id"])
    assert codes.count() == 0 and books is None
    assert vc.error_by(codes, "vec_id").count() == 0
    codes, books = vc.compress(frame(spark, [(1, None)]))
    assert codes.count() == 0 and books is None
