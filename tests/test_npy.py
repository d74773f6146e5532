"""``.npy`` blobs against numpy, both ways."""

import io
import struct

import numpy as np
from pyspark.sql import functions as F

from rivulet.functions.npy import array_to_npy, npy_to_array
from rivulet.sources.feeds import read_embeddings


def blob(a, version=None):
    f = io.BytesIO()
    np.lib.format.write_array(f, np.asarray(a), version=version)
    return f.getvalue()


def same(got, want):
    want = np.asarray(want, dtype="f8").ravel()
    return got is not None and struct.pack(f"{len(got)}d", *got) == struct.pack(f"{len(want)}d", *want)


def test_blobs_of_numpy_are_read(spark):
    rnd = np.random.default_rng(3)
    odd = [0.0, -0.0, 1.0, -1.5, np.inf, -np.inf, 1e-45, -3e-39, 3.4028235e38, 1.1754944e-38]
    bits4 = rnd.integers(0, 2**32, 400, dtype=np.uint32).view("f4")
    bits8 = rnd.integers(0, 2**63, 400, dtype=np.uint64).view("f8")
    arrays = [np.array(odd, "f4"), np.array(odd + [5e-324, 1.7e308, 2.2e-308], "f8"), bits4[~np.isnan(bits4)], -bits8[~np.isnan(bits8)],
              bits4[~np.isnan(bits4)].astype(">f4"), bits8[~np.isnan(bits8)].astype(">f8"), np.zeros(0, "f4"), np.arange(6, dtype="f8").reshape(2, 3),
              np.float32(2.5), rnd.normal(size=1536).astype("f4")]
    blobs = [blob(a) for a in arrays] + [blob(arrays[0], (2, 0)), blob(arrays[1], (3, 0))]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, b binary").select("i", npy_to_array("b").alias("a"))
    got = {r["i"]: r["a"] for r in df.collect()}
    assert all(same(got[i], a) for i, a in enumerate(arrays + arrays[:2]))
    nan = spark.createDataFrame([(bytearray(blob(np.array([np.nan, 1], "f4"))),)], "b binary").select(npy_to_array("b")).first()[0]
    assert np.isnan(nan[0]) and nan[1] == 1.0


def test_what_is_no_array_of_real_numbers_is_null(spark):
    good = blob(np.arange(4, dtype="f4"))
    bad = [None, b"", b"text", b"\x93NUMPY", good[:-1], good + b"\0", good[:20], blob(np.arange(4)), blob(np.array(["a"])), blob(np.array([1j]))]
    df = spark.createDataFrame([(None if b is None else bytearray(b),) for b in bad], "b binary")
    assert [r[0] for r in df.select(npy_to_array("b")).collect()] == [None] * len(bad)


def test_blobs_written_are_those_of_numpy(spark):
    rnd = np.random.default_rng(5)
    bits = rnd.integers(0, 2**32, 2000, dtype=np.uint32).view("f4")
    edges = np.array([2.0**e * m for e in range(-149, 128) for m in (1, 1 - 2**-24, -1 - 2**-23)], "f8").astype("f4")
    arrays = [bits[~np.isnan(bits)], edges, np.array([0, -0.0, np.inf, -np.inf, np.nan], "f4"), np.zeros(0, "f4"), rnd.normal(size=64).astype("f4")]
    df = spark.createDataFrame([(i, [float(x) for x in a]) for i, a in enumerate(arrays)], "i int, a array<float>").select("i", array_to_npy("a").alias("b"))
    got = {r["i"]: bytes(r["b"]) for r in df.collect()}
    assert all(got[i] == blob(a) for i, a in enumerate(arrays))
    nulls = spark.createDataFrame([(None,), ([None, 1.0],)], "a array<double>").select(array_to_npy("a").alias("b")).select(npy_to_array("b")).collect()
    assert nulls[0][0] is None and np.isnan(nulls[1][0][0]) and nulls[1][0][1] == 1.0


def test_embeddings_of_a_folder(spark, tmp_dir):
    for name, a in (("k1", [0.25, -1.0]), ("k2", [])):
        np.save(f"{tmp_dir}/{name}.npy", np.array(a, "f4"))
    with open(f"{tmp_dir}/k3.npy", "wb") as f:
        f.write(b"broken")
    rows = {r["row_key"]: r["embedding"] for r in read_embeddings(spark, tmp_dir).collect()}
    assert rows == {"k1": [0.25, -1.0], "k2": [], "k3": None}
    assert dict(read_embeddings(spark, tmp_dir).dtypes)["embedding"] == "array<float>"
    assert read_embeddings(spark, tmp_dir).where(F.col("embedding").isNull()).count() == 1
