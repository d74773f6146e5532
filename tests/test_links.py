"""Relative references against RFC 3986's own examples and urljoin, punycode against the codec."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

import rivulet.functions as RF
from conftest import one

# RFC 3986, 5.4: base http://a/b/c/d;p?q
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y",
    "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x",
    "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/",
    "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g",
    "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..",
    "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
    "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x",
    "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_published_references(spark):
    got = one(spark, RF.resolve_url(F.lit("http://a/b/c/d;p?q"), "x"), *[(r,) for r in EXAMPLES])
    assert dict(zip(EXAMPLES, got)) == EXAMPLES


def test_random_references(spark):
    rnd = random.Random(4)
    seg = lambda: "/".join(rnd.choice(["a", "b.c", "..", ".", "d"]) for _ in range(rnd.randint(1, 6)))
    rows = [("http://h" + rnd.choice(["", "/", "/x", "/x/y/", "/x/y/z"]) + rnd.choice(["", "?k=/v"]),
             rnd.choice(["", "/", "//o/"]) + seg() + rnd.choice(["", "/", "?q", "#f", "?q#f"])) for _ in range(400)]
    got = one(spark, RF.resolve_url("b", "x"), *rows, schema="b string, x string")
    # urljoin leaves the dots of a reference with a host of its own, so that host is its base
    want = [urljoin("http://o/", r[4:]) if r.startswith("//o/") else urljoin(b, r) for b, r in rows]
    assert list(zip(rows, got)) == list(zip(rows, want))


def test_references_without_a_base(spark):
    rows = [(None, "x"), ("http://h/", None), (None, "http://o/../p"), ("", "/x"), ("http://h/a", " b\n c "), ("http://h/a", "mailto:a@b.c")]
    assert one(spark, RF.resolve_url("b", "x"), *rows, schema="b string, x string") == [None, None, "http://o/p", None, "http://h/b c", "mailto:a@b.c"]


def test_punycode(spark):
    rnd = random.Random(9)
    letters = "abcxyz-019äöüßéñçøłжщяคไ中文日本語한국어😀𐍈א"
    labels = ["bücher", "mañana", "ü", "他们为什么不说中文", "почемужеонинеговорятпорусски", "3年b組金八先生", "パフィーdeルンバ", "ไทย"]
    labels += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    got = one(spark, RF.punycode("x"), *[(s,) for s in labels])
    assert [(s, g) for s, g in zip(labels, got)] == [(s, s.encode("punycode").decode()) for s in labels]


def test_hosts_of_other_scripts(spark):
    cases = [("HTTP://BÜCHER.example:80/Straße", "http://xn--bcher-kva.example/Straße"), ("https://例え。テスト/", "https://xn--r8jz45g.xn--zckzah/"),
             ("https://plain.example/a", "https://plain.example/a"), ("ftp://bücher.example/", None), (None, None)]
    assert one(spark, RF.normalize_link(F.lit(""), "x"), *[(u,) for u, _ in cases]) == [w for _, w in cases]
    assert one(spark, RF.normalize_link(F.lit("https://Café.example/a/b"), "x"), ("../c d",), ("//Ü.example",), ("mailto:a@b.c",)) == [
        "https://xn--caf-dma.example/c%20d", "https://xn--tda.example/", None]
