"""Spark functions vs their DuckDB SQL on random messy inputs (regex dialect
differences would show here before they show on new data)."""

import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from rivulet import functions as RF
from rivulet.functions.html import sql_html_to_markdown, sql_normalize_html
from rivulet.plans import oracle as O

FRAGMENTS = ["<p>", "</p>", "<div class='x'>", "</div>", "<h1>", "</h1>", "<h3 id=a>", "</h3>", "<b>", "</b>",
             "<em>", "</em>", "<br>", "<br/>", "<ul>", "<li>", "</li>", "</ul>", '<a href="http://x.org/a">',
             '<a href="#top">', "</a>", '<img src="i.png" alt="pic">', "<!-- c -->", "<script>var a='<p>';</script>",
             "<style>p{}</style>", "&amp;", "&lt;", "&gt;", "&quot;", "&#39;", "&nbsp;", "&rsquo;", "&#8220;",
             "&amp;lt;", "Hello", "World.", " ", "\n", "\t", "  ", "é", "Ünïcode", "a < b", "x&y", "\xa0", " ",
             "Mr. Smith! Yes? ", "HTTPS://Example.COM:443/a b", "AbcDef Ghi"]


def _samples(n=300, seed=13):
    rng = random.Random(seed)
    return ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["", None]


def _compare(spark, col_fn, sql_fn):
    texts = _samples()
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
           .orderBy("i").select(col_fn(F.col("t"))).collect()]
    con = duckdb.connect()
    con.register("src", pa.table({"i": list(range(len(texts))), "t": texts}))
    want = [r[0] for r in con.execute(f"SELECT {sql_fn('t')} FROM src ORDER BY i").fetchall()]
    bad = [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]
    assert not bad, bad[:3]


def test_html_to_markdown_cross_engine(spark):
    _compare(spark, lambda c: RF.html_to_markdown(RF.normalize_html(c)),
             lambda t: sql_html_to_markdown(sql_normalize_html(t)))


def test_text_functions_cross_engine(spark):
    _compare(spark, lambda c: RF.truncate_markdown(c, 3, 40), lambda t: O.truncate_markdown(t, 3, 40))
    _compare(spark, lambda c: F.array_join(RF.sentences(c), "|"), lambda t: f"array_to_string({O.sentences(t)}, '|')")
    _compare(spark, RF.partition_key_from_title, O.partition_key)
    _compare(spark, RF.readability, O.readability)
    _compare(spark, RF.normalize_url, O.normalize_url)
