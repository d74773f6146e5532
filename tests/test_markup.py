"""HTML to Markdown by a fold: hand-written pages, and a parser of its own over the given pages and random nestings."""

import html
import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from conftest import SF_SMALL, one
from rivulet.functions.markup import BLOCKS, page_to_markdown

CASES = [
    ("<p>One <b>two</b> <i>three</i></p><p>four</p>", "One **two** _three_\n\nfour"),
    ("<h1>T</h1><div><div>a<div>b</div></div>c</div>", "# T\n\na\n\nb\n\nc"),
    ("<ul><li>a<ul><li>b</li><li>c<ol><li>d</li><li>e</li></ol></li></ul></li><li>f</li></ul><p>g</p>",
     "* a\n    * b\n    * c\n      1. d\n      2. e\n  * f\n\ng"),
    ("<ol><li>a</li><li><p>b</p><p>c</p></li><li>d</li></ol>", "1. a\n  2. b\n    c\n  3. d"),
    ("<p>x</p><blockquote><p>q</p><p>r</p><blockquote>s</blockquote></blockquote><p>y</p>", "x\n\n> q\n>\n> r\n>\n> > s\n\ny"),
    ("<p>x</p><pre><code>if a &lt; b:\n    c  d\n</code></pre><p>y</p>", "x\n\n    if a < b:\n        c  d\n\ny"),
    ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "a | b\n---|---\n1 | 2"),
    ("<a href='http://x/?a=1&amp;b=2'>l <b>k</b></a> <a href=\"#top\">up</a> <a>z</a> <img alt='i > j' src=p.png>",
     "[l **k**](http://x/?a=1&b=2) up z ![i > j](p.png)"),
    ("a<br>b<hr>c<!-- <p>no</p> --><script>var p = '<p>no</p>';</script> <code>d</code>", "a\nb\n\n* * *\n\nc `d`"),
    ("<b><b>x</b></b></ul></li></a>y < z & &copy; <unknown attr='>'>w</unknown>", "****x****y < z & © w"),
    ("  lots \n of\t space  ", "lots of space"), ("", ""), (None, ""),
    ("<ul><li>never closed<p>more", "* never closed\n    more"),
]


def test_written_cases(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "i int, x string").select("i", page_to_markdown("x").alias("m"))
    assert {r["i"]: r["m"] for r in df.collect()} == {i: w for i, (_, w) in enumerate(CASES)}


class Plain(HTMLParser):
    """The same page from a parser's events, as a list of lines."""

    DROPPED = ("script", "style", "head", "title", "noscript", "template")

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.text, self.gap, self.mark, self.lists, self.quotes, self.low, self.pre, self.links, self.cells, self.rows = "", 0, "", [], 0, 0, 0, [], 0, 0
        self.dropped = None

    def say(self, s):
        if not s:
            return
        if self.text and self.gap:
            blank = ("> " * min(self.low, self.quotes)).rstrip()
            self.text += "\n" + (blank + "\n" if self.gap > 1 else "") + "> " * self.quotes
        elif not self.text:
            self.text += "> " * self.quotes
        self.text, self.gap, self.mark, self.low = self.text + self.mark + s, 0, "", self.quotes

    def block(self, tag):
        if tag in BLOCKS and self.lists:
            if not self.mark:
                self.gap, self.mark = max(self.gap, 1), "  " * (len(self.lists) + 1)
        elif tag in BLOCKS or tag in ("blockquote", "pre", "table") or re.fullmatch("h[1-6]", tag):
            self.gap = 2
            if tag not in BLOCKS:
                self.mark = ""

    def handle_starttag(self, tag, attrs):
        if self.dropped:
            return
        if tag in self.DROPPED:
            self.dropped = tag
            return
        a = {k: v or "" for k, v in attrs}
        self.block(tag)
        if tag == "blockquote":
            self.low, self.quotes = min(self.low, self.quotes), self.quotes + 1
        elif re.fullmatch("h[1-6]", tag):
            self.mark = "#" * int(tag[1]) + " "
        elif tag in ("ul", "ol"):
            self.gap = max(self.gap, 1 if self.lists else 2)
            self.mark = ""
            self.lists.append([tag, 0])
        elif tag == "li":
            self.gap = max(self.gap, 1)
            kind = "* "
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                kind = f"{self.lists[-1][1]}. "
            self.mark = "  " * max(1, len(self.lists)) + kind
        elif tag in ("b", "strong", "i", "em"):
            self.say("**" if tag in ("b", "strong") else "_")
        elif tag == "code" and not self.pre:
            self.say("`")
        elif tag == "a":
            self.links.append(a.get("href", ""))
            if self.outside():
                self.say("[")
        elif tag == "br":
            self.gap = max(self.gap, 1)
        elif tag == "pre":
            self.pre += 1
        elif tag == "table":
            self.rows = 0
        elif tag == "tr":
            self.gap, self.cells = max(self.gap, 1), 0
        elif tag in ("td", "th"):
            if self.cells:
                self.say(" | ")
            self.cells += 1

    def outside(self):
        return self.links[-1] and not self.links[-1].startswith("#")

    def handle_endtag(self, tag):
        if self.dropped:
            self.dropped = None if tag == self.dropped else self.dropped
            return
        if tag == "tr" and self.rows == 0 and self.cells:
            self.gap = 1
            self.say("|".join(["---"] * self.cells))
            self.gap = 1
        self.rows += tag == "tr"
        self.block(tag)
        if tag in ("ul", "ol"):
            self.gap = max(self.gap, 0 if not self.lists else 1 if len(self.lists) > 1 else 2)
            self.mark = ""
            self.lists = self.lists[:-1]
        elif tag == "blockquote":
            self.quotes = max(0, self.quotes - 1)
            self.low = min(self.low, self.quotes)
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
        elif tag in ("b", "strong", "i", "em"):
            self.say("**" if tag in ("b", "strong") else "_")
        elif tag == "code" and not self.pre:
            self.say("`")
        elif tag == "a" and self.links:
            if self.outside():
                self.say(f"]({self.links[-1]})")
            self.links.pop()

    def handle_data(self, data):
        if self.dropped:
            return
        fresh = self.gap or not self.text
        if self.pre:
            data = re.sub("^\n", "", data) if fresh else data
            self.say(("    " if fresh else "") + data.replace("\n", "\n" + "> " * self.quotes + "    ") if data else "")
        else:
            data = re.sub(r"[ \t\r\n\f]+", " ", data)
            self.say(data.removeprefix(" ") if fresh or self.text.endswith(" ") else data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def plain(page):
    p = Plain()
    p.feed(page)
    p.close()
    return html.unescape(re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(\n|\Z)", r"\1", p.text))).strip()


def test_given_pages(spark):
    import __spark_entry__ as entry
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    rows = entry.queries()["page_markdown"](spark, SF_SMALL).collect()
    assert len(rows) == len(pages) and all(r["markdown"] == plain(pages[r["page_id"]]) for r in rows)


def test_random_nestings(spark):
    """Well-formed trees, deep enough that the fold passes from chunk to chunk."""
    rnd = random.Random(11)
    inline, words = ["b", "em", "code", "span", "a"], ["one", "two", "x  y", "é", "3", "&amp;", "\n"]

    def tree(depth):
        if depth == 0 or rnd.random() < 0.2:
            t = rnd.choice(words)
            return t if rnd.random() < 0.6 else (lambda n: f"<{n}{' href=http://h/' if n == 'a' else ''}>{t}</{n}>")(rnd.choice(inline))
        kind = rnd.choice(["p", "div", "ul", "ol", "blockquote", "h2", "table", "section", "pre"])
        inner = [tree(depth - 1) for _ in range(rnd.randint(1, 4))]
        if kind in ("ul", "ol"):
            inner = [f"<li>{x}</li>" for x in inner]
        if kind == "table":
            inner = ["<tr>" + "".join(f"<td>{rnd.choice(words)}</td>" for _ in range(3)) + "</tr>" for _ in inner]
        if kind == "pre":
            inner = ["a\n  b\n", "c"]
        return f"<{kind}>{''.join(inner)}</{kind}>"

    pages = ["".join(tree(5) for _ in range(rnd.randint(1, 6))) for _ in range(150)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, x string").select("i", "x", page_to_markdown("x").alias("m"))
    bad = [(r["x"], r["m"], plain(r["x"])) for r in df.collect() if r["m"] != plain(r["x"])]
    assert not bad, min(bad, key=lambda b: len(b[0]))


def test_long_pages_stay_linear(spark):
    page = "<ul>" + "<li>item <b>bold</b> text</li>" * 20_000 + "</ul>"
    out = one(spark, F.length(page_to_markdown("x")), (page,))[0]
    assert out == len("\n".join(["  * item **bold** text"] * 20_000)) - 2
