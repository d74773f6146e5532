"""Markdown → HTML by the line fold: hand-written cases, and random block trees that
are written out both as Markdown and, without it, as HTML."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import one
from rivulet.functions.markdown import markdown_document_to_html

CASES = [
    ("# T\n\nSome **b** [l](u)\n\n* a\n* b", "<h1>T</h1>\n<p>Some <strong>b</strong> <a href=\"u\">l</a></p>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>"),
    ("- a\n  - b\n    - c\n- d", "<ul>\n<li>a\n<ul>\n<li>b\n<ul>\n<li>c</li>\n</ul>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>"),
    ("3. x\n4. y\n   - z", "<ol start=\"3\">\n<li>x</li>\n<li>y\n<ul>\n<li>z</li>\n</ul>\n</li>\n</ol>"),
    ("- a\n\n  second\n- b", "<ul>\n<li>a\n<p>second</p>\n</li>\n<li>b</li>\n</ul>"),
    ("- a\n* b", "<ul>\n<li>a</li>\n</ul>\n<ul>\n<li>b</li>\n</ul>"),
    ("> q\n> > r\n\nout", "<blockquote>\n<p>q</p>\n<blockquote>\n<p>r</p>\n</blockquote>\n</blockquote>\n<p>out</p>"),
    ("> lazy\nline", "<blockquote>\n<p>lazy\nline</p>\n</blockquote>"),
    ("> - a\n> - b", "<blockquote>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n</blockquote>"),
    ("- > q\n- x", "<ul>\n<li>\n<blockquote>\n<p>q</p>\n</blockquote>\n</li>\n<li>x</li>\n</ul>"),
    ("```python\na < b && **c**\n\n# no heading\n```\nend", "<pre><code class=\"language-python\">a &lt; b &amp;&amp; **c**\n\n# no heading\n</code></pre>\n<p>end</p>"),
    ("~~~~\n~~~\n~~~~", "<pre><code>~~~\n</code></pre>"),
    ("- ```\n  x\n  ```\n- y", "<ul>\n<li>\n<pre><code>x\n</code></pre>\n</li>\n<li>y</li>\n</ul>"),
    ("> ```\n> x\nout", "<blockquote>\n<pre><code>x\n</code></pre>\n</blockquote>\n<p>out</p>"),
    ("p\n\n    code\n\n    more\n\nq", "<p>p</p>\n<pre><code>code\n\nmore\n</code></pre>\n<p>q</p>"),
    ("Title\n=====\n\nsub\n---\n\n---", "<h1>Title</h1>\n<h2>sub</h2>\n<hr />"),
    ("* * *", "<hr />"),
    ("## H ##\ntext", "<h2>H</h2>\n<p>text</p>"),
    ("year\n1986. A great one", "<p>year\n1986. A great one</p>"),
    ("a  \nb\\\nc", "<p>a<br />\nb<br />\nc</p>"),
    ("<div>\n*raw*\n</div>\n\n*em*", "<div>\n*raw*\n</div>\n<p><em>em</em></p>"),
    ("snake_case_word and __dunder__ and _em_", "<p>snake_case_word and <strong>dunder</strong> and <em>em</em></p>"),
    ("`*a* <b>` and ``x ` y``", "<p><code>*a* &lt;b&gt;</code> and <code>x ` y</code></p>"),
    (r"\*no\* 1 < 2 & 3 &copy;", "<p>*no* 1 &lt; 2 &amp; 3 &copy;</p>"),
    ("![i](a_b_c.png) [t](http://h/x_y_z*w*) <http://h/_a_>",
     "<p><img alt=\"i\" src=\"a_b_c.png\" /> <a href=\"http://h/x_y_z*w*\">t</a> <a href=\"http://h/_a_\">http://h/_a_</a></p>"),
    ("[t](u \"hi\") ***both***", "<p><a href=\"u\" title=\"hi\">t</a> <strong><em>both</em></strong></p>"),
    ("-\n  a", "<ul>\n<li>a</li>\n</ul>"),
    ("- - a", "<ul>\n<li>\n<ul>\n<li>a</li>\n</ul>\n</li>\n</ul>"),
    ("a\r\nb\rc", "<p>a\nb\nc</p>"),
    ("\n\n", ""),
    ("", None),
    (None, None),
]


def test_hand_written_cases(spark):
    got = one(spark, markdown_document_to_html("x"), *[(m,) for m, _ in CASES])
    assert [(m, g) for (m, _), g in zip(CASES, got)] == CASES


WORDS = ["one", "two words", "drei", "a longer line of text", "é"]


def tree(rnd, depth, in_item=False):
    kinds = ["p", "h", "code", "fence", "rule"] + (["ul", "ol", "quote"] * 2 if depth else [])
    kind = rnd.choice([k for k in kinds if not (in_item and k in ("code", "rule"))])
    if kind in ("ul", "ol"):
        return (kind, [[("p", rnd.choice(WORDS))] + [tree(rnd, depth - 1, True) for _ in range(rnd.randint(0, 2))] for _ in range(rnd.randint(1, 3))])
    if kind == "quote":
        return (kind, [tree(rnd, depth - 1) for _ in range(rnd.randint(1, 3))])
    return (kind, rnd.choice(WORDS))


def as_markdown(blocks, depth=0):
    """Lines of blocks; neighbours that would run into one are kept apart by a rule."""
    lines, last = [], None
    for kind, x in blocks:
        if lines:
            lines.append("")
        if kind == last or (kind == "code" and last in ("ul", "ol")):
            lines += ["***", ""]
        last = kind
        if kind == "p":
            lines.append(x)
        elif kind == "h":
            lines.append("### " + x)
        elif kind == "code":
            lines += ["    " + x, "", "      " + x]
        elif kind == "fence":
            lines += ["```", "- " + x, "", "> <" + x, "```"]
        elif kind == "rule":
            lines.append("- - -")
        elif kind == "quote":
            lines += [("> " + s).rstrip() for s in as_markdown(x, depth + 1)]
        else:
            for i, item in enumerate(x):
                mark = "+ " if kind == "ul" else f"{i + 1}. "
                inner = as_markdown(item, depth + 1)
                lines += [mark + inner[0]] + [(" " * len(mark) + s) if s else "" for s in inner[1:]]
    return lines


def as_html(blocks, first_bare=False):
    out, last = "", None
    for i, (kind, x) in enumerate(blocks):
        if kind == last or (kind == "code" and last in ("ul", "ol")):
            out += "<hr />\n"
        last = kind
        if i == 1 and first_bare and not out.endswith("\n"):
            out += "\n"
        if kind == "p":
            out += x if first_bare and i == 0 else f"<p>{x}</p>\n"
        elif kind == "h":
            out += f"<h3>{x}</h3>\n"
        elif kind == "code":
            out += f"<pre><code>{x}\n\n  {x}\n</code></pre>\n"
        elif kind == "fence":
            out += f"<pre><code>- {x}\n\n&gt; &lt;{x}\n</code></pre>\n"
        elif kind == "rule":
            out += "<hr />\n"
        elif kind == "quote":
            out += f"<blockquote>\n{as_html(x)}</blockquote>\n"
        else:
            out += f"<{kind}>\n" + "".join(f"<li>{as_html(item, True)}</li>\n" for item in x) + f"</{kind}>\n"
    return out


@pytest.mark.parametrize("seed", [3, 17])
def test_random_block_trees(spark, seed):
    rnd = random.Random(seed)
    docs = [[tree(rnd, 4) for _ in range(rnd.randint(1, 6))] for _ in range(120)]
    pairs = [("\n".join(as_markdown(d)), fix_bare(as_html(d))) for d in docs]
    got = one(spark, markdown_document_to_html("x"), *[(m,) for m, _ in pairs])
    bad = [(m, g, h) for (m, h), g in zip(pairs, got) if g != h]
    assert not bad, min(bad, key=lambda b: len(b[0]))


def fix_bare(text):
    """A rule after an item's bare first paragraph begins on its own line."""
    for w in WORDS:
        text = text.replace(f"<li>{w}<hr />", f"<li>{w}\n<hr />")
    return text.strip()


def test_long_texts_stay_linear(spark):
    deep = "\n".join("  " * (i % 40) + "- item" for i in range(8_000))
    flat = "word " * 5 + "\n" + "line of one paragraph\n" * 20_000
    n = one(spark, F.length(markdown_document_to_html("x")), (deep,), (flat,))
    assert n[0] > 8_000 * len("<li>item</li>") and n[1] > 20_000 * len("line of one paragraph")


def test_paragraphs_without_a_mark_run_no_rules(spark):
    """The rules of marks stand behind a question for their signs, and answer as before where one is there."""
    from rivulet.functions.markdown import inline_html
    rows = ["plain words, 1 + 1 = 2 (so) ~ #!", "a *b* c", "x title=\"\" />", "a < b & c", "l  \nm", "l \nm", "a\\\nb", "[t](u)", "é — ü", "", "a > b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(inline_html(F.col("t"))).collect()]
    assert got == [rows[0], "a <em>b</em> c", "x />", "a &lt; b &amp; c", "l<br />\nm", "l\nm", "a<br />\nb", "<a href=\"u\">t</a>", "é — ü", "", "a > b"]
    shown = df.select(inline_html(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN RLIKE" in shown
