"""HTML → Markdown by a fold over the page's tokens with a stack of open elements.

The page is cut into tokens (tags, text runs, whole comments and scripts).  A
fold carries what is open: the lists with their numbers, quotes, links,
preformatted text, the table row; so nested lists, ordered lists, quotes
within quotes, tables and the same tag within itself come out right, which a
list of replacements cannot do.

All of it is one native expression.  Tokens are folded in chunks of ``CHUNK``,
the state passing from chunk to chunk, so that text is appended to short
strings and long pages stay linear.

Rules: line breaks of the source are spaces; links and images stay, links
within the page become their text; headings, ``**``, ``_`` and back quotes;
``*`` and ``1.`` items, two spaces deeper per list; ``>`` quotes; preformatted
text by four spaces (at most one empty line in a row); table rows with ``|`` and a rule below the first; entities
are decoded last.  Unclosed elements end with the page, unopened ends are ignored.
NULL and '' give ''.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import as_col, let
from ._regex import strip_ws
from .html import ENTITY_RULES

CHUNK = 128
TOKEN = (r"(?is)<!--.*?(?:-->|\z)|<(script|style|head|title|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\z)"
         r"|</?[a-z](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[!?][^>]*>|[^<]++|<[^<]*+")
TAG = r"(?s)^</?([a-zA-Z][a-zA-Z0-9]*)"
BLOCKS = ("address", "article", "aside", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
          "header", "html", "main", "nav", "p", "section", "summary")
STATE = ("struct<out:string,need:int,lead:string,start:boolean,sp:boolean,lists:array<int>,quote:int,low:int,pre:int,"
         "links:array<string>,cells:int,rows:int>")


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in any quoting; '' without it."""
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.regexp_replace(found, r"(?s)^[\"'](.*)[\"']$", "$1")


def _token(t: Column) -> Column:
    """(tag, close, text, href, src, alt): a text run has tag '', what is dropped has tag NULL."""
    tag = F.lower(F.regexp_extract(t, TAG, 1))
    dropped = t.rlike(r"(?is)^<([!?]|(script|style|head|title|noscript|template)\b)")
    is_tag = t.rlike(r"(?is)^</?[a-z][^<]*>$")
    only = lambda when, value: F.when(is_tag & when, value).otherwise("")
    return F.struct(F.when(dropped, F.lit(None)).when(is_tag, tag).otherwise("").alias("tag"), t.startswith("</").alias("close"),
                    F.when(is_tag, "").otherwise(t).alias("text"), only(tag == "a", _attribute(t, "href")).alias("href"),
                    only(tag == "img", _attribute(t, "src")).alias("src"), only(tag == "img", _attribute(t, "alt")).alias("alt"))


def _repeat(text: str, n: Column) -> Column:
    return F.repeat(F.lit(text), F.greatest(n, F.lit(0)))


def _step(acc: Column, t: Column) -> Column:
    tag, close = F.coalesce(t["tag"], F.lit("!")), t["close"]
    is_ = lambda *names: tag.isin(*names)
    opens, ends = (lambda *n: is_(*n) & ~close), (lambda *n: is_(*n) & close)
    depth, quoted, in_pre = F.size(acc["lists"]), _repeat("> ", acc["quote"]), acc["pre"] > 0
    line = acc["start"] | (acc["need"] > 0)
    heading = tag.rlike("^h[1-6]$")
    # --- what the token adds
    run = F.when(in_pre, F.regexp_replace(F.when(line, F.regexp_replace(t["text"], r"^\r?\n", "")).otherwise(t["text"]), r"\r?\n", "\n"))
    flat = F.regexp_replace(t["text"], r"[ \t\r\n\f]+", " ")
    flat = F.when(line | acc["sp"], F.regexp_replace(flat, "^ ", "")).otherwise(flat)
    own_link = F.size(acc["links"]) > 0
    href = F.element_at(acc["links"], -1)
    outside = lambda h: (h != "") & ~h.startswith("#")
    rule = ends("tr") & (acc["rows"] == 0) & (acc["cells"] > 0)
    piece = (F.when(tag == "", F.when(in_pre, F.replace(run, F.lit("\n"), F.concat(F.lit("\n"), quoted, F.lit("    ")))).otherwise(flat))
             .when(is_("b", "strong"), "**").when(is_("i", "em"), "_").when(is_("code") & ~in_pre, "`")
             .when(opens("a") & outside(t["href"]), "[").when(ends("a") & own_link & outside(href), F.concat(F.lit("]("), href, F.lit(")")))
             .when(opens("img"), F.concat(F.lit("!["), t["alt"], F.lit("]("), t["src"], F.lit(")")))
             .when(opens("hr"), "* * *").when(opens("td", "th") & (acc["cells"] > 0), " | ")
             .when(rule, F.concat(F.lit("---"), _repeat("|---", acc["cells"] - 1))).otherwise(""))
    says = piece != ""
    # --- the line break before it
    need = F.when(rule, 1).when(opens("hr"), 2).otherwise(acc["need"])
    before = (F.when(acc["start"], quoted).when(need == 0, "").when(need == 1, F.concat(F.lit("\n"), quoted))
              .otherwise(F.concat(F.lit("\n"), F.rtrim(_repeat("> ", F.least(acc["low"], acc["quote"]))), F.lit("\n"), quoted)))
    before = F.concat(before, acc["lead"], F.when(in_pre & (tag == "") & line, "    ").otherwise(""))
    # --- the line break that it asks for
    plain = is_(*BLOCKS)
    in_item = depth > 0
    asks = (F.when(heading | is_("blockquote", "pre", "table", "hr"), 2).when(plain, F.when(in_item, F.when(acc["lead"] != "", 0).otherwise(1)).otherwise(2))
            .when(ends("ul", "ol") & ~in_item, 0).when(is_("ul", "ol"), F.when(depth - F.when(close, 1).otherwise(0) > 0, 1).otherwise(2))
            .when(is_("br") | opens("li") | opens("tr") | rule, 1).otherwise(0))
    left = F.when(says, 0).otherwise(acc["need"])
    # --- what is open after it
    top = F.element_at(acc["lists"], -1)
    rest = F.slice(acc["lists"], 1, F.greatest(depth - 1, F.lit(0)))
    lists = (F.when(opens("ul"), F.concat(acc["lists"], F.array(F.lit(0)))).when(opens("ol"), F.concat(acc["lists"], F.array(F.lit(1))))
             .when(ends("ul", "ol"), rest).when(opens("li") & (depth > 0) & (top > 0), F.concat(rest, F.array(top + 1))).otherwise(acc["lists"]))
    bullet = F.concat(_repeat("  ", F.greatest(depth, F.lit(1))), F.when((depth > 0) & (top > 0), F.concat(top.cast("string"), F.lit(". "))).otherwise("* "))
    lead = (F.when(opens("li"), bullet).when(heading & ~close, F.concat(_repeat("#", F.substring(tag, 2, 1).try_cast("int")), F.lit(" ")))
            .when(heading | is_("ul", "ol", "blockquote", "pre", "table"), "").when(plain & in_item & (acc["lead"] == ""), _repeat("  ", depth + 1))
            .when(says, "").otherwise(acc["lead"]))
    quote = F.when(opens("blockquote"), acc["quote"] + 1).when(ends("blockquote"), F.greatest(acc["quote"] - 1, F.lit(0))).otherwise(acc["quote"])
    pre = F.when(opens("pre"), acc["pre"] + 1).when(ends("pre"), F.greatest(acc["pre"] - 1, F.lit(0))).otherwise(acc["pre"])
    links = (F.when(opens("a"), F.concat(acc["links"], F.array(t["href"])))
             .when(ends("a") & own_link, F.slice(acc["links"], 1, F.size(acc["links"]) - 1)).otherwise(acc["links"]))
    cells = F.when(opens("tr"), 0).when(opens("td", "th"), acc["cells"] + 1).otherwise(acc["cells"])
    rows = F.when(opens("table"), 0).when(ends("tr"), acc["rows"] + 1).otherwise(acc["rows"])
    return F.struct(
        F.when(says, F.concat(acc["out"], before, piece)).otherwise(acc["out"]).alias("out"), F.greatest(left, asks).alias("need"), lead.alias("lead"),
        (acc["start"] & ~says).alias("start"), F.when(says, piece.endswith(" ")).otherwise(acc["sp"]).alias("sp"), lists.alias("lists"),
        quote.alias("quote"), F.least(F.when(says, acc["quote"]).otherwise(acc["low"]), quote).alias("low"), pre.alias("pre"), links.alias("links"),
        cells.alias("cells"), rows.alias("rows")).cast(STATE)


def _fold(tokens: Column) -> Column:
    none = F.array().cast("array<string>")
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("need"), F.lit("").alias("lead"), F.lit(True).alias("start"), F.lit(False).alias("sp"),
                     F.array().cast("array<int>").alias("lists"), F.lit(0).alias("quote"), F.lit(0).alias("low"), F.lit(0).alias("pre"),
                     none.alias("links"), F.lit(0).alias("cells"), F.lit(0).alias("rows")).cast(STATE)
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(CHUNK)), lambda at: F.slice(tokens, at + 1, CHUNK))
    whole = F.aggregate(chunks, F.struct(first.alias("state"), none.alias("parts")), lambda acc, chunk: let(
        F.aggregate(chunk, acc["state"], lambda s, t: let(_token(t), lambda x: _step(s, x))),
        lambda s: F.struct(s.withField("out", F.lit("")).cast(STATE).alias("state"), F.concat(acc["parts"], F.array(s["out"])).alias("parts"))),
        lambda acc: F.concat_ws("", acc["parts"]))
    return whole


def page_to_markdown(html) -> Column:
    """Markdown of a page or fragment."""
    text = F.coalesce(as_col(html), F.lit(""))
    out = let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), _fold)
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+(\n|\z)", "$1"), r"\n{3,}", "\n\n")
    for entity, char in ENTITY_RULES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip_ws(out)
