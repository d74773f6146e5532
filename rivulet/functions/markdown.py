"""Markdown → HTML by a fold over the lines with a stack of open containers (F10d).

Each line is first matched against the open quotes and list items, then opens
new ones, and what is left of it is a leaf: paragraph, heading (``#`` or
underlined), fenced or indented code, rule, block of HTML.  Inline marks are
rendered in a second pass over the finished paragraphs, where code, escapes,
link targets and tags are set aside first, so that marks inside them stay.

All of it is one native expression.  Lines are folded in chunks of ``CHUNK``
and a paragraph goes out line by line, so long texts stay linear.

Rules: a quote or item ends at the first line that does not go on with it,
except that a plain line goes on with an open paragraph.  Neighbouring items of
one sign are one list; an ordered list begins with its first number.  An item's
first paragraph has no ``<p>``, later ones do.  Unclosed fences end with their
container.  A tab is four spaces.  HTML passes, other ``&``, ``<`` are escaped.
NULL and '' give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import as_col, let
from ._regex import WS_CHARS

CHUNK = 64
# signs of the passes in between; noncharacters, which no text for interchange holds
BEGIN, END = chr(0xFDD0), chr(0xFDD1)
MARKS = "*_`[]()!<>&\\~"
IN_TARGET = "*_[]~"
HELD = "".join(chr(0xFDD2 + i) for i in range(len(MARKS)))

QUOTE = r"^ {0,3}> ?"
MARKER = r"\G {0,3}(?:> ?|(?!(?:\* *){3,}$|(?:- *){3,}$)(?:[*+-]|[0-9]{1,9}[.)])(?: {1,4}(?=[^ ])| (?= {4})| *$))"
# what a rule, an underline, a heading, a fence or a block of HTML, and what a container begins with
LEAF_SIGNS = ("*", "-", "_", "=", "#", "`", "~", "<")
OPEN_SIGNS = (">", "*", "+", "-", *"0123456789")
RULE = r"^ {0,3}(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$"
UNDERLINE = r"^ {0,3}(=+|-+) *$"
HEADING = r"^ {0,3}(#{1,6})(?: +(.*?))??(?: +#+)? *$"
FENCE = r"^ {0,3}(`{3,}|~{3,}) *([^` ]*)[^`]*$"
FENCE_END = r"^ {0,3}(`{3,}|~{3,}) *$"
RAW = (r"(?i)^ {0,3}(?:<!--|</?(?:address|article|aside|blockquote|body|center|details|div|dl|dt|dd|fieldset|figcaption|figure|footer|form|h[1-6]|head"
       r"|header|hr|html|iframe|li|main|nav|ol|p|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[\s/>]|$))")
STATE = ("struct<out:string,nl:boolean,stack:array<struct<kind:string,width:int>>,leaf:string,fence:string,tight:boolean,first:boolean,blanks:int>")

INLINE = r"(?s)(`+)(?!`).*?(?<!`)\1(?!`)|`+|\\[\\`*_\[\](){}#+.!~<>&|-]|\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*|<[a-zA-Z/][^<>]*>|[^`\\\]<]+|."
# without one of these a paragraph is its own HTML
INLINE_SIGNS = rf"[*_`\[\]<>&\\{HELD[0]}-{HELD[-1]}]| \n"
INLINE_RULES = [
    (r"&(?!#?[A-Za-z0-9]+;)", "&amp;"),
    (r"<", "&lt;"),
    (r"!\[([^\]]*)\]\(([^\s)]*)(?:\s+\"([^\"]*)\")?\s*\)", "<img alt=\"$1\" src=\"$2\" title=\"$3\" />"),
    (r" title=\"\" />", " />"),
    (r"\[([^\[\]]*)\]\(([^\s)]*)(?:\s+\"([^\"]*)\")?\s*\)", "<a href=\"$2\" title=\"$3\">$1</a>"),
    (r"(<a href=\"[^\"]*\") title=\"\">", "$1>"),
    (r"(?s)\*\*\*(?=\S)([^*]+?)(?<=\S)\*\*\*", "<strong><em>$1</em></strong>"),
    (r"(?s)\*\*(?=\S)(.+?)(?<=\S)\*\*", "<strong>$1</strong>"),
    (r"(?s)(?<!\w)__(?=\S)(.+?)(?<=\S)__(?!\w)", "<strong>$1</strong>"),
    (r"(?s)\*(?=\S)([^*]+?)(?<=\S)\*", "<em>$1</em>"),
    (r"(?s)(?<!\w)_(?=\S)([^_]+?)(?<=\S)_(?!\w)", "<em>$1</em>"),
    (r" {2,}\n|\\\n", "<br />\n"),
    (r" +\n", "\n"),
]


def _escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _hold(text: Column) -> Column:
    return F.translate(text, MARKS, HELD)


def _piece(t: Column) -> Column:
    """A token of a paragraph with the marks that are none set aside."""
    code = F.regexp_replace(F.regexp_replace(t, r"(?s)^(`+)(.*)\1$", "$2"), r"(?s)^ (.*[^ ].*) $", "$1")
    target = F.concat(F.lit("]("), F.translate(F.substring(t, 3, 2**30), IN_TARGET, IN_TARGET.translate(str.maketrans(MARKS, HELD))))
    address = F.regexp_replace(t, r"^<([a-zA-Z][a-zA-Z0-9+.-]*:[^\s<>]*)>$", "<a href=\"$1\">$1</a>")
    return (F.when(t.rlike(r"(?s)^`+[^`]") & t.endswith("`"), F.concat(_hold(F.lit("<code>")), _hold(_escape(code)), _hold(F.lit("</code>"))))
            .when(t.startswith("\\") & (F.length(t) == 2) & ~t.endswith("\n"), _hold(_escape(F.substring(t, 2, 9))))
            .when(t.startswith("]("), target).when(t.rlike(r"(?s)^<[a-zA-Z/].*>$"), _hold(address)).otherwise(t))


def inline_html(text: Column) -> Column:
    """Emphasis, code, links, images, line breaks of one paragraph."""
    return let(text, lambda t: F.when(t.rlike(INLINE_SIGNS), _inline_rules(t)).otherwise(t))


def _inline_rules(text: Column) -> Column:
    out = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(INLINE), F.lit(0)), lambda t: _piece(t)), "")
    for pattern, to in INLINE_RULES:
        out = F.regexp_replace(out, pattern, to)
    return F.translate(out, HELD, MARKS)


def _begins(line: Column, signs: tuple[str, ...]) -> Column:
    """Whether the first character other than a space is one of ``signs``: asked before any pattern is run."""
    return F.substring(F.ltrim(line), 1, 1).isin(*signs)


def _is_list(kind: Column) -> Column:
    return kind != ">"


def _list_tag(kind: Column) -> Column:
    return F.when(kind.isin(".", ")"), "ol").otherwise("ul")


def _end_leaf(acc: Column) -> Column:
    """What closes the open leaf."""
    return (F.when(acc["leaf"] == "p", F.concat(F.lit(END), F.when(acc["tight"], "t").otherwise("p")))
            .when(acc["leaf"].isin("fence", "code"), "</code></pre>\n").otherwise(""))


def _nl_after_leaf(acc: Column) -> Column:
    return F.when(acc["leaf"] == "p", ~acc["tight"]).when(acc["leaf"] != "", True).otherwise(acc["nl"])


def _end_containers(closed: Column, sibling: Column) -> Column:
    """Closes these containers, innermost first; a sibling keeps the outermost one's list open."""
    ends = F.transform(closed, lambda c, i: F.when(~_is_list(c["kind"]), "</blockquote>\n").when((i == 0) & sibling, "</li>\n")
                       .otherwise(F.concat(F.lit("</li>\n</"), _list_tag(c["kind"]), F.lit(">\n"))))
    return F.array_join(F.reverse(ends), "")


def _match(acc: Column, line: Column) -> Column:
    """(rest, n): the line behind the open containers that go on, and how many do."""
    def one(m, c):
        more = F.when(~_is_list(c["kind"]), m["rest"].rlike(QUOTE)).otherwise(
            (F.trim(m["rest"]) == "") | m["rest"].startswith(F.repeat(F.lit(" "), c["width"])))
        rest = F.when(~_is_list(c["kind"]), F.regexp_replace(m["rest"], QUOTE, "")).otherwise(F.substring(m["rest"], c["width"] + 1, F.length(m["rest"])))
        go = m["ok"] & more
        return F.struct(F.when(go, rest).otherwise(m["rest"]).alias("rest"), (m["n"] + F.when(go, 1).otherwise(0)).alias("n"), go.alias("ok"))
    return F.aggregate(acc["stack"], F.struct(line.alias("rest"), F.lit(0).alias("n"), F.lit(True).alias("ok")), one)


def _open(acc: Column, m: Column) -> Column:
    """(rest, n, markers, body): the containers that the rest of the line opens, and its leaf."""
    same = m["n"] == F.size(acc["stack"])
    fenced = same & (acc["leaf"] == "fence")
    in_par = same & (acc["leaf"] == "p")
    none = (fenced | (in_par & m["rest"].rlike(UNDERLINE)) | ~_begins(m["rest"], OPEN_SIGNS)
            | (in_par & m["rest"].rlike(r"^ {0,3}(?!0*1[.)])[0-9]{1,9}[.)]")))
    markers = F.when(none, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(m["rest"], F.lit(MARKER), F.lit(0)))
    return let(markers, lambda k: F.struct(m["rest"].alias("rest"), m["n"].alias("n"), k.alias("markers"),
                                           F.substring(m["rest"], F.length(F.array_join(k, "")) + 1, F.length(m["rest"])).alias("body")))


def _container(marker: Column) -> Column:
    bare = F.trim(marker)
    kind = F.when(bare.startswith(">"), ">").otherwise(F.substring(bare, -1, 1))
    width = F.when(F.rtrim(marker) == marker, F.length(marker) + 1).otherwise(F.length(marker))
    return F.struct(kind.alias("kind"), width.cast("int").alias("width"))


def _leaf(acc: Column, x: Column) -> Column:
    """Adds the line's leaf to the containers as they are after it."""
    b = x["body"]
    size = F.size(acc["stack"])
    blank = F.trim(b) == ""
    moved = (x["n"] < size) | (F.size(x["markers"]) > 0)
    fenced = (acc["leaf"] == "fence") & ~moved
    signed = _begins(b, LEAF_SIGNS)
    is_rule, heading, fence, raw = (signed & b.rlike(pattern) for pattern in (RULE, HEADING, FENCE, RAW))
    deep = b.startswith("    ") & ~blank
    plain = ~blank & (~signed | (~is_rule & ~heading & ~fence & ~raw))
    lazy = (acc["leaf"] == "p") & (F.size(x["markers"]) == 0) & plain & (x["n"] < size)
    goes_on = ~moved | lazy
    under = ~moved & (acc["leaf"] == "p") & signed & b.rlike(UNDERLINE)
    kind = (F.when(fenced, F.when(F.regexp_extract(b, FENCE_END, 1).startswith(acc["fence"]), "fence_end").otherwise("fence_line"))
            .when(under, "under").when(blank, F.when((acc["leaf"] == "code") & ~moved, "code_blank").otherwise("blank"))
            .when((acc["leaf"] == "raw") & ~moved, "raw_line")
            .when((acc["leaf"] == "p") & goes_on & (plain | deep), "p_line")
            .when(deep, F.when((acc["leaf"] == "code") & ~moved, "code_line").otherwise("code"))
            .when(~signed, "p").when(is_rule, "rule").when(heading, "heading").when(fence, "fence").when(raw, "raw").otherwise("p"))
    return let(kind, lambda k: _emit(acc, x, k, moved & ~lazy))


def _emit(acc: Column, x: Column, kind: Column, moved: Column) -> Column:
    b, size = x["body"], F.size(acc["stack"])
    stays = kind.isin("fence_line", "code_blank", "raw_line", "p_line", "code_line", "under", "fence_end")
    closed = F.when(moved, F.slice(acc["stack"], x["n"] + 1, F.greatest(size - x["n"], F.lit(0)))).otherwise(F.slice(acc["stack"], 1, 0))
    fresh = F.transform(x["markers"], lambda m: _container(m))
    sibling = moved & (F.size(fresh) > 0) & (x["n"] < size) & _is_list(F.get(acc["stack"], x["n"])["kind"]) & (
        F.get(acc["stack"], x["n"])["kind"] == F.get(fresh, F.lit(0))["kind"])

    def build(v):
        ends = F.concat(F.when(stays, "").otherwise(_end_leaf(acc)), _end_containers(closed, v["sibling"]))
        nl = F.when(F.size(closed) > 0, True).when(stays, acc["nl"]).otherwise(_nl_after_leaf(acc))
        number = lambda i: F.regexp_extract(F.get(x["markers"], i), r"([0-9]+)[.)]", 1).try_cast("int")
        start = lambda i: F.when(number(i) != 1, F.concat(F.lit(" start=\""), number(i).cast("string"), F.lit("\""))).otherwise("")
        opens = F.array_join(F.transform(v["fresh"], lambda c, i: F.concat(
            F.when(F.when(i == 0, nl).otherwise(~_is_list(F.get(v["fresh"], i - 1)["kind"])), "").otherwise("\n"),
            F.when(~_is_list(c["kind"]), "<blockquote>\n").when((i == 0) & v["sibling"], "<li>")
            .otherwise(F.concat(F.lit("<"), _list_tag(c["kind"]), F.when(_list_tag(c["kind"]) == "ol", start(i)).otherwise(""), F.lit(">\n<li>"))))), "")
        item = (F.size(v["fresh"]) > 0) & _is_list(F.get(v["fresh"], F.size(v["fresh"]) - 1)["kind"])
        first = F.when(F.size(v["fresh"]) > 0, item).when(moved, False).otherwise(acc["first"])
        at_start = F.when(F.size(v["fresh"]) > 0, ~item).otherwise(nl)
        cr = F.when(at_start, "").otherwise("\n")
        level = F.length(F.regexp_extract(b, HEADING, 1)).cast("string")
        info = F.regexp_extract(b, FENCE, 2)
        text = (F.when(kind == "fence_end", "</code></pre>\n").when(kind == "fence_line", F.concat(_escape(b), F.lit("\n")))
                .when(kind == "under", F.concat(F.lit(END), F.when(F.trim(b).startswith("="), "1").otherwise("2")))
                .when(kind == "code_line", F.concat(F.repeat(F.lit("\n"), acc["blanks"]), _escape(F.substring(b, 5, F.length(b))), F.lit("\n")))
                .when(kind.isin("blank", "code_blank"), "").when(kind == "raw_line", F.concat(b, F.lit("\n")))
                .when(kind == "p_line", F.concat(F.lit("\n"), F.ltrim(b)))
                .when(kind == "code", F.concat(cr, F.lit("<pre><code>"), _escape(F.substring(b, 5, F.length(b))), F.lit("\n")))
                .when(kind == "rule", F.concat(cr, F.lit("<hr />\n")))
                .when(kind == "heading", F.concat(cr, F.lit("<h"), level, F.lit(">" + BEGIN), F.regexp_extract(b, HEADING, 2), F.lit(END + "t</h"), level, F.lit(">\n")))
                .when(kind == "fence", F.concat(cr, F.lit("<pre><code"), F.when(info != "", F.concat(F.lit(" class=\"language-"), _escape(info), F.lit("\""))).otherwise(""), F.lit(">")))
                .when(kind == "raw", F.concat(cr, b, F.lit("\n")))
                .otherwise(F.concat(F.when(first, "").otherwise(cr), F.lit(BEGIN), F.ltrim(b))))
        is_leaf = ~kind.isin("blank", "code_blank")
        leaf = (F.when(kind.isin("p", "p_line"), "p").when(kind.isin("fence", "fence_line"), "fence").when(kind.isin("code", "code_line", "code_blank"), "code")
                .when(kind.isin("raw", "raw_line"), "raw").otherwise(""))
        return F.struct(
            F.concat(acc["out"], ends, opens, text).alias("out"),
            F.when(kind == "blank", at_start).when(kind.isin("p", "p_line"), False).otherwise(True).alias("nl"),
            F.when(moved, F.concat(F.slice(acc["stack"], 1, x["n"]), v["fresh"])).otherwise(acc["stack"]).alias("stack"),
            leaf.alias("leaf"), F.when(kind == "fence", F.regexp_extract(b, FENCE, 1)).otherwise(acc["fence"]).alias("fence"),
            F.when(kind == "p", first).otherwise(acc["tight"]).alias("tight"), (first & ~is_leaf).alias("first"),
            F.when(kind == "code_blank", acc["blanks"] + 1).otherwise(0).alias("blanks")).cast(STATE)
    return let(F.struct(fresh.alias("fresh"), F.coalesce(sibling, F.lit(False)).alias("sibling")), build)


def _in_fence(acc: Column, line: Column) -> Column:
    """The state behind a line inside a fence, which opens and ends nothing."""
    return F.struct(F.concat(acc["out"], _escape(line), F.lit("\n")).alias("out"), F.lit(True).alias("nl"), acc["stack"].alias("stack"), acc["leaf"].alias("leaf"),
                    acc["fence"].alias("fence"), acc["tight"].alias("tight"), F.lit(False).alias("first"), F.lit(0).alias("blanks")).cast(STATE)


def _step(acc: Column, line: Column) -> Column:
    def behind(m):
        held = (acc["leaf"] == "fence") & (m["n"] == F.size(acc["stack"])) & ~F.regexp_extract(m["rest"], FENCE_END, 1).startswith(acc["fence"])
        return F.when(held, _in_fence(acc, m["rest"])).otherwise(let(_open(acc, m), lambda x: _leaf(acc, x)))
    return let(_match(acc, line), behind)


def _fold(lines: Column) -> Column:
    first = F.struct(F.lit("").alias("out"), F.lit(True).alias("nl"), F.array().cast("array<struct<kind:string,width:int>>").alias("stack"), F.lit("").alias("leaf"),
                     F.lit("").alias("fence"), F.lit(False).alias("tight"), F.lit(False).alias("first"), F.lit(0).alias("blanks")).cast(STATE)
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0)), F.lit(CHUNK)), lambda at: F.slice(lines, at + 1, CHUNK))
    return F.aggregate(chunks, F.struct(first.alias("state"), F.array().cast("array<string>").alias("parts")), lambda acc, chunk: let(
        F.aggregate(chunk, acc["state"], _step),
        lambda s: F.struct(s.withField("out", F.lit("")).cast(STATE).alias("state"), F.concat(acc["parts"], F.array(s["out"])).alias("parts"))),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), _end_leaf(acc["state"]), _end_containers(acc["state"]["stack"], F.lit(False))))


def _paragraph(t: Column) -> Column:
    """A finished paragraph, or what lies between two."""
    kind = F.substring(t, -1, 1)
    body = inline_html(F.rtrim(F.regexp_replace(t, f"(?s)^{BEGIN}(.*){END}.$", "$1")))
    return F.when(~t.startswith(BEGIN), t).otherwise(let(body, lambda h: F.when(kind == "t", h).when(kind == "p", F.concat(F.lit("<p>"), h, F.lit("</p>\n")))
                                                         .otherwise(F.concat(F.lit("<h"), kind, F.lit(">"), h, F.lit("</h"), kind, F.lit(">\n")))))


def markdown_document_to_html(markdown) -> Column:
    """HTML of a Markdown text."""
    def body(m):
        clean = F.when(m.rlike(f"[{BEGIN}-{HELD[-1]}]"), F.translate(m, BEGIN + END + HELD, "")).otherwise(m)
        lines = F.split(F.replace(F.regexp_replace(clean, r"\r\n?", "\n"), F.lit("\t"), F.lit("    ")), "\n")
        whole = let(lines, _fold)
        parts = F.regexp_extract_all(whole, F.lit(f"(?s){BEGIN}[^{END}]*+{END}.|[^{BEGIN}]++"), F.lit(0))
        return F.when(m != "", F.trim(F.array_join(F.transform(parts, lambda t: _paragraph(t)), ""), F.lit(WS_CHARS)))
    return let(as_col(markdown), body)
