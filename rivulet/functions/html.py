"""HTML → Markdown and Markdown → HTML as ordered regex rules (F10a–F10d).

The rules cover a documented tag subset (headings, links, images, emphasis,
lists, line and block breaks, entity decoding).  Nested same-tag markup is
the known limit.  The same rule lists render to a Spark Column (Java regex)
and to a DuckDB SQL expression (RE2), so both engines run one definition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ._col import as_col, let
from ._regex import apply_rules, sql_apply_rules, sql_str, sql_strip_ws, strip_ws
from .text import truncate_markdown

# Tags html/body do not count as structure when deciding whether to wrap.
_HTML_BODY_TAGS = r"(?i)</?(html|body)\b[^>]*>"
_ANY_OPEN_TAG = r"<[A-Za-z]"

# Ordered (pattern, replacement) pairs; {1} is group 1.
HTML_TO_MARKDOWN_RULES = [
    # drop comments and content-free blocks
    (r"(?is)<!--.*?-->|<head\b[^>]*>.*?</head\s*>|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
     r"|<noscript\b[^>]*>.*?</noscript\s*>|<title\b[^>]*>.*?</title\s*>", ""),
    # attributes of links and images in double quotes (an image has two)
    (r"(?is)(<(?:a|img)\b[^>]*?\b(?:href|src|alt))\s*=\s*'([^'\">]*)'", "{1}=\"{2}\""),
    (r"(?is)(<img\b[^>]*?\b(?:src|alt))\s*=\s*'([^'\">]*)'", "{1}=\"{2}\""),
    (r"(?is)(<(?:a|img)\b[^>]*?\b(?:href|src|alt))\s*=\s*([^\s\"'>]+)", "{1}=\"{2}\""),
    (r"(?is)(<img\b[^>]*?\b(?:src|alt))\s*=\s*([^\s\"'>]+)", "{1}=\"{2}\""),
    # headings
    (r"(?i)<h1\b[^>]*>", "\n\n# "),
    (r"(?i)<h2\b[^>]*>", "\n\n## "),
    (r"(?i)<h3\b[^>]*>", "\n\n### "),
    (r"(?i)<h4\b[^>]*>", "\n\n#### "),
    (r"(?i)<h5\b[^>]*>", "\n\n##### "),
    (r"(?i)<h6\b[^>]*>", "\n\n###### "),
    (r"(?i)</h[1-6]\s*>", "\n\n"),
    # images: alt before src, src before alt, no alt
    (r"(?is)<img\b[^>]*?\balt=\"([^\"]*)\"[^>]*?\bsrc=\"([^\"]*)\"[^>]*>", "![{1}]({2})"),
    (r"(?is)<img\b[^>]*?\bsrc=\"([^\"]*)\"[^>]*?\balt=\"([^\"]*)\"[^>]*>", "![{2}]({1})"),
    (r"(?is)<img\b[^>]*?\bsrc=\"([^\"]*)\"[^>]*>", "![]({1})"),
    # links: internal (#...) links become their text, others [text](href)
    (r"(?is)<a\b[^>]*?\bhref=\"#[^\"]*\"[^>]*>(.*?)</a\s*>", "{1}"),
    (r"(?is)<a\b[^>]*?\bhref=\"([^\"]*)\"[^>]*>(.*?)</a\s*>", "[{2}]({1})"),
    # emphasis
    (r"(?i)</?(b|strong)\b[^>]*>", "**"),
    (r"(?i)</?(i|em)\b[^>]*>", "_"),
    # list items and breaks
    (r"(?i)<li\b[^>]*>", "\n  * "),
    (r"(?i)</li\s*>", ""),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</?(p|div|article|section|nav|footer|header|main|aside|ul|ol|table|tr|blockquote)\b[^>]*>",
     "\n\n"),
    # everything else that looks like a tag (doctype, meta, span, ...)
    (r"<[^>]*>", ""),
    # whitespace clean-up
    (r"[ \t]+\n", "\n"),
    (r"\n[ \t]+\n", "\n\n"),
    (r"\n{3,}", "\n\n"),
]

# Entities, decoded with plain string replacement in this order; &amp; and
# its numeric forms last so '&amp;lt;' stays '&lt;'.  Common typographic
# entities are included, named and numeric (HTML spec values).
ENTITY_RULES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", "\""), ("&#39;", "'"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&middot;", "·"),
    ("&rsquo;", "\u2019"), ("&#8217;", "\u2019"), ("&#x2019;", "\u2019"),
    ("&lsquo;", "\u2018"), ("&#8216;", "\u2018"), ("&#x2018;", "\u2018"),
    ("&rdquo;", "\u201d"), ("&#8221;", "\u201d"), ("&#x201d;", "\u201d"), ("&#x201D;", "\u201d"),
    ("&ldquo;", "\u201c"), ("&#8220;", "\u201c"), ("&#x201c;", "\u201c"), ("&#x201C;", "\u201c"),
    ("&ndash;", "\u2013"), ("&#8211;", "\u2013"), ("&#x2013;", "\u2013"),
    ("&mdash;", "\u2014"), ("&#8212;", "\u2014"), ("&#x2014;", "\u2014"),
    ("&hellip;", "\u2026"), ("&#8230;", "\u2026"), ("&#x2026;", "\u2026"),
    ("&#160;", " "), ("&#xa0;", " "), ("&#xA0;", " "),
    ("&#34;", "\""), ("&#x22;", "\""),
    ("&#60;", "<"), ("&#x3c;", "<"), ("&#x3C;", "<"),
    ("&#62;", ">"), ("&#x3e;", ">"), ("&#x3E;", ">"),
    ("&apos;", "'"), ("&#x27;", "'"),
    ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"),
]

MARKDOWN_TO_HTML_RULES = [
    # a bare ampersand is escaped, an entity stays
    (r"&", "&amp;"),
    (r"&amp;(#?[A-Za-z0-9]+;)", "&{1}"),
    (r"(?m)^###### (.*)$", "<h6>{1}</h6>"),
    (r"(?m)^##### (.*)$", "<h5>{1}</h5>"),
    (r"(?m)^#### (.*)$", "<h4>{1}</h4>"),
    (r"(?m)^### (.*)$", "<h3>{1}</h3>"),
    (r"(?m)^## (.*)$", "<h2>{1}</h2>"),
    (r"(?m)^# (.*)$", "<h1>{1}</h1>"),
    # emphasis before links, never inside a word or an address; twice, as neighbours share their space
    (r"\*\*([^*\n]+)\*\*", "<strong>{1}</strong>"),
    (r"(?m)(^|[\s(\[>])_([^_\n]+)_($|[\s)\].,;:!?<])", "{1}<em>{2}</em>{3}"),
    (r"(?m)(^|[\s(\[>])_([^_\n]+)_($|[\s)\].,;:!?<])", "{1}<em>{2}</em>{3}"),
    (r"`([^`\n]+)`", "<code>{1}</code>"),
    (r"!\[([^\]]*)\]\(([^)]*)\)", "<img alt=\"{1}\" src=\"{2}\" />"),
    (r"\[([^\]]*)\]\(([^)]*)\)", "<a href=\"{2}\">{1}</a>"),
    (r"(?m)^[ \t]*[*+-] (.*)$", "<li>{1}</li>"),
    (r"</li>\z", "</li>\n"),
    (r"((?:<li>.*</li>\n)+)", "<ul>\n{1}</ul>\n"),
    (r"(?m)^[ \t]*[0-9]{1,9}[.)] (.*)$", "<oli>{1}</oli>"),
    (r"</oli>\z", "</oli>\n"),
    (r"((?:<oli>.*</oli>\n)+)", "<ol>\n{1}</ol>\n"),
    (r"<(/?)oli>", "<{1}li>"),
    (r"(?m)^> ?(.*)$", "<blockquote>{1}</blockquote>"),
    (r"</blockquote>\n<blockquote>", "<br />"),
    # a line that starts with text or inline markup is a paragraph
    (r"(?m)^([^<\n][^\n]*|<(?:strong|em|a|img|code)\b[^\n]*)$", "<p>{1}</p>"),
    (r"\n{2,}", "\n"),
]


def normalize_html(html) -> Column:
    """Empty → ''; text without any tag besides html/body is wrapped in <p>."""
    def body(h):
        has_tag = F.regexp_replace(h, _HTML_BODY_TAGS, "").rlike(_ANY_OPEN_TAG)
        wrapped = F.concat(F.lit("<p>"), strip_ws(h), F.lit("</p>"))
        return F.when(h.isNull() | (h == ""), F.lit("")).when(has_tag, h).otherwise(wrapped)
    return let(as_col(html), body)


def sql_normalize_html(expr: str) -> str:
    has_tag = (f"regexp_matches(regexp_replace({expr}, {sql_str(_HTML_BODY_TAGS)}, '', 'g'), "
               f"{sql_str(_ANY_OPEN_TAG)})")
    return (f"(CASE WHEN {expr} IS NULL OR {expr} = '' THEN '' WHEN {has_tag} THEN {expr} "
            f"ELSE '<p>' || {sql_strip_ws(expr)} || '</p>' END)")


def html_to_markdown(html) -> Column:
    """Convert HTML to Markdown with the rule list; NULL/empty → ''."""
    # the chain maps '' to '' and NULL to NULL: one reference to the input
    md = apply_rules(decode_entities(apply_rules(as_col(html), _TAG_RULES)), _WS_RULES)
    return F.coalesce(strip_ws(md), F.lit(""))


def sql_html_to_markdown(expr: str) -> str:
    md = sql_strip_ws(sql_apply_rules(sql_decode_entities(sql_apply_rules(expr, _TAG_RULES)), _WS_RULES))
    return f"(CASE WHEN {expr} IS NULL OR {expr} = '' THEN '' ELSE {md} END)"


# the trailing whitespace rules of HTML_TO_MARKDOWN_RULES
_WS_RULES = HTML_TO_MARKDOWN_RULES[-3:]
_TAG_RULES = HTML_TO_MARKDOWN_RULES[:-3]


def decode_entities(text) -> Column:
    """Entity decoding with literal replaces, skipped when there is no '&'."""
    def body(t):
        out = t
        for a, b in ENTITY_RULES:
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.when(t.contains("&"), out).otherwise(t)
    return let(as_col(text), body)


def sql_decode_entities(expr: str) -> str:
    for a, b in ENTITY_RULES:
        expr = f"replace({expr}, {sql_str(a)}, {sql_str(b)})"
    return expr


def text_or_html_to_markdown(value) -> Column:
    """F10a then F10b.  Text with neither ``<`` nor ``&`` is wrapped in one
    paragraph and no other rule can match it, so it takes a short path
    (whitespace rules only); anything else runs the whole rule list."""
    def body(v):
        plain = ~v.contains("<") & ~v.contains("&")
        short = F.coalesce(strip_ws(apply_rules(strip_ws(v), _WS_RULES)), F.lit(""))
        return F.when(plain, short).otherwise(html_to_markdown(normalize_html(v)))
    return let(as_col(value), body)


def clean_summary(summary,
                  max_sentences: int = fixed.MAX_SUMMARY_SENTENCES,
                  max_chars: int = fixed.MAX_SUMMARY_CHARACTERS) -> Column:
    """Summary cleaning: normalise → Markdown → truncate; empty input → NULL."""
    s = as_col(summary)
    md = text_or_html_to_markdown(s)
    return F.when(s.isNull() | (s == ""), F.lit(None).cast("string")) \
            .otherwise(truncate_markdown(md, max_sentences, max_chars))


def markdown_to_html(markdown) -> Column:
    """Markdown → HTML for post content (headings, emphasis, links, images,
    bullet lists, paragraphs).  NULL/empty → NULL."""
    return let(as_col(markdown), lambda m: F.when(m.isNull() | (m == ""), F.lit(None).cast("string"))
               .otherwise(strip_ws(apply_rules(m, MARKDOWN_TO_HTML_RULES))))


def page_title(html) -> Column:
    """Text of the first <title> element, or NULL."""
    t = F.regexp_extract(as_col(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return F.when(t != "", t)
