"""From the bytes of a feed document to text that parses (S3).

``decode_document`` finds the encoding: byte-order mark, else the pattern of a first
``<`` in two bytes, else the declared encoding, else UTF-8 if the bytes are well formed,
else Windows-1252 (also where a declared UTF-8 is not).  Single-byte encodings are the
bytes as Latin-1 with their upper half translated, by tables made from the codecs' own
definitions.  ``repair_xml`` makes broken markup well formed: control characters go, a
stray ``&`` or ``<`` is text, names of typographic entities become characters, bare
attribute values are quoted, and a fold with a stack of open elements closes what was
left open or cut off.  Both are native expressions.

Defined cases: NULL and UTF-16 with a half character give NULL; an odd last byte of
UTF-16 goes; no bytes give ''; an unknown declared encoding counts as none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import as_col, let
from .html import ENTITY_RULES

SINGLE_BYTE = (["iso-8859-%d" % n for n in (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16)] + ["windows-%d" % n for n in range(1250, 1259)] + ["koi8-r", "koi8-u"])
# names that mean Windows-1252 in the web's use of them
WESTERN = ("iso-8859-1", "latin1", "latin-1", "us-ascii", "ascii", "windows-1252", "cp1252")
UPPER = bytes(range(0x80, 0x100)).decode("latin-1")
DECLARED = r"^\s*<\?xml[^>]{0,200}?\sencoding\s*=\s*[\"']([A-Za-z0-9._-]+)[\"']"

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
TOKEN = (r"(?s)<!\[CDATA\[.*?(?:\]\]>|\z)|<!--.*?(?:-->|\z)|<\?.*?(?:\?>|\z)|<![A-Za-z][^>]*>|</?[A-Za-z_](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<]++|<")
NAME = r"^</?([A-Za-z_][\w.-]*(?::[A-Za-z_][\w.-]*)?)"
ATTRIBUTE = r"\s([A-Za-z_:][\w:.-]*)\s*=\s*(\"[^\"<]*\"|'[^'<]*'|[^\s\"'<>/]+)"
STRAY = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});)"
OF_XML = ("&lt;", "&gt;", "&quot;", "&amp;", "&apos;")
ALONE = ("item", "entry")        # never within one of their own
CHUNK = 64


def _single(latin: Column, codec: str) -> Column:
    return F.translate(latin, UPPER, bytes(range(0x80, 0x100)).decode(codec, "replace"))


def _western(latin: Column) -> Column:
    # the five bytes without a character stay what they are
    return F.translate(latin, UPPER, "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0x100)))


def _utf16(digits: Column, little: bool) -> Column:
    """Text of UTF-16 digits without their mark; NULL if half a character stands alone."""
    half = F.lit(3 if little else 1)
    sign = lambda u: F.substring(u, half, F.lit(2))
    high, low = (lambda u: sign(u).between("D8", "DB")), (lambda u: sign(u).between("DC", "DF"))

    def build(units):
        alone = F.exists(F.transform(units, lambda u, i: (high(u) & ~F.coalesce(low(F.get(units, i + 1)), F.lit(False)))
                                     | (low(u) & ~F.coalesce(high(F.get(units, i - 1)), F.lit(False)))), lambda b: b)
        return F.when(~alone, F.decode(F.unhex(F.array_join(units, "")), "UTF-16LE" if little else "UTF-16BE"))
    return let(F.regexp_extract_all(digits, F.lit("(.{4})"), F.lit(1)), build)


def decode_document(data) -> Column:
    """The text of a binary document."""
    def by_name(latin):
        def pick(x):
            out = F.when(x["name"].isin(*WESTERN), _western(x["latin"]))
            for codec in SINGLE_BYTE:
                if codec not in WESTERN:
                    out = out.when(x["name"].isin(codec, codec.replace("windows-", "cp")), _single(x["latin"], codec))
            return out.when(F.is_valid_utf8(x["utf8"]), x["utf8"]).otherwise(_western(x["latin"]))
        utf8 = as_col(data).cast("string")
        return let(F.struct(F.lower(F.regexp_extract(F.substring(latin, 1, 400), DECLARED, 1)).alias("name"), latin.alias("latin"), utf8.alias("utf8")), pick)

    def by_mark(head):
        digits = F.hex(as_col(data))
        after = lambda n: F.substring(digits, n + 1, F.length(digits))
        return (F.when(head.startswith("FFFE"), _utf16(after(4), True)).when(head.startswith("FEFF"), _utf16(after(4), False))
                .when(head.startswith("3C00"), _utf16(digits, True)).when(head.startswith("003C"), _utf16(digits, False))
                .otherwise(F.regexp_replace(let(F.decode(as_col(data), "ISO-8859-1"), by_name), r"^\x{FEFF}", "")))
    return F.when(as_col(data).isNotNull(), let(F.hex(F.substring(as_col(data), 1, 4)), by_mark))


def _text(t: Column) -> Column:
    for entity, char in ENTITY_RULES:
        if entity not in OF_XML and not entity.startswith("&#"):
            t = F.replace(t, F.lit(entity), F.lit(char))
    return F.replace(F.replace(F.regexp_replace(t, STRAY, "&amp;"), F.lit("<"), F.lit("&lt;")), F.lit("]]>"), F.lit("]]&gt;"))


def _open_tag(t: Column, name: Column) -> Column:
    """The tag with what is an attribute of it, each once, in quotes."""
    def build(x):
        parts = F.transform(x["names"], lambda n, i: F.when(F.array_position(x["names"], n) == i + 1, F.concat(F.lit(" "), n, F.lit("="), F.when(
            F.get(x["values"], i).rlike("^[\"']"), F.get(x["values"], i)).otherwise(F.concat(F.lit("\""), F.get(x["values"], i), F.lit("\""))))).otherwise(""))
        return F.regexp_replace(F.array_join(parts, ""), STRAY, "&amp;")
    found = F.struct(F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(1)).alias("names"), F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(2)).alias("values"))
    return F.concat(F.lit("<"), name, let(found, build), F.when(t.endswith("/>"), "/>").otherwise(">"))


def _closing(names: Column) -> Column:
    return F.array_join(F.transform(F.reverse(names), lambda n: F.concat(F.lit("</"), n, F.lit(">"))), "")


def _step(acc: Column, t: Column) -> Column:
    def build(x):
        name, stack = x["name"], acc["stack"]
        at = F.size(stack) - F.coalesce(F.array_position(F.reverse(stack), name), F.lit(0)).cast("int") + 1      # the innermost of that name
        known = F.array_contains(stack, name)
        closes, opens = x["close"] & (name != ""), ~x["close"] & (name != "")
        again = opens & name.isin(*ALONE) & known
        upto = F.when((closes & known) | again, at - 1).otherwise(F.size(stack))
        ended = _closing(F.slice(stack, upto + 1, F.greatest(F.size(stack) - upto, F.lit(0))))
        kept = F.slice(stack, 1, upto)
        out = (F.when(t.startswith("<![CDATA["), F.when(t.endswith("]]>"), t).otherwise(F.concat(t, F.lit("]]>"))))
               .when(t.startswith("<!") | t.startswith("<?"), "").when(closes, ended).when(opens, F.concat(ended, _open_tag(t, name))).otherwise(_text(t)))
        return F.struct(F.concat(acc["out"], out).alias("out"),
                        F.when(opens & ~t.endswith("/>"), F.concat(kept, F.array(name))).otherwise(kept).alias("stack"))
    tag = t.rlike(r"(?s)^</?[A-Za-z_].*>$")
    return let(F.struct(F.when(tag, F.regexp_extract(t, NAME, 1)).otherwise("").alias("name"), t.startswith("</").alias("close")), build)


def repair_xml(text) -> Column:
    """Well-formed markup that says what the text says; comments and declarations go."""
    none = F.array().cast("array<string>")

    def fold(tokens):
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(CHUNK)), lambda at: F.slice(tokens, at + 1, CHUNK))
        return F.aggregate(chunks, F.struct(none.alias("stack"), none.alias("parts")), lambda acc, chunk: let(
            F.aggregate(chunk, F.struct(F.lit("").alias("out"), acc["stack"].alias("stack")), _step),
            lambda s: F.struct(s["stack"].alias("stack"), F.concat(acc["parts"], F.array(s["out"])).alias("parts"))),
            lambda acc: F.concat(F.array_join(acc["parts"], ""), _closing(acc["stack"])))
    clean = F.regexp_replace(F.regexp_replace(as_col(text), CONTROL, ""), r"^\x{FEFF}?\s+", "")
    return let(F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(0)), fold)
