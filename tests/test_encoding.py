"""Feed documents that are not clean UTF-8 XML: encodings against Python's codecs, broken markup."""

import random
import xml.etree.ElementTree as ET

import pytest

from conftest import one
from rivulet.functions.encoding import SINGLE_BYTE, decode_document, repair_xml
from rivulet.sources.feeds import parse_feed_xml

FEED = ("<rss version=\"2.0\"><channel><title>{t}</title><link>http://h/</link><item><guid>1</guid><title>{t} 1</title></item>"
        "<item><guid>2</guid><title>b</title></item></channel></rss>")


def decoded(spark, *data):
    return one(spark, decode_document("b"), *[(None if b is None else bytearray(b),) for b in data], schema="b binary")


def test_marks_declarations_and_neither(spark):
    t = "<?xml version=\"1.0\" encoding='X'?><a>naïve – 中😀</a>"
    for name, data in {"utf-8": t.encode(), "utf-8-sig": t.encode("utf-8-sig"), "le": b"\xff\xfe" + t.encode("utf-16-le"), "be": b"\xfe\xff" + t.encode("utf-16-be"),
                       "le without mark": t.encode("utf-16-le"), "be without mark": t.encode("utf-16-be"), "odd": b"\xff\xfe" + t.encode("utf-16-le") + b"\0"}.items():
        assert decoded(spark, data) == [t], name
    western = "<a>café – “x” €</a>"
    declared = "<?xml version=\"1.0\" encoding=\"%s\"?>" + western
    cases = [western.encode("cp1252"), (declared % "UTF-8").encode("cp1252"), (declared % "iso-8859-1").encode("cp1252"), (declared % "no-such").encode()]
    assert decoded(spark, *cases) == [western, declared % "UTF-8", declared % "iso-8859-1", declared % "no-such"]
    assert decoded(spark, None, b"", b"\xff\xfe\x00\xd8a\x00") == [None, "", None]


def test_every_single_byte_encoding(spark):
    texts = []
    for codec in SINGLE_BYTE:
        body = "".join(c for c in bytes(range(0xA0, 0x100)).decode(codec, "ignore"))
        texts.append((codec, f"<?xml version=\"1.0\" encoding=\"{codec}\"?><a>{body}</a>"))
    assert decoded(spark, *[t.encode(c) for c, t in texts]) == [t for _, t in texts]


@pytest.mark.parametrize("broken", [
    FEED.replace("{t}", "AT&T &nbsp;&copy; x < y"), FEED.replace("{t}", "x\x0b\x00y"), FEED.replace("</item><item>", "<item>"), FEED[:-20], FEED.replace("</title></item>", "</item>"),
    FEED.replace("version=\"2.0\"", "version=2.0"), "\n\n" + FEED.replace("</channel>", "</b></channel>"), FEED.replace("<item>", "<!-- a -- b --><item>"),
    FEED.replace("<title>b", "<title><![CDATA[b & <c>]]>"), FEED.replace("<title>b", "<title><br>b"), FEED + "</rss>"])
def test_broken_feeds_give_their_items(spark, broken):
    df = spark.createDataFrame([(1, bytearray(broken.replace("{t}", "T").encode()))], "doc int, data binary")
    rows = parse_feed_xml(df, "data", repair=True).orderBy("item_pos").collect()
    assert [r["id"] for r in rows] == ["1", "2"] and all(r["parsed"] for r in rows)
    assert "AT&T" not in broken or rows[0]["title"] == "AT&T  © x < y 1"


def test_random_damage_leaves_well_formed_markup(spark):
    rnd = random.Random(6)
    texts = []
    for _ in range(300):
        t = FEED.replace("{t}", "a &amp; b")
        for _ in range(rnd.randint(1, 6)):
            i = rnd.randrange(5, len(t))
            t = t[:i] + rnd.choice(["<", "&", "</x>", "<y>", "", "\x01", "<z a=b>", "\"", "<![CDATA[", "&lt"]) + t[i + rnd.randint(0, 4):]
        texts.append(t)
    for t, r in zip(texts, one(spark, repair_xml("x"), *[(t,) for t in texts])):
        try:
            ET.fromstring(f"<all>{r}</all>")
        except ET.ParseError as e:
            pytest.fail(f"{t!r} -> {r!r}: {e}")


def test_sound_feeds_are_not_touched(spark):
    df = spark.createDataFrame([(1, FEED.replace("{t}", "T")), (2, ""), (3, None), (4, "no feed")], "doc int, xml string")
    plain, mended = ({(r["doc"], r["id"], r["parsed"]) for r in parse_feed_xml(df, "xml", repair=x).collect()} for x in (False, True))
    assert plain == mended
