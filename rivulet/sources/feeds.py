"""Feed documents, list exports and blobs as DataFrames.

Feed XML is parsed with Spark's built-in ``from_xml``: one landed document
per row, parsed in the executors, exploded to one row per item.  RSS 2.0
and Atom map onto one item shape; a document that does not parse yields a
row with a NULL item so it can be quarantined instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions._col import let
from ..functions.dates import parse_date
from ..functions.encoding import decode_document, repair_xml
from ..functions.npy import npy_to_array
from ..functions.scores import str_to_bool

RSS_SCHEMA = (
    "channel struct<title: string, link: string, language: string, description: string, "
    "lastBuildDate: string, item: array<struct<guid: string, title: string, link: string, "
    "description: string, pubDate: string, author: string, `dc:creator`: string, "
    "`content:encoded`: string, category: array<string>>>>, "
    # RSS 1.0 (RDF): items stand beside the channel
    "item array<struct<`_rdf:about`: string, title: string, link: string, description: string, "
    "`dc:date`: string, `dc:creator`: string, `dc:subject`: array<string>, `content:encoded`: string>>")
ATOM_SCHEMA = (
    "title string, subtitle string, updated string, link array<struct<_href: string, _rel: string>>, "
    "entry array<struct<id: string, title: string, summary: string, content: string, "
    "published: string, updated: string, author: struct<name: string>, "
    "link: array<struct<_href: string, _rel: string>>, category: array<struct<_term: string>>>>")
XML_OPTIONS = {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"}

ITEM_FIELDS = ["id", "title", "link", "summary", "published", "author", "tags", "content"]


def _alternate(links: Column) -> Column:
    alt = F.filter(links, lambda l: l["_rel"].isNull() | (l["_rel"] == "alternate"))
    return F.get(alt, 0)["_href"]


def _rss_shape(x: Column) -> Column:
    ch = x["channel"]
    items = F.transform(ch["item"], lambda i: F.struct(
        i["guid"].alias("id"), i["title"].alias("title"), i["link"].alias("link"),
        i["description"].alias("summary"), i["pubDate"].alias("published"),
        F.coalesce(i["author"], i["dc:creator"]).alias("author"),
        F.transform(i["category"], lambda c: F.struct(c.alias("term"))).alias("tags"),
        F.when(i["content:encoded"].isNotNull(), F.array(F.struct(i["content:encoded"].alias("value"))))
        .alias("content")))
    rdf = F.transform(x["item"], lambda i: F.struct(
        F.coalesce(i["_rdf:about"], i["link"]).alias("id"), i["title"].alias("title"), i["link"].alias("link"),
        i["description"].alias("summary"), i["dc:date"].alias("published"), i["dc:creator"].alias("author"),
        F.transform(i["dc:subject"], lambda c: F.struct(c.alias("term"))).alias("tags"),
        F.when(i["content:encoded"].isNotNull(), F.array(F.struct(i["content:encoded"].alias("value"))))
        .alias("content")))
    items = F.coalesce(items, rdf)
    return F.struct(ch["title"].alias("title"), ch["link"].alias("link"), ch["language"].alias("language"),
                    ch["lastBuildDate"].alias("updated"), ch["description"].alias("subtitle"),
                    items.alias("items"))


def _atom_shape(x: Column) -> Column:
    items = F.transform(x["entry"], lambda e: F.struct(
        e["id"].alias("id"), e["title"].alias("title"), _alternate(e["link"]).alias("link"),
        e["summary"].alias("summary"), F.coalesce(e["published"], e["updated"]).alias("published"),
        e["author"]["name"].alias("author"),
        F.transform(e["category"], lambda c: F.struct(c["_term"].alias("term"))).alias("tags"),
        F.when(e["content"].isNotNull(), F.array(F.struct(e["content"].alias("value")))).alias("content")))
    return F.struct(x["title"].alias("title"), _alternate(x["link"]).alias("link"),
                    F.lit(None).cast("string").alias("language"), x["updated"].alias("updated"),
                    x["subtitle"].alias("subtitle"), items.alias("items"))


ATOM_ROOT = r"^\s*(?:<\?xml[^>]*\?>\s*)?(?:<!--(?s:.*?)-->\s*)*(?:<!DOCTYPE[^>]*>\s*)?(?:<!--(?s:.*?)-->\s*)*<feed[\s>]"


def _parse(x: Column) -> Column:
    # each document is parsed once (the shapes read many fields of the parse)
    return (F.when(x.rlike(ATOM_ROOT), let(F.from_xml(x, ATOM_SCHEMA, XML_OPTIONS), _atom_shape))
            .otherwise(let(F.from_xml(x, RSS_SCHEMA, XML_OPTIONS), _rss_shape)))


def parse_feed_xml(docs: DataFrame, xml_col: str = "xml", repair: bool = False) -> DataFrame:
    """Parse feed documents (RSS 2.0, RSS 1.0 or Atom) into one row per item with
    the feed's fields alongside.  ``parsed`` is false for documents that did
    not parse (or had neither channel nor entries); ``item_pos`` is the item's
    place in its document.  A binary column is decoded first; with ``repair`` a
    document that does not parse is parsed again with its markup mended."""
    if docs.schema[xml_col].dataType.typeName() == "binary":
        docs = docs.withColumn(xml_col, decode_document(xml_col))
    x = F.col(xml_col)
    feed = _parse(x)
    if repair:
        feed = let(feed, lambda f: F.when(f["items"].isNotNull(), f).otherwise(let(repair_xml(x), _parse)))
    keep = [c for c in docs.columns if c != xml_col]
    parsed = docs.select(*keep, feed.alias("__f"))
    out = parsed.select(*keep,
                        F.col("__f.title").alias("feed_title"), F.col("__f.link").alias("feed_link"),
                        F.col("__f.language").alias("feed_language"),
                        F.col("__f.updated").alias("feed_updated"),
                        F.col("__f.subtitle").alias("feed_subtitle"),
                        F.col("__f.items").isNotNull().alias("parsed"),
                        F.posexplode_outer("__f.items").alias("item_pos", "__i"))
    return out.select(*keep, "feed_title", "feed_link", "feed_language", "feed_updated", "feed_subtitle",
                      "parsed", "item_pos", *[F.col(f"__i.{f}").alias(f) for f in ITEM_FIELDS],
                      F.transform("__i.tags", lambda t: t["term"]).alias("categories"))


def _xml_text(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def rss_document(documents: DataFrame) -> Column:
    """One RSS 2.0 document per row of ``documents`` (the landed-feed
    stand-in): channel = the document's source, one item = the document."""
    d = documents
    first = F.regexp_extract(d.text, "^([^\n]*)", 1)
    link = F.concat(F.lit("https://"), d.source, F.lit(".example.com/entries/"), d.doc_id.cast("string"))
    parts = [
        F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>'),
        _xml_text(d.source), F.lit("</title><link>https://"), _xml_text(d.source),
        F.lit(".example.com/feed</link><language>"), _xml_text(d.lang),
        F.lit("</language><item><guid>"), d.doc_id.cast("string"), F.lit("</guid><title>"),
        _xml_text(first), F.lit("</title><link>"), link, F.lit("</link><description>"),
        _xml_text(d.text), F.lit("</description><category>"), _xml_text(d.lang),
        F.lit("</category><category>"), _xml_text(d.source),
        F.lit("</category></item></channel></rss>"),
    ]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


# ------------------------------------------------------------ config --

def load_feed_config(spark: SparkSession, path: str, section: str | None = "RssIngestionService") -> DataFrame:
    """Feeds of a JSON config (``{section: {feeds: [...]}}`` or a
    top-level ``feeds`` list) as rows (name, url, type).  An unknown
    section or an empty list is an error, raised before any work."""
    raw = spark.read.option("multiLine", "true").json(path)
    if section is not None:
        if section not in raw.columns:
            raise KeyError(f"config section not found: {section}")
        base = raw.select(F.explode_outer(f"{section}.feeds").alias("f"))
    else:
        if "feeds" not in raw.columns:
            raise ValueError("the configuration has no top-level list of feeds")
        base = raw.select(F.explode_outer("feeds").alias("f"))
    dt = base.schema["f"].dataType
    if dt.simpleString().startswith("struct"):
        feeds = base.select("f.*").filter(F.col("url").isNotNull())
    else:
        feeds = base.select(F.lit(None).cast("string").alias("name"), F.col("f").alias("url"),
                            F.lit("rss").alias("type")).filter(F.col("url").isNotNull())
    if feeds.limit(1).count() == 0:
        raise ValueError("the configuration lists no feed")
    return feeds


# --------------------------------------------------------- list export --

LIST_EXPORT_SCHEMA = (
    "Title string, URL string, Summary string, Entry_ID string, Published_Date string, "
    "Full_Content string, Categories string, Author string, Keywords string, Sentiment string, "
    "Readability_Score double, Engagement_Score bigint, Processed string, Engagement_Type string, "
    "Response_Received string")


def read_list_export(spark: SparkSession, path: str) -> DataFrame:
    """The 15-column list export CSV, typed: categories split on
    ', ', dates parsed, flags to booleans, 'None' engagement → []."""
    raw = (spark.read.option("header", "true").option("quote", '"').option("escape", '"')
           .option("multiLine", "true").schema(LIST_EXPORT_SCHEMA).csv(path))
    et = F.col("Engagement_Type")
    return raw.select(
        "Title", "URL", "Summary", "Entry_ID",
        parse_date(F.col("Published_Date")).alias("Published_Date"),
        "Full_Content",
        F.when(F.col("Categories").isNull() | (F.col("Categories") == ""), F.array().cast("array<string>"))
        .otherwise(F.split("Categories", ", ")).alias("Categories"),
        "Author", "Keywords", "Sentiment", "Readability_Score", "Engagement_Score",
        str_to_bool(F.col("Processed")).alias("Processed"),
        F.when(et.isNull() | (et == "None"), F.array().cast("array<string>"))
        .otherwise(F.transform(F.split(et, r",\s*"), lambda x: F.when(x == "Commented", F.lit("Comment")).otherwise(x)))
        .alias("Engagement_Type"),
        (F.col("Response_Received") == "Engaged").alias("Response_Received"),
    )


# ---------------------------------------------------------------- blobs --

# Content types that are text besides text/*.
TEXT_TYPES = ["application/json", "application/xml", "application/xhtml+xml", "application/x-yaml"]
# File extension → content type (fixed lookup for landed blobs).
CONTENT_TYPES = {
    "md": "text/markdown", "txt": "text/plain", "csv": "text/csv", "html": "text/html", "xhtml": "application/xhtml+xml",
    "json": "application/json", "xml": "application/xml", "js": "application/javascript",
    "yaml": "application/x-yaml", "yml": "application/x-yaml", "npy": "application/octet-stream",
}


def read_blobs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Landed blobs with type dispatch — text types decoded as UTF-8
    into ``text``, others kept as ``content`` bytes."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    ctype = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv]), ext),
                       F.lit("application/octet-stream"))
    df = df.withColumn("content_type", ctype)
    is_text = F.col("content_type").startswith("text/") | F.col("content_type").isin(TEXT_TYPES)
    return df.select("path", "length", "content_type",
                     F.when(is_text, F.decode("content", "UTF-8")).alias("text"),
                     F.when(~is_text, F.col("content")).alias("content"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Landed ``.npy`` blobs as (row_key, embedding ``array<float>``); the key is the file's
    name, a blob that is no array of real numbers has a NULL embedding."""
    blobs = read_blobs(spark, path, "*.npy")
    return blobs.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("row_key"), npy_to_array("content").cast("array<float>").alias("embedding"))
