"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
over the whole landed tables.  Column names equal those of the matching
SQL in :mod:`rivulet.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from .. import functions as RF
from ..operators import boundaries, enrich, polarity
from ..operators import summary as summaries
from ..session import apply_core_conf
from ..sources.tables import load

# The lexicon of U3b and three words of abuse, from which the others are to follow.
POLARITY_SEEDS = (enrich.POSITIVE_WORDS, [*enrich.NEGATIVE_WORDS, "idiot", "stupid", "trash"])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_core_conf(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@query
def readability_by_source(spark, sf_dir):
    """Per source: entries, mean readability (F25), mean length."""
    d = load(spark, sf_dir, "documents")
    per_doc = d.select("source", RF.readability_cents("text").alias("rc"), "n_chars")
    return (per_doc.groupBy("source")
            .agg(F.count(F.lit(1)).alias("n_entries"),
                 F.sum("rc").alias("rc_sum"),
                 F.sum("n_chars").alias("chars_sum"))
            .select("source", "n_entries",
                    (F.col("rc_sum") / F.col("n_entries") / 100).alias("mean_readability"),
                    (F.col("chars_sum") / F.col("n_entries")).alias("mean_chars")))


@query
def readability(spark, sf_dir):
    """F10e + F25 per document."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id",
                    RF.word_count("text").alias("n_words"),
                    RF.text.sentence_mark_count("text").alias("n_marks"),
                    RF.text.nonspace_char_count("text").alias("n_nonspace"),
                    RF.readability("text").alias("readability"))


@query
def partition_key(spark, sf_dir):
    """F4 over page titles and document first lines."""
    p = load(spark, sf_dir, "pages")
    d = load(spark, sf_dir, "documents")
    a = p.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"),
                 RF.page_title("html").alias("title"))
    b = d.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"),
                 RF.first_line("text").alias("title"))
    return a.unionByName(b).select("kind", "id", "title",
                                   RF.partition_key_from_title("title").alias("partition_key"))


@query
def format_summary(spark, sf_dir):
    """F8 over whole document texts."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", RF.format_summary("text").alias("summary"))


@query
def truncate_markdown(spark, sf_dir):
    """F5 + F6 (20 sentences, 2000 characters) over whole document texts."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id",
                    _size(RF.sentences("text")).alias("n_sentences"),
                    RF.truncate_markdown("text", fixed.MAX_SUMMARY_SENTENCES,
                                         fixed.MAX_SUMMARY_CHARACTERS).alias("truncated"))


@query
def truncate_by_sentences(spark, sf_dir):
    """F7 (at most 20 sentences within 2000 characters) over documents."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", RF.truncate_by_sentences("text", fixed.MAX_SUMMARY_SENTENCES,
                                                       fixed.MAX_SUMMARY_CHARACTERS).alias("truncated"))


@query
def sentence_boundaries(spark, sf_dir):
    """F5 by corpus statistics: sentences of each document and the tokens that end them."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = boundaries.keyed_texts(d)
    ends = boundaries.boundaries(keyed, boundaries.learn_boundaries(keyed))
    n = F.when(F.col("text").isNotNull(), _size(boundaries.split_at("text", "ends")))
    return boundaries.of_texts(d, keyed, ends).select(
        "doc_id", F.coalesce(n, F.lit(0).cast("long")).alias("n_sentences"), F.coalesce(F.array_join("ends", "|"), F.lit("")).alias("ends"))


@query
def truncate_by_boundaries(spark, sf_dir):
    """F6 and F7 over the sentences of the corpus statistics."""
    d = boundaries.with_sentences(load(spark, sf_dir, "documents").select("doc_id", "text"))
    n, m = fixed.MAX_SUMMARY_SENTENCES, fixed.MAX_SUMMARY_CHARACTERS
    return d.select("doc_id", RF.truncate_markdown("text", n, m, F.col("sentences")).alias("truncated"),
                    RF.truncate_by_sentences("text", n, m, F.col("sentences")).alias("by_sentences"))


@query
def extractive_summary(spark, sf_dir):
    """U3a + U3d: each document's most central sentences, within the limits, and their score."""
    return summaries.extractive_summary(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "summary", "score")


@query
def html_to_markdown(spark, sf_dir):
    """F10a + F10b over whole pages."""
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", RF.html_to_markdown(RF.normalize_html("html")).alias("markdown"))


@query
def page_markdown(spark, sf_dir):
    """F10b over whole pages by the fold with a stack of open elements."""
    return load(spark, sf_dir, "pages").select("page_id", RF.page_to_markdown("html").alias("markdown"))


@query
def post_html(spark, sf_dir):
    """F10d by the fold with a container stack: a report on each document (quote, lines as
    nested lists, the whole text fenced inside an item) rendered as HTML."""
    d = load(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda s: F.trim(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")))
    items = F.transform(F.filter(words, lambda s: s != ""), lambda s, i: F.concat(F.repeat(F.lit("  "), F.pmod(i, F.lit(3))), F.lit("- "), s))
    fence = "~" * 20
    md = F.concat(F.lit("# Document "), d.doc_id.cast("string"), F.lit("\n\n> from **"), F.coalesce(d.source, F.lit("nowhere")), F.lit("**\n> in `"),
                  F.coalesce(d.lang, F.lit("none")), F.lit("`\n\n"), F.array_join(items, "\n"), F.lit("\n\n1. [source](http://h.example/"),
                  d.doc_id.cast("string"), F.lit(f")\n2. text\n\n   {fence}\n   "),
                  F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("\n"), F.lit("\n   ")), F.lit(f"\n   {fence}\n"))
    return d.select("doc_id", RF.markdown_document_to_html(md).alias("html_out"))


# ------------------------------------------------------------ helpers --

def _size(c):
    """Array length, NULL for a NULL array whatever the session's ANSI mode."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.size(c)).cast("long")


def _expand(df, keep, struct_col, fields):
    """Select a struct once, then its fields: reading several fields of one
    expression in the same select would copy the expression per field."""
    return df.select(*keep, struct_col.alias("__s")).select(
        *keep, *[F.col(f"__s.{f}").alias(a) for f, a in fields])


def _joined(c):
    """Arrays are reported as '|'-joined text so both engines print them alike."""
    return F.array_join(c, "|")


def _items(spark, sf_dir):
    from ..sources.tables import feed_items_from_documents
    return feed_items_from_documents(load(spark, sf_dir, "documents"))


def _feeds(spark, sf_dir):
    from ..operators.entities import build_feeds
    from ..sources.tables import feeds_from_documents
    return build_feeds(feeds_from_documents(load(spark, sf_dir, "documents")))


def _entries(spark, sf_dir):
    """Typed entries of all documents; each item carries its feed's keys,
    derived from its own feed columns (no join with the feed table)."""
    from ..operators.entities import build_entries, with_feed_keys
    return build_entries(with_feed_keys(_items(spark, sf_dir)))


RUN_START = "2024-02-01 06:00:00"   # the run's start time, passed in as a parameter
SPLIT_AT = "2024-01-16 00:00:00"    # earlier events form the stored snapshot


# ---------------------------------------------------------- functions --

@query
def summary_clean(spark, sf_dir):
    """HTML normalised → Markdown → 20 sentences / 2000 characters."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", RF.clean_summary("text").alias("summary"))


@query
def str_to_bool(spark, sf_dir):
    """F9 over label flags (valid words) and event types (invalid → NULL)."""
    lab = load(spark, sf_dir, "labels")
    ev = load(spark, sf_dir, "events")
    a = lab.select(F.lit("quality").alias("kind"), F.col("doc_id").alias("id"),
                   F.col("quality").cast("string").alias("raw"))
    b = lab.select(F.lit("toxic").alias("kind"), F.col("doc_id").alias("id"),
                   F.col("toxic").cast("string").alias("raw"))
    c = ev.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"),
                  F.col("event_type").alias("raw"))
    return a.unionByName(b).unionByName(c).withColumn("value", RF.str_to_bool("raw"))


@query
def parse_date(spark, sf_dir):
    """F11 over event times printed as RFC 822 (with weekday), ISO 8601
    with fraction and zone, and slashed dates."""
    ev = load(spark, sf_dir, "events")
    rfc = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss Z")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    slash = F.date_format("ts", "yyyy/MM/dd HH:mm:ss")
    return ev.select("event_id", RF.parse_date(rfc).alias("from_rfc"),
                     RF.parse_date(iso).alias("from_iso"), RF.parse_date(slash).alias("from_slash"),
                     RF.parse_date(F.lit("not a date")).alias("bad"))


@query
def month_key(spark, sf_dir):
    """F13 partition key per event."""
    ev = load(spark, sf_dir, "events")
    return ev.select("event_id", RF.month_key("ts").alias("month_key"))


@query
def timestamp_formats(spark, sf_dir):
    """F14 (RFC 1123 watermark text) and F15 (ISO envelope time)."""
    ev = load(spark, sf_dir, "events")
    from ..functions.dates import iso_utc, rfc1123
    return ev.select("event_id", rfc1123("ts").alias("rfc1123"), iso_utc("ts").alias("iso"))


@query
def url_normalise(spark, sf_dir):
    """F1 over page URLs and feed URLs written with upper case and ports."""
    p = load(spark, sf_dir, "pages")
    d = load(spark, sf_dir, "documents")
    a = p.select(F.col("page_id").alias("id"), F.col("url").alias("raw"))
    b = d.select(F.col("doc_id").alias("id"),
                 F.concat(F.lit("HTTPS://"), F.upper("source"), F.lit(".Example.COM:443")).alias("raw"))
    return a.unionByName(b).select("id", "raw", RF.normalize_url("raw").alias("url"))


@query
def url_resolve(spark, sf_dir):
    """F1 + P10: every link of every page, as it stands and in five relative forms, resolved
    against the page's address."""
    p = load(spark, sf_dir, "pages")
    links = p.select("page_id", "url", F.posexplode_outer(F.regexp_extract_all("html", F.lit('href="(/[^"/?#.]+)"'), F.lit(1))).alias("pos", "h")).where("h is not null")
    forms = [F.col("h"), F.concat(F.lit("."), "h"), F.concat(F.lit("a/../.."), "h"), F.concat(F.lit("a/./b/../.."), "h"),
             F.concat(F.lit("//cdn.example.org/x/.."), "h"), F.lit("?q=1")]
    rows = links.select("page_id", "url", "pos", F.posexplode(F.array(*forms)).alias("form", "ref"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("form").cast("long").alias("form"), RF.resolve_url("url", "ref").alias("resolved"))


@query
def conform_13(spark, sf_dir):
    """13-column frame over all items (Entry_ID is a hash: keyed only)."""
    from ..operators.conform import conform_frame13
    f = conform_frame13(_items(spark, sf_dir))
    return f.select("Title", "URL", "Summary", "Published_Date", "Full_Content",
                    _joined("Categories").alias("Categories"), "Author",
                    _size("Embeddings").alias("n_embeddings"), "Sentiment",
                    "Sentiment_Score", "Readability_FK", "Readability_DC",
                    F.length("Entry_ID").cast("long").alias("entry_id_len"))


@query
def conform_15(spark, sf_dir):
    """15-column list frame over all items."""
    from ..operators.conform import conform_list15
    f = conform_list15(_items(spark, sf_dir))
    return f.select(*[(_joined(c).alias(c) if c in ("Categories", "Engagement_Type") else F.col(c))
                      for c in fixed.LIST_COLUMNS])


@query
def validate_entries(spark, sf_dir):
    """V1–V10 on typed entries; violations per entry (key columns are
    hashes, so the id identifies the row)."""
    from ..operators.validate import entry_rules, validate
    v = validate(_entries(spark, sf_dir), entry_rules())
    return v.select("id", "partition_key", "title", "link", "published",
                    _joined("violations").alias("violations"),
                    (_size("violations") == 0).alias("valid"))


@query
def log_once(spark, sf_dir):
    """A3 over validation failures: one line per message, count, first id."""
    from ..operators.relational import log_once as once
    from ..operators.validate import entry_rules, validate
    v = validate(_entries(spark, sf_dir), entry_rules())
    # explode_outer + a filter on the generated column: a plain explode makes
    # Catalyst infer size(violations) > 0 and push it below the projection,
    # copying the whole summary chain into that filter
    errs = v.select(F.explode_outer("violations").alias("message"), F.col("id").cast("long").alias("ts")) \
        .filter(F.col("message").isNotNull())
    return once(errs, "message", "ts").select("message", F.col("n").cast("long").alias("n"),
                                              F.col("first_at").alias("first_id"))


@query
def reject_reasons(spark, sf_dir):
    """P1 + A5: queue messages made from events, decoded and checked;
    rejected messages counted per reason."""
    from ..operators.relational import reject_summary
    from ..sources.queue import decode_body, with_reject_reasons
    msgs = _messages(spark, sf_dir)
    checked = with_reject_reasons(msgs.withColumn("payload", decode_body(F.col("body"))))
    return reject_summary(checked).select("reason", F.col("n_messages").cast("long"))


def _messages(spark, sf_dir):
    """Stage-1 queue messages built from events: a signup is a message in
    the wrong state, an error one has no feed URL, a purchase one is sent
    as raw JSON instead of base64 (undecodable)."""
    from ..functions.dates import iso_utc
    from ..sources.queue import encode_body
    ev = load(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "signup", F.lit("retrieved")).otherwise(F.lit("enqueued"))
    url = F.when(F.col("event_type") == "error", F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit("https://feed"), F.col("user_id").cast("string"), F.lit(".example.com/rss")))
    payload = F.struct(F.struct(status.alias("status"), iso_utc("ts").alias("timestamp")).alias("envelope"),
                       F.struct(F.concat(F.lit("feed"), F.col("user_id").cast("string")).alias("name"),
                                url.alias("url"), F.lit("rss").alias("type")).alias("feed"))
    body = F.when(F.col("event_type") == "purchase", F.to_json(payload)).otherwise(encode_body(payload))
    return ev.select("event_id", body.alias("body"))


@query
def queue_roundtrip(spark, sf_dir):
    """S6 then S5: every message encoded and decoded again."""
    from ..sources.queue import decode_body
    m = _messages(spark, sf_dir).withColumn("p", decode_body(F.col("body")))
    return m.select("event_id", F.col("p.envelope.status").alias("status"),
                    F.col("p.envelope.timestamp").alias("enqueued_at"),
                    F.col("p.feed.name").alias("feed_name"), F.col("p.feed.url").alias("feed_url"))


@query
def redelivery_dedupe(spark, sf_dir):
    """T6 (batch form): every message delivered twice; dedupe on
    (feed_url, enqueued_at) leaves each accepted message once.  Each body is
    decoded once; acceptance is combined in the (map-side) dedupe aggregate,
    where no filter can be pushed back into the decoding projection."""
    from ..sources.queue import decode_body, with_reject_reasons
    m = _messages(spark, sf_dir)
    twice = m.unionByName(m).select(decode_body(F.col("body")).alias("payload"))
    keyed = _expand(with_reject_reasons(twice), [], F.struct(
        F.col("payload.feed.url").alias("feed_url"), F.col("payload.envelope.timestamp").alias("enqueued_at"),
        (F.size("reject_reasons") == 0).alias("ok")),
        [("feed_url", "feed_url"), ("enqueued_at", "enqueued_at"), ("ok", "ok")])
    return (keyed.groupBy("feed_url", "enqueued_at").agg(F.bool_or("ok").alias("ok"))
            .filter("ok").select("feed_url", "enqueued_at"))


@query
def json_path(spark, sf_dir):
    """a value inside the events' JSON properties."""
    ev = load(spark, sf_dir, "events")
    return ev.select("event_id", RF.json_path("props", "$.k").alias("k"))


@query
def tags_to_terms(spark, sf_dir):
    """F16 over item tags (list of {term})."""
    it = _items(spark, sf_dir)
    return it.select("id", _joined(RF.tags_to_terms("tags", it.schema["tags"].dataType)).alias("terms"))


@query
def full_content(spark, sf_dir):
    """F17 over pages as feed content lists ([{value: html}])."""
    p = load(spark, sf_dir, "pages").select("page_id", F.array(F.struct(F.col("html").alias("value")))
                                            .alias("content"))
    return p.select("page_id", RF.full_content("content", p.schema["content"].dataType).alias("full_content"))


@query
def image_json(spark, sf_dir):
    """page image maps to JSON text and back."""
    from ..functions.structured import image_from_json, image_to_json
    p = load(spark, sf_dir, "pages")
    img = F.create_map(F.lit("url"), F.col("url"), F.lit("title"), RF.page_title("html"))
    back = image_from_json(image_to_json(img))
    return _expand(p, ["page_id"], back, [("url", "image_url"), ("title", "image_title")])


@query
def embedding_json(spark, sf_dir):
    """embeddings to JSON text; parsed back they must be equal."""
    e = load(spark, sf_dir, "embeddings")
    back = F.from_json(RF.embedding_to_json("embedding"), "array<float>")
    return (e.select("vec_id", "embedding", back.alias("back"))
            .select("vec_id", _size("back").alias("n_dims"), (F.col("back") == F.col("embedding")).alias("roundtrip_equal")))


@query
def engagement_score(spark, sf_dir):
    """A4 + F24: interactions per entry and the engagement score."""
    from ..operators.relational import interaction_counts
    from ..sources.tables import interactions_from_events
    c = interaction_counts(interactions_from_events(load(spark, sf_dir, "events")))
    return c.select("entry_id", F.col("likes").cast("long"), F.col("shares").cast("long"),
                    F.col("comments").cast("long"), "engagement_score")


@query
def prompt_render(spark, sf_dir):
    """F10f + F10g: the engagement prompt pair for every turn."""
    c = load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.lit(fixed.ENGAGEMENT_SYSTEM_PROMPT).alias("system"),
                    RF.render_prompt("text").alias("prompt"), RF.preview("text").alias("preview"))


# -------------------------------------------------- joins / aggregates --

def _list_status(spark, sf_dir):
    """The processed-list index: labels' docs, processed when quality = 1."""
    lab = load(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").cast("string").alias("Entry_ID"),
                      (F.col("quality") == 1).alias("Processed"))


@query
def new_entries_anti(spark, sf_dir):
    """List rows whose Entry_ID is not yet in the list."""
    from ..operators.conform import conform_list15
    from ..operators.relational import new_only
    rows = conform_list15(_items(spark, sf_dir))
    return new_only(rows, _list_status(spark, sf_dir), "Entry_ID").select("Entry_ID", "Title")


@query
def processed_status(spark, sf_dir):
    """A6 + P13: status per Entry_ID, then the rows not processed yet."""
    from ..operators.conform import conform_list15, unprocessed
    from ..operators.relational import processed_status as status
    rows = conform_list15(_items(spark, sf_dir))
    st = status(_list_status(spark, sf_dir), "Entry_ID", "Processed")
    return unprocessed(rows, st, "Entry_ID").select("Entry_ID", "Title")


@query
def entry_feed_join(spark, sf_dir):
    """Entries joined to their feed on the hashed feed key."""
    from ..operators.relational import attach_feed
    j = attach_feed(_entries(spark, sf_dir), _feeds(spark, sf_dir))
    return j.select("id", "partition_key", F.col("feed_title"), F.col("feed_link"),
                    F.col("feed_language"), F.col("feed_partition_key"))


@query
def feed_rows(spark, sf_dir):
    """Feed table rows (P9/P10/F1/F2/F4) with their violations."""
    from ..operators.validate import feed_rules, validate
    v = validate(_feeds(spark, sf_dir), feed_rules())
    return v.select("partition_key", "title", "link", "language", "updated", "entry_partition",
                    F.length("row_key").cast("long").alias("row_key_len"),
                    _joined("violations").alias("violations"))


def _enrichment_raw(spark, sf_dir):
    """Enrichment rows from the embeddings table, keyed like their entry
    (vec_id = entry id): label as engagement score, the vector as
    embeddings."""
    emb = load(spark, sf_dir, "embeddings")
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    return emb.join(docs, emb.vec_id == docs.doc_id).select(
        "vec_id",
        RF.partition_key_from_title("source").alias("PartitionKey"),
        RF.entry_key(F.col("vec_id")).alias("RowKey"),
        F.col("embedding").alias("Embeddings"),
        F.col("label").cast("double").alias("EngagementScore"))


@query
def enrichment_rows(spark, sf_dir):
    """V1, V11–V14 on enrichment rows built from the embeddings table."""
    from ..operators.entities import build_enrichment
    from ..operators.validate import enrichment_rules, validate
    v = validate(build_enrichment(_enrichment_raw(spark, sf_dir), keep=("vec_id",)), enrichment_rules())
    return v.select("vec_id", "partition_key", "engagement_score", _size("embeddings").alias("n_dims"),
                    _joined("violations").alias("violations"))


@query
def entry_enrichment(spark, sf_dir):
    """Entries ⟕ enrichment (embeddings keyed like their entry)."""
    from ..operators.entities import build_enrichment
    from ..operators.relational import with_enrichment
    entries = _entries(spark, sf_dir)
    j = with_enrichment(entries, build_enrichment(_enrichment_raw(spark, sf_dir).drop("vec_id")))
    return j.select("id", _size("enr_embeddings").alias("n_dims"),
                    F.col("enr_engagement_score").alias("engagement_score"))


@query
def entry_enrichment_bucketed(spark, sf_dir):
    """J3 over tables bucketed by the entry's key: the join has no shuffle."""
    from ..operators.entities import build_enrichment
    from ..sources.buckets import bucketed_enrichment
    enrichment = build_enrichment(_enrichment_raw(spark, sf_dir).drop("vec_id"))
    j = bucketed_enrichment(_entries(spark, sf_dir), enrichment, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return j.select("id", _size("enr_embeddings").alias("n_dims"), F.col("enr_engagement_score").alias("engagement_score"))


@query
def content_fallback(spark, sf_dir):
    """Stored content, else the page converted to Markdown."""
    from ..functions.html import html_to_markdown, normalize_html
    from ..operators.relational import content_with_fallback
    pages = load(spark, sf_dir, "pages")
    entries = pages.select(F.lit(fixed.ENTRY_PARTITION_KEY).alias("partition_key"),
                           RF.entry_key(F.col("page_id")).alias("row_key"),
                           F.col("page_id").alias("id"), F.col("url").alias("link"))
    docs = load(spark, sf_dir, "documents")
    stored = docs.join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(
        F.lit(fixed.ENTRY_PARTITION_KEY).alias("partition_key"),
        RF.entry_key(F.col("doc_id")).alias("row_key"), F.col("text").alias("content"))
    out = content_with_fallback(entries, stored, pages, lambda h: html_to_markdown(normalize_html(h)))
    return out.select("id", "content_source", "content")


def _state(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    return (ev.filter(F.col("event_type") == "signup").groupBy(F.col("user_id").alias("feed_id"))
            .agg(F.max("ts").cast("timestamp").alias("last_ingestion")))


@query
def changed_feeds(spark, sf_dir):
    """Which feeds are due (latest fetch 200 and newer than the
    feed's last ingestion)."""
    from ..operators.relational import changed_feeds as due
    from ..sources.tables import fetch_log_from_events
    log = fetch_log_from_events(load(spark, sf_dir, "events"))
    return due(log.withColumn("last_modified", F.col("last_modified").cast("timestamp")), _state(spark, sf_dir))


@query
def feed_transitions(spark, sf_dir):
    """Every check of every feed as a step of its state, and the
    retries whose time came; the batch form of the stateful stream."""
    from ..sources.tables import fetch_log_from_events
    from ..streaming.feed_state import transitions
    log = fetch_log_from_events(load(spark, sf_dir, "events"))
    log = log.select("feed_url", "status", F.col("last_modified").cast("timestamp").alias("last_modified"),
                     F.col("last_modified").cast("timestamp").alias("fetched_at"), F.col("event_id").alias("seq"))
    day = 24 * 60 * 60 * 1000
    out = transitions(log, retries=2, delay_ms=day, factor=3.0)
    micros = lambda c: F.unix_micros(c)
    return out.select("feed_url", micros("at").alias("at_us"), "event", "failures", micros("next_at").alias("next_us"))


@query
def next_watermark(spark, sf_dir):
    """The state after the run — due feeds move to the run's start."""
    from ..operators.relational import changed_feeds as due
    from ..sources.store import merge_upsert
    from ..sources.tables import fetch_log_from_events
    log = fetch_log_from_events(load(spark, sf_dir, "events"))
    state = _state(spark, sf_dir)
    ch = due(log.withColumn("last_modified", F.col("last_modified").cast("timestamp")), state)
    new = ch.filter("changed").select("feed_id", F.lit(RUN_START).cast("timestamp").alias("last_ingestion"))
    return merge_upsert(state, new, ["feed_id"])


@query
def entry_key_lists(spark, sf_dir):
    """A1: per feed, entry keys in arrival order cut into payload chunks."""
    from ..operators.relational import entry_key_lists as lists
    d = load(spark, sf_dir, "documents").select(
        "source", "doc_id", RF.partition_key_from_title("source").alias("partition_key"),
        RF.entry_key(F.col("doc_id")).alias("row_key"))
    out = lists(d, "source", "doc_id")
    return out.select("source", "chunk", F.col("n_entries").cast("long"), "first_entry", "last_entry",
                      _size("entries").alias("n_keys"))


def _events_entity(ev):
    return ev.select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


@query
def last_write_wins(spark, sf_dir):
    """Per user, the latest event by (ts, event_id)."""
    from ..operators.relational import last_write_wins as lww
    return lww(_events_entity(load(spark, sf_dir, "events")), ["user_id"], ["ts", "event_id"])


@query
def upsert_merge(spark, sf_dir):
    """The snapshot of early events merged with the later batch; a
    NULL property in the batch keeps the stored value."""
    from ..operators.relational import last_write_wins as lww
    from ..sources.store import merge_upsert
    ev = _events_entity(load(spark, sf_dir, "events"))
    old = lww(ev.filter(F.col("ts") < F.lit(SPLIT_AT).cast("timestamp")), ["user_id"], ["ts", "event_id"])
    new = lww(ev.filter(F.col("ts") >= F.lit(SPLIT_AT).cast("timestamp")), ["user_id"], ["ts", "event_id"])
    new = new.withColumn("value", F.when(F.col("event_type") != "view", F.col("value")))
    return merge_upsert(old, new, ["user_id"])


@query
def keyed_delete(spark, sf_dir):
    """Entries minus the ones flagged toxic."""
    from ..sources.store import keyed_delete as delete
    d = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "source", RF.partition_key_from_title("source").alias("partition_key"),
        RF.entry_key(F.col("doc_id")).alias("row_key"))
    tox = load(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    gone = d.join(tox, d.id == tox.doc_id, "left_semi")
    return delete(d, gone, ["partition_key", "row_key"]).select("id", "source")


# ------------------------------------------------------ parse / score --

@query
def feed_xml_parse(spark, sf_dir):
    """S3: every document as an RSS 2.0 document, parsed back with
    ``from_xml`` and exploded to items."""
    from ..sources.feeds import parse_feed_xml, rss_document
    d = load(spark, sf_dir, "documents")
    docs = d.select(F.col("doc_id").alias("doc"), rss_document(d).alias("xml"))
    items = parse_feed_xml(docs, "xml")
    return items.select(F.col("id").cast("long").alias("doc_id"), "feed_title", "feed_language",
                        "title", "link", F.col("summary").alias("text"),
                        _joined("categories").alias("categories"))


@query
def feed_bytes(spark, sf_dir):
    """S3: every document as the bytes of a feed in one of four states (UTF-16 either way, Latin-1
    where it can be, broken off with a stray sign and a control character), decoded, mended, parsed."""
    from ..sources.feeds import parse_feed_xml, rss_document
    d = load(spark, sf_dir, "documents")
    xml = rss_document(d)
    broken = F.replace(F.replace(xml, F.lit("</category></item></channel></rss>"), F.lit("")), F.lit("<channel><title>"), F.lit("<channel><title>R & D\x07<br>"))
    latin = F.when(xml.rlike(r"^[\x00-\x7f\xa0-\xff]*$"), F.encode(F.replace(xml, F.lit("UTF-8"), F.lit("ISO-8859-1")), "ISO-8859-1")).otherwise(F.encode(xml, "UTF-8"))
    state = F.pmod("doc_id", F.lit(4))
    data = (F.when(state == 0, F.encode(xml, "UTF-16")).when(state == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(xml, "UTF-16LE")))
            .when(state == 2, latin).otherwise(F.encode(broken, "UTF-8")))
    items = parse_feed_xml(d.select("doc_id", data.alias("data")), "data", repair=True)
    return items.select("doc_id", "parsed", F.col("id").cast("long").alias("item_id"), "title", "link", F.col("summary").alias("text"),
                        _joined("categories").alias("categories"))


@query
def markdown_to_html(spark, sf_dir):
    """F10d: page Markdown rendered back to HTML."""
    p = load(spark, sf_dir, "pages")
    md = RF.html_to_markdown(RF.normalize_html("html"))
    return p.select("page_id", RF.markdown_to_html(md).alias("html_out"))


@query
def sentiment_lexicon(spark, sf_dir):
    """U3b offline model over whole documents."""
    from ..operators.enrich import lexicon_sentiment
    d = load(spark, sf_dir, "documents")
    return _expand(d, ["doc_id"], lexicon_sentiment("text"),
                   [("sentiment", "sentiment"), ("score", "score"), ("positive", "positive"),
                    ("negative", "negative")])


@query
def polarity_words(spark, sf_dir):
    """Words that keep company with the seeds more often than chance, within each language."""
    d = load(spark, sf_dir, "documents")
    return polarity.learn_polarity(d, *POLARITY_SEEDS, within="lang").withColumnRenamed("g", "lang")


@query
def polarity_sentiment(spark, sf_dir):
    """Every document scored by the polarity read off the corpus."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learnt = polarity.learn_polarity(d, *POLARITY_SEEDS, within="lang")
    return polarity.score_polarity(d, learnt, within="lang").select("doc_id", "sentiment", "score", "positive", "negative")


@query
def npy_roundtrip(spark, sf_dir):
    """Every embedding written as a ``.npy`` blob and read back, component by component."""
    e = load(spark, sf_dir, "embeddings")
    blob = e.select("vec_id", RF.array_to_npy(F.col("embedding").cast("array<float>")).alias("blob"))
    read = blob.select("vec_id", F.length("blob").cast("long").alias("n_bytes"), F.posexplode_outer(RF.npy_to_array("blob")).alias("pos", "x"))
    return read.where("pos is not null").select("vec_id", "n_bytes", F.col("pos").cast("long").alias("pos"), "x")


@query
def model_reply_parse(spark, sf_dir):
    """replies parsed — user turns answered by the offline model in
    the reply format, other turns are free text (→ Error, 0.0)."""
    from ..operators.enrich import sentiment_reply
    c = load(spark, sf_dir, "conversations")
    reply = F.when(F.col("role") == "user", sentiment_reply("text")).otherwise(F.col("text"))
    return _expand(c, ["conv_id", "turn"], RF.parse_sentiment_reply(reply),
                   [("sentiment", "sentiment"), ("score", "score")])


@query
def list_schema_rules(spark, sf_dir):
    """List rows scored (F25 readability, lexicon sentiment, A4+F24
    engagement) and checked against the list schema's rules."""
    from ..operators.conform import conform_list15
    from ..operators.enrich import lexicon_sentiment
    from ..operators.validate import rules_from_list_schema, validate
    rows = conform_list15(_items(spark, sf_dir))
    scored = rows.withColumn("Readability_Score", RF.readability("Summary")) \
                 .withColumn("Sentiment", lexicon_sentiment("Summary")["sentiment"])
    v = validate(scored, rules_from_list_schema(fixed.LIST_SCHEMA))
    return v.select("Entry_ID", "Readability_Score", "Sentiment", _joined("violations").alias("violations"))


def _batch_summary_model():
    """Offline stand-in for a hosted summary+score model (U3a/U3d), built
    once per task: first sentence as summary, score 1..10 from length."""
    import json as _json
    import re as _re
    split = _re.compile(r"(?<=[.!?])\s+")

    def predict(texts):
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            first = split.split(t.strip(), 1)[0]
            out.append(_json.dumps({"summary": first, "score": min(10, 1 + len(t) // 2000)}))
        return out
    return predict


@query
def model_batch_score(spark, sf_dir):
    """Pluggable batch scoring (Arrow batches, one model per task,
    retry + error policy per row) over whole documents, replies parsed (F22)."""
    from ..operators.enrich import score_text
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    s = score_text(d, "text", _batch_summary_model, "reply", on_error="null", retries=1, delay_ms=100)
    return _expand(s, ["doc_id", "reply_error"], RF.parse_summary_reply("reply"),
                   [("summary", "summary"), ("score", "score")])


@query
def enrich_pipeline(spark, sf_dir):
    """U3e: every document's cleaned summary → summary, sentiment, readability and
    embedding (Spark ML hashing, reported by its size and length)."""
    from ..operators.enrich import enrich
    d = load(spark, sf_dir, "documents").select("doc_id", RF.clean_summary("text").alias("summary"))
    e = enrich(d, "summary")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.select("doc_id", "ai_summary", "sentiment", "sentiment_score", "readability",
                    _size("embedding").alias("n_dims"), F.round(norm, 3).alias("norm"))


@query
def frame_rows(spark, sf_dir):
    """P3 frame (defaults filled) stored as table rows keyed by month of
    the published date and Entry_ID (the key itself is a hash: keyed)."""
    from ..operators.conform import conform_frame13, frame_table_rows
    rows = frame_table_rows(conform_frame13(_items(spark, sf_dir), fill_nulls=True))
    return rows.select("PartitionKey", "Title", "URL", "Sentiment", "Readability", "Embedding",
                       F.length("RowKey").cast("long").alias("row_key_len"))


# ------------------------------------- rules on rows that break them --
# Columns of the given tables stand in for fields, so that every rule both
# holds and fails on some rows.

def _spaced_key(d):
    return F.when(d.lang == "fr", F.concat_ws(" ", d.source, d.lang)).otherwise(d.source)


@query
def feed_rules_broken(spark, sf_dir):
    """V1, V4-V7, V10 on feed rows with long, missing and malformed fields."""
    from ..operators.validate import feed_rules, validate
    d = load(spark, sf_dir, "documents")
    rows = d.select("doc_id", _spaced_key(d).alias("partition_key"), d.text.alias("title"),
                    F.when(d.lang != "de", F.lit("https://e.com/")).alias("link"),
                    F.when(d.lang == "es", F.upper("lang")).otherwise(d.lang).alias("language"),
                    d.text.alias("publisher"), d.text.alias("rights"), d.text.alias("subtitle"),
                    F.when(d.lang != "es", F.lit("2025-02-26").cast("timestamp")).alias("updated"))
    return validate(rows, feed_rules()).select("doc_id", _joined("violations").alias("violations"))


@query
def entry_rules_broken(spark, sf_dir):
    """V1-V5, V8-V10 on entry rows with long, missing and malformed fields."""
    from ..operators.validate import entry_rules, validate
    d = load(spark, sf_dir, "documents")
    first = RF.first_line("text")
    rows = d.select("doc_id", _spaced_key(d).alias("partition_key"), F.when(d.lang != "de", first).alias("id"),
                    F.when(d.lang == "es", F.lit("not-a-key")).otherwise(F.substring(F.md5("text"), 1, 16)).alias("feed_key"),
                    first.alias("title"), F.when(d.lang != "de", F.lit("https://e.com/")).alias("link"),
                    first.alias("author"), d.text.alias("summary"),
                    F.when(d.lang != "fr", F.lit("2025-02-26").cast("timestamp")).alias("published"))
    return validate(rows, entry_rules()).select("doc_id", _joined("violations").alias("violations"))


@query
def enrichment_rules_broken(spark, sf_dir):
    """V1, V9, V11-V14 on scores out of range and category sets of all kinds."""
    from ..operators.validate import enrichment_rules, validate
    d = load(spark, sf_dir, "documents")
    cats = (F.when(d.lang == "en", F.array(F.lit("Liked"), F.lit("Comment"))).when(d.lang == "fr", F.array(F.lit("Bogus")))
            .when(d.lang == "de", F.array().cast("array<string>")))
    rows = d.select("doc_id", _spaced_key(d).alias("partition_key"), d.text.alias("row_key"), d.text.alias("summary"),
                    (d.n_chars / 200).alias("grade_level"), (d.n_chars / 400).alias("difficulty"),
                    (d.n_chars / 500).alias("engagement_score"), cats.alias("engagement_categories"))
    return validate(rows, enrichment_rules()).select("doc_id", _joined("violations").alias("violations"))


@query
def post_rules_broken(spark, sf_dir):
    """V4, V15-V17, F3, F12 on post drafts made from conversation turns."""
    from ..operators.entities import build_posts
    from ..operators.validate import post_rules, validate
    c = load(spark, sf_dir, "conversations")
    raw = c.select(F.concat_ws(" ", c.conv_id.cast("string"), c.turn.cast("string"), c.text).alias("title"),
                   F.when(c.role == "user", F.lit("2025-02-26 18:42:40")).when(c.role == "assistant", F.lit("soon")).alias("draft_date"),
                   F.split("text", " ").alias("keywords"), c.text.alias("content"),
                   F.when(c.role == "user", F.array(F.lit(fixed.DRAFT_STATUSES[0]))).when(c.role == "assistant", F.array(F.lit("Unknown")))
                   .otherwise(F.array(*[F.lit(x) for x in fixed.DRAFT_STATUSES])).alias("draft_status"))
    v = validate(build_posts(raw), post_rules())
    return (v.groupBy("partition_key", _joined("violations").alias("violations"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("row_key").isNotNull()).alias("n_keyed")))


@query
def content_rules_broken(spark, sf_dir):
    """V20 on missing, empty, sentinel and real content."""
    from ..operators.validate import content_rules, validate
    d = load(spark, sf_dir, "documents")
    content = (F.when(d.lang == "de", F.lit("")).when(d.lang == "es", F.lit(fixed.MISSING_CONTENT_SENTINEL))
               .when(d.lang == "en", d.text))
    return (validate(d.select("doc_id", content.alias("content")), content_rules())
            .select("doc_id", _joined("violations").alias("violations")))


@query
def upsert_duplicate_keys(spark, sf_dir):
    """S10 + A2: a stored table takes a batch that holds each key many times; the
    last row of a key wins, and a NULL keeps what is stored."""
    import uuid
    from ..session import scratch_path
    from ..sources.store import KeyedTable
    d = load(spark, sf_dir, "documents")
    path = scratch_path(spark, f"upsert-{uuid.uuid4().hex}")
    keys = [F.col("source").alias("partition_key"), F.col("lang").alias("row_key")]
    table = KeyedTable(spark, path, ["partition_key", "row_key"], seq_cols=["seq"])
    table.upsert(d.select(*keys, F.col("doc_id").alias("seq"), F.col("doc_id").alias("last_doc"), F.lit("first").alias("note")))
    table.upsert(d.where(F.col("lang") != "de").select(*keys, F.col("n_chars").alias("seq"), F.col("n_chars").alias("last_doc"),
                                                      F.lit(None).cast("string").alias("note")))
    return table.read().select("partition_key", "row_key", "last_doc", "note")


@query
def feed_accounting(spark, sf_dir):
    """What becomes of every landed document: feed documents (from the
    documents) and web pages landed in their place; nothing is lost."""
    from ..sources.feeds import parse_feed_xml, rss_document
    d, p = load(spark, sf_dir, "documents"), load(spark, sf_dir, "pages")
    landed = (d.select(F.lit("document").alias("origin"), F.concat(F.lit("d"), d.doc_id.cast("string")).alias("feed_url"), rss_document(d).alias("xml"))
              .unionByName(p.select(F.lit("page").alias("origin"), F.concat(F.lit("p"), p.page_id.cast("string")).alias("feed_url"), p.html.alias("xml"))))
    items = parse_feed_xml(landed, "xml")
    outcome = (F.when(~F.col("parsed"), F.lit("document_unparsable")).when(F.col("item_pos").isNull(), F.lit("no_items"))
               .when(F.col("id").isNull(), F.lit("item_without_id")).otherwise(F.lit("item")))
    return items.groupBy("origin", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
