"""Conform, validate and relational operators."""

import json
from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet import fixed
from rivulet.operators import conform as C
from rivulet.operators import relational as R
from rivulet.operators import validate as V
from rivulet.operators.entities import build_enrichment, build_entries, build_feeds, build_posts

ITEM_SCHEMA = ("id string, title string, link string, summary string, published string, author string, "
               "tags array<struct<term:string>>, content array<struct<value:string>>")


def _items(spark, rows=None):
    rows = rows or [("1", "T1", "https://a.example.com/1", "<p>S one. S two.</p>", "Wed, 26 Feb 2025 18:42:40 +0000",
                     "me", [{"term": "x"}], [{"value": "body"}]),
                    ("2", "T2", "https://a.example.com/2", None, None, None, None, None)]
    return spark.createDataFrame(rows, ITEM_SCHEMA)


def test_required_columns(spark):
    df = spark.createDataFrame([("x",)], "title string")
    with pytest.raises(C.MissingColumnsError):
        C.conform_frame13(df)
    out = C.conform_list15(df)
    assert out.count() == 0 and out.columns == fixed.LIST_COLUMNS


def test_conform_frame13_defaults(spark):
    minimal = spark.createDataFrame([("1", "T", "https://x.org")], "id string, title string, link string")
    r = C.conform_frame13(minimal).first()
    assert list(r.asDict()) == fixed.FRAME_COLUMNS
    assert (r.Summary, r.Published_Date, r.Full_Content, r.Author, r.Categories, r.Embeddings) == (
        fixed.DEFAULT_SUMMARY, fixed.DEFAULT_PUBLISHED_TEXT, fixed.DEFAULT_CONTENT, fixed.DEFAULT_AUTHOR, [], [])
    full = C.conform_frame13(_items(spark)).orderBy("Title").collect()
    assert full[0].Categories == ["x"] and full[0].Full_Content == "body"
    assert full[1].Summary is None  # present column keeps its NULL
    assert C.conform_frame13(_items(spark), fill_nulls=True).orderBy("Title").collect()[1].Summary == fixed.DEFAULT_SUMMARY


def test_conform_list15(spark):
    r = C.conform_list15(_items(spark)).orderBy("Entry_ID").collect()
    assert r[0].Entry_ID == "1" and r[0].Engagement_Score == 0 and r[0].Processed is False
    assert r[0].Engagement_Type == [] and r[0].Keywords == ""


def test_list_column_map_and_rename(spark):
    meta = spark.createDataFrame([("Title", "Title"), ("URL", "field_a1"), ("Other", "field_zz"),
                                  ("Summary", "Something")], "display_name string, name string")
    m = {r.display_name: r.name for r in C.list_column_map(meta).collect()}
    assert m == {"Title": "Title", "URL": "field_a1"}
    df = spark.createDataFrame([("t", "u")], "Title string, URL string")
    assert C.rename_columns(df, m).columns == ["Title", "field_a1"]
    with pytest.raises(ValueError):
        C.rename_columns(df, {"Title": "x", "URL": "x"})


def test_project_aliases(spark):
    df = spark.createDataFrame([("a", None, "z")], "Title string, link string, Extra string")
    out = C.project_aliases(df, [("title", "Title"), ("link", "Link"), ("author", "Author")])
    assert out.columns == ["title", "link", "author"] and out.first().title == "a"


def test_entries_and_validation(spark):
    items = _items(spark, [
        ("1", "Good", "https://a.example.com/1", "<p>Fine.</p>", "2025-01-01", "me", None, None),
        ("2", "x" * 201, "https://a.example.com/2", None, None, None, None, None),
        ("3", "Bad link", "ftp://nope", None, "garbage date", "a" * 51, None, None),
    ]).withColumn("partition_key", F.lit("tech")).withColumn("feed_key", F.lit("0123456789abcdef"))
    v = V.validate(build_entries(items), V.entry_rules()).orderBy("id").collect()
    assert v[0].violations == [] and v[0].summary == "Fine." and v[0].published == datetime(2025, 1, 1)
    assert v[1].violations == ["title_length"] and v[1].published == datetime(1970, 1, 1)
    assert set(v[2].violations) == {"link_not_http_url", "author_length", "published_unparsable"}
    good, bad = V.split_valid(build_entries(items), V.entry_rules())
    assert good.count() == 1 and bad.count() == 2


def test_feed_rows(spark):
    raw = spark.createDataFrame([("AI News", None, "en-US", '{"url": "u"}'), ("T", "https://t.org", "english", None)],
                                "title string, link string, language string, image string") \
        .withColumn("src", F.lit("https://feed.example.com/rss"))
    f = V.validate(build_feeds(raw, "src"), V.feed_rules()).orderBy("title").collect()
    assert f[0].link == "https://feed.example.com/rss" and f[0].entry_partition == "a_i_news"
    assert f[0].image == {"url": "u"} and f[0].violations == []
    assert f[1].violations == ["language_pattern"] and len(f[1].row_key) == 16


def test_enrichment_rules(spark):
    raw = spark.createDataFrame([("p", "r1", 5.0, 5.0, 5.0, ["Liked", "Commented"]),
                                 ("p", "r2", 16.0, 4.0, 11.0, ["Bogus"]), ("p!", "r3", None, None, None, [])],
                                "PartitionKey string, RowKey string, GradeLevel double, Difficulty double, "
                                "EngagementScore double, EngagementCategories array<string>")
    v = V.validate(build_enrichment(raw), V.enrichment_rules()).orderBy("row_key").collect()
    assert v[0].violations == [] and v[0].engagement_categories == ["Liked", "Comment"]
    assert set(v[1].violations) == {"grade_level_range", "difficulty_range", "engagement_score_range",
                                    "engagement_categories"}
    assert set(v[2].violations) == {"partition_key_pattern", "engagement_categories"}


def test_post_rules(spark):
    raw = spark.createDataFrame([("Title", "2025-03-04 05:06:07", ["k"], "# Hi", ["Draft"]),
                                 ("", "nope", [], "", ["Draft", "Posted"])],
                                "title string, draft_date string, keywords array<string>, content string, "
                                "draft_status array<string>")
    v = V.validate(build_posts(raw), V.post_rules()).orderBy(F.desc("title")).collect()
    assert v[0].violations == [] and v[0].partition_key == "2025-03" and v[0].content_html == "<h1>Hi</h1>"
    assert set(v[1].violations) >= {"title_length", "keywords_size", "content_length", "draft_status",
                                    "draft_date_unparsable", "row_key_missing"}


def test_list_schema_rules(spark):
    spec = {"fields": [
        {"display_name": "Sentiment", "type": "Choice (Single-select)", "nullable": False,
         "allowed_values": ["Positive", "Neutral", "Negative", "Mixed"]},
        {"display_name": "Readability_Score", "type": "Number", "nullable": False, "range": [0.0, 100.0]},
        {"display_name": "Engagement_Type", "type": "Choice (Multi-select)", "nullable": True,
         "allowed_values": ["Shared", "Liked", "Commented"]}]}
    df = spark.createDataFrame([("Positive", 50.0, ["Shared"]), ("Angry", 101.0, ["Nope"]), (None, None, None)],
                               "Sentiment string, Readability_Score double, Engagement_Type array<string>")
    v = [r.violations for r in V.validate(df, V.rules_from_list_schema(json.dumps(spec))).collect()]
    assert v == [[], ["Sentiment_allowed", "Readability_Score_range", "Engagement_Type_allowed"],
                 ["Sentiment_null", "Readability_Score_null"]]


def test_ordered_index_equals_row_number_under_skew(spark):
    rows = [("hot", i) for i in range(0, 3000, 3)] + [("cold", i) for i in range(10)] + [("hot", 5001)]
    df = spark.createDataFrame(rows, "k string, o long")
    got = R.ordered_index(df, ["k"], "o", block=64).select("k", "o", "idx")
    want = df.withColumn("idx", (F.row_number().over(Window.partitionBy("k").orderBy("o")) - 1).cast("long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_entry_key_lists_chunks(spark):
    df = spark.createDataFrame([("f", i, "p", f"r{i}") for i in range(7)], "feed string, o long, partition_key string, row_key string")
    out = R.entry_key_lists(df, "feed", "o", chunk=3).orderBy("chunk").collect()
    assert [r.n_entries for r in out] == [3, 3, 1]
    assert out[0].entries == [["p", "r0"], ["p", "r1"], ["p", "r2"]]


def test_last_write_wins_and_log_once(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")], "k int, seq int, v string")
    assert sorted(map(tuple, R.last_write_wins(df, ["k"], ["seq"]).collect())) == [(1, 3, "c"), (2, 1, "z")]
    errs = spark.createDataFrame([("boom", 3), ("boom", 1), ("bang", 2)], "message string, ts int")
    assert sorted(map(tuple, R.log_once(errs).collect())) == [("bang", 1, 2), ("boom", 2, 1)]


def test_changed_feeds_cases(spark):
    t = datetime
    log = spark.createDataFrame([
        (1, 200, t(2024, 1, 5), 1), (2, 304, t(2024, 1, 5), 2), (3, 500, t(2024, 1, 5), 3),
        (4, 200, t(2024, 1, 1), 4), (5, 200, t(2024, 1, 5), 5), (6, 204, t(2024, 1, 5), 6)],
        "feed_id int, status int, last_modified timestamp, event_id int")
    state = spark.createDataFrame([(1, t(2024, 1, 2)), (4, t(2024, 1, 2))], "feed_id int, last_ingestion timestamp")
    got = {r.feed_id: r.changed for r in R.changed_feeds(log, state).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_joins(spark):
    entries = spark.createDataFrame([("p", "a", "k1", "https://x/1"), ("p", "b", "k2", "https://x/2"),
                                     ("p", "c", "k9", "https://x/3")],
                                    "partition_key string, row_key string, feed_key string, link string")
    feeds = spark.createDataFrame([("k1", "F1"), ("k2", "F2")], "row_key string, title string")
    assert R.attach_feed(entries, feeds).count() == 2
    assert [r.row_key for r in R.orphan_entries(entries, feeds).collect()] == ["c"]
    content = spark.createDataFrame([("p", "a", "stored"), ("p", "b", "")], "partition_key string, row_key string, content string")
    pages = spark.createDataFrame([("https://x/2", "<h1>P</h1>")], "url string, html string")
    out = {r.row_key: (r.content_source, r.content) for r in
           R.content_with_fallback(entries, content, pages, lambda h: F.coalesce(h, F.lit(""))).collect()}
    assert out == {"a": ("store", "stored"), "b": ("page", "<h1>P</h1>"), "c": ("missing", None)}
    assert R.new_only(entries, entries.limit(1), "row_key").count() == 2


def test_union_and_category_set(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, "y")], "x int, y string")
    assert R.union_all([a, b]).count() == 2
    df = spark.createDataFrame([(["a", "b"], ["b", "c"])], "l array<string>, r array<string>")
    assert df.select(R.category_set(F.col("l"), F.col("r"))).first()[0] == ["a", "b", "c"]


def test_missing_id_guard_and_content_exclusion(spark):
    items = spark.createDataFrame([("1", "a"), (None, "b")], "id string, title string")
    assert C.drop_missing_ids(items).count() == 1
    assert C.drop_missing_ids(items.drop("id")).count() == 0
    e = spark.createDataFrame([("p", "r", "c")], "partition_key string, row_key string, content string")
    assert C.without_content(e).columns == ["partition_key", "row_key"]


def test_entry_key_lists_respect_message_bytes(spark):
    pk = "p" * 200
    df = spark.createDataFrame([("f", i, pk, f"{i:016x}") for i in range(1000)],
                               "feed string, o long, partition_key string, row_key string")
    from rivulet.sources.queue import encode_body, mark_retrieved
    out = R.entry_key_lists(df, "feed", "o")
    sizes = out.select(F.length(encode_body(mark_retrieved(F.lit("0123456789abcdef"), F.col("entries"),
                                                           F.lit("2024-01-01T00:00:00+00:00")))).alias("n"),
                       "n_entries").collect()
    assert sum(r.n_entries for r in sizes) == 1000
    assert max(r.n for r in sizes) <= 64 * 1024 and max(r.n_entries for r in sizes) < 400
