"""Queue-driven ingestion end to end: redelivery, restart, two stages."""

import base64
import json
import os

from pyspark.sql import functions as F

from rivulet.streaming.ingest import enqueue_changed_feeds, start_entry_enrichment, start_feed_ingest

RSS = """<rss version="2.0"><channel><title>{title}</title><link>{link}</link><language>en</language>
{items}</channel></rss>"""
ITEM = """<item><guid>{g}</guid><title>Entry {g}</title><link>{link}/{g}</link>
<description>&lt;p&gt;A good entry {g}. More text.&lt;/p&gt;</description><pubDate>Wed, 26 Feb 2025 18:42:40 +0000</pubDate></item>"""


def _msg(url, ts="2024-02-01T06:00:00+00:00", status="enqueued"):
    p = {"envelope": {"status": status, "timestamp": ts}, "feed": {"name": "n", "url": url, "type": "rss"}}
    return base64.b64encode(json.dumps(p).encode()).decode()


def _write(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def _landed(spark):
    docs = []
    for n, title in [(1, "Tech News"), (2, "Daily Brief")]:
        link = f"https://feed{n}.example.com"
        items = "".join(ITEM.format(g=f"{n}-{i}", link=link) for i in range(5))
        docs.append((f"{link}/rss", RSS.format(title=title, link=link, items=items)))
    docs.append(("https://broken.example.com/rss", "<rss><channel>"))
    return spark.createDataFrame(docs, "feed_url string, xml string")


def test_two_stage_pipeline_with_redelivery_and_restart(spark, tmp_dir):
    q1, q2 = os.path.join(tmp_dir, "q_feeds"), os.path.join(tmp_dir, "q_entries")
    tables = {k: os.path.join(tmp_dir, k) for k in ("feeds", "entries", "quarantine", "rejected", "enrichment")}
    landed = _landed(spark)
    _write(q1, "m1.txt", [_msg("https://feed1.example.com/rss"), _msg("https://feed1.example.com/rss"),
                          _msg("https://feed2.example.com/rss", status="retrieved"), "garbage"])
    q = start_feed_ingest(spark, q1, landed, tables, q2, name="t_ingest", now="2024-02-01 06:00:00")
    q.awaitTermination()
    entries = spark.read.parquet(tables["entries"])
    assert entries.count() == 5 and entries.select("partition_key").distinct().first()[0] == "tech_news"
    assert spark.read.parquet(tables["rejected"]).count() == 2
    # restart from the checkpoint: redelivered + new message
    _write(q1, "m2.txt", [_msg("https://feed1.example.com/rss"), _msg("https://feed2.example.com/rss")])
    q = start_feed_ingest(spark, q1, landed, tables, q2, name="t_ingest", now="2024-02-01 06:00:00")
    q.awaitTermination()
    entries = spark.read.parquet(tables["entries"])
    assert entries.count() == 10
    assert entries.select("partition_key", "row_key").distinct().count() == 10
    assert spark.read.parquet(tables["feeds"]).count() == 2
    # stage 2
    q = start_entry_enrichment(spark, q2, tables, name="t_enrich")
    q.awaitTermination()
    enr = spark.read.parquet(tables["enrichment"])
    assert enr.count() == 10 and enr.filter(F.size("embeddings") == 64).count() == 10
    assert enr.filter(F.col("sentiment") == "Positive").count() == 10


def test_enqueue_changed_feeds_advances_state(spark, tmp_dir):
    from datetime import datetime
    feeds = spark.createDataFrame([("A", "https://a.org/rss", "rss"), ("B", "https://b.org/rss", "rss")],
                                  "name string, url string, type string")
    log = spark.createDataFrame([("https://a.org/rss", 200, datetime(2024, 1, 5), 1),
                                 ("https://b.org/rss", 304, datetime(2024, 1, 5), 2)],
                                "feed_url string, status int, last_modified timestamp, event_id int")
    qdir, state = os.path.join(tmp_dir, "q"), os.path.join(tmp_dir, "state")
    assert enqueue_changed_feeds(spark, feeds, log, state, qdir, "2024-01-10 06:00:00") == 1
    assert spark.read.text(qdir).count() == 1
    st = spark.read.parquet(state).collect()
    assert [(r.feed_id, str(r.last_ingestion)) for r in st] == [("https://a.org/rss", "2024-01-10 06:00:00")]
    # same fetch log again: nothing new after the watermark
    assert enqueue_changed_feeds(spark, feeds, log, state, qdir, "2024-01-11 06:00:00") == 0
    assert spark.read.text(qdir).count() == 1


def test_run_pipeline_end_to_end(spark, tmp_dir):
    from datetime import datetime
    from rivulet.streaming.ingest import run_pipeline
    feeds = spark.createDataFrame([("one", "https://feed1.example.com/rss", "rss"),
                                   ("two", "https://feed2.example.com/rss", "rss")], "name string, url string, type string")
    log = spark.createDataFrame([("https://feed1.example.com/rss", 200, datetime(2024, 1, 5), 1),
                                 ("https://feed2.example.com/rss", 304, datetime(2024, 1, 5), 2)],
                                "feed_url string, status int, last_modified timestamp, event_id int")
    paths = run_pipeline(spark, feeds, log, _landed(spark), os.path.join(tmp_dir, "run"), "2024-01-10 06:00:00")
    assert spark.read.parquet(paths["entries"]).count() == 5          # only the changed feed
    assert spark.read.parquet(paths["enrichment"]).count() == 5


def test_crash_mid_batch_then_replay(spark, tmp_dir, monkeypatch):
    import pytest
    import rivulet.streaming.ingest as ing
    q1, q2 = os.path.join(tmp_dir, "qf"), os.path.join(tmp_dir, "qe")
    tables = {k: os.path.join(tmp_dir, k) for k in ("feeds", "entries", "quarantine", "rejected", "enrichment")}
    landed = _landed(spark)
    _write(q1, "m.txt", [_msg("https://feed1.example.com/rss"), _msg("https://feed2.example.com/rss"), "bad"])
    real = ing.entry_key_lists

    def crash(*a, **k):
        raise RuntimeError("executor lost")
    monkeypatch.setattr(ing, "entry_key_lists", crash)   # dies after the entries upsert
    q = start_feed_ingest(spark, q1, landed, tables, q2, name="t_crash", now="2024-02-01 06:00:00")
    with pytest.raises(Exception):
        q.awaitTermination()
    assert spark.read.parquet(tables["entries"]).count() == 10 and not os.path.exists(q2)
    monkeypatch.setattr(ing, "entry_key_lists", real)
    q = start_feed_ingest(spark, q1, landed, tables, q2, name="t_crash", now="2024-02-01 06:00:00")
    q.awaitTermination()                                  # the same batch, replayed
    e = spark.read.parquet(tables["entries"])
    assert e.count() == 10 and e.select("partition_key", "row_key").distinct().count() == 10
    assert spark.read.text(q2).count() == 2               # one key list per feed, written once
    assert spark.read.parquet(tables["rejected"]).count() == 1   # replay replaced, not appended


def test_entries_saved_only_with_content(spark, tmp_dir):
    q1, q2 = os.path.join(tmp_dir, "qf"), os.path.join(tmp_dir, "qe")
    tables = {k: os.path.join(tmp_dir, k) for k in
              ("feeds", "entries", "quarantine", "rejected", "enrichment", "content")}
    pages = spark.createDataFrame([(f"https://feed1.example.com/1-{i}", f"<h1>Page {i}</h1><p>Body.</p>")
                                   for i in range(3)], "url string, html string")
    _write(q1, "m.txt", [_msg("https://feed1.example.com/rss")])
    q = start_feed_ingest(spark, q1, _landed(spark), tables, q2, name="t_content", pages=pages)
    q.awaitTermination()
    assert spark.read.parquet(tables["entries"]).count() == 3          # 3 of 5 have a page
    content = spark.read.parquet(tables["content"]).collect()
    assert len(content) == 3 and all(r.content.startswith("# Page") for r in content)
    quarantined = spark.read.parquet(tables["quarantine"])
    assert quarantined.filter(F.array_contains("violations", "content_missing")).count() == 2


TWO_RUNS = """
import sys
from datetime import datetime
sys.path.insert(0, {repo!r})
from rivulet.session import build_session
from rivulet.plans.jobs import daily_job
from tests.test_streaming import _landed
spark = build_session("local[2]", 2, extra={{"spark.checkpoint.dir": {ckpt!r}, "spark.ui.showConsoleProgress": "false"}})
feeds = spark.createDataFrame([("one", "https://feed1.example.com/rss", "rss")], "name string, url string, type string")
log = spark.createDataFrame([("https://feed1.example.com/rss", 200, datetime(2024, 1, 5), 1)],
                            "feed_url string, status int, last_modified timestamp, event_id int")
landed = _landed(spark)
paths = daily_job(spark, feeds, log, landed.unionByName(landed), {root!r}, {start!r})
print("ROWS", spark.read.parquet(paths["entries"]).count(), spark.read.parquet(paths["enrichment"]).count())
"""


def test_two_processes_share_one_root(tmp_dir):
    """The second process goes on where the first stopped; a document landed twice counts once."""
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for start in ("2024-01-10 06:00:00", "2024-01-11 06:00:00"):
        code = TWO_RUNS.format(repo=repo, ckpt=os.path.join(tmp_dir, "ckpt"), root=os.path.join(tmp_dir, "root"), start=start)
        out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=repo, timeout=300)
        assert "ROWS 5 5" in out.stdout, out.stderr[-2000:]


def test_what_is_not_stored_is_set_aside(spark, tmp_dir):
    q1, q2 = os.path.join(tmp_dir, "qf"), os.path.join(tmp_dir, "qe")
    tables = {k: os.path.join(tmp_dir, k) for k in ("feeds", "entries", "quarantine", "rejected", "enrichment")}
    link = "https://feed1.example.com"
    items = ITEM.format(g="a", link=link) + ITEM.format(g="b", link=link) + ITEM.format(g="a", link=link).replace("Entry a", "Entry a again") \
        + "<item><title>no id</title></item>"
    landed = spark.createDataFrame([(f"{link}/rss", RSS.format(title="Tech", link=link, items=items)),
                                    ("https://broken.example.com/rss", "<rss><channel>")], "feed_url string, xml string")
    _write(q1, "m.txt", [_msg(f"{link}/rss"), _msg("https://broken.example.com/rss"), _msg("https://nowhere.example.com/rss")])
    start_feed_ingest(spark, q1, landed, tables, q2, name="t_aside", now="2024-02-01 06:00:00").awaitTermination()
    assert {r.title for r in spark.read.parquet(tables["entries"]).collect()} == {"Entry a again", "Entry b"}   # the later item wins
    aside = {(r.kind, r.id) for r in spark.read.parquet(tables["quarantine"]).select("kind", "id").collect()}
    assert aside == {("document_missing", "https://nowhere.example.com/rss"), ("document_unparsable", "https://broken.example.com/rss"),
                     ("item_without_id", f"{link}/rss#3")}
