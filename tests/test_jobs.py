"""The user-level jobs end to end on small fixtures."""

import json
import os

from pyspark.sql import functions as F

from rivulet import fixed
from rivulet.plans.jobs import frame_job, publish_job
from test_streaming import _landed


def test_frame_job(spark, tmp_dir):
    cfg = os.path.join(tmp_dir, "feeds.json")
    with open(cfg, "w") as f:
        json.dump({"feeds": ["https://feed1.example.com/rss", "https://feed2.example.com/rss"]}, f)
    path = os.path.join(tmp_dir, "frame")
    frame_job(spark, cfg, _landed(spark), path)
    t = spark.read.parquet(path)
    assert t.count() == 10 and t.select("PartitionKey").distinct().first()[0] == "2025-02"
    assert t.filter(F.col("Sentiment") == "Positive").count() == 10
    frame_job(spark, cfg, _landed(spark), path)          # rerun: same rows
    assert spark.read.parquet(path).count() == 10


def test_publish_job(spark, tmp_dir):
    items = spark.createDataFrame([("1", "T1", "https://x.org/1"), ("2", "T2", "https://x.org/2")],
                                  "id string, title string, link string")
    meta = spark.createDataFrame([(c, c if c == "Title" else f"field_{i}") for i, c in enumerate(fixed.LIST_COLUMNS)],
                                 "display_name string, name string")
    lp = os.path.join(tmp_dir, "list")
    out = publish_job(items, lp, meta, fixed.LIST_SCHEMA, os.path.join(tmp_dir, "bad"))
    # Published_Date is absent → default text, so the rows are valid and appended
    assert out == 2 and "field_3" in spark.read.parquet(lp).columns
    more = items.union(spark.createDataFrame([("3", "T3", "https://x.org/3")], items.schema))
    assert publish_job(more, lp, meta, fixed.LIST_SCHEMA) == 1   # only the new row
    assert spark.read.parquet(lp).count() == 3


def test_frame_job_with_model_registry(spark, tmp_dir):
    from rivulet.operators.enrich import ModelRegistry, offline_registry

    def ranking():
        import json as _j
        return lambda texts: [_j.dumps({"sentiment": "Mixed", "score": 0.1}) for _ in texts]

    reg = ModelRegistry(MODEL_SUMMARY=offline_registry()["MODEL_SUMMARY"], MODEL_RANKING=ranking,
                        EMBEDDING_FAST=offline_registry()["EMBEDDING_FAST"])
    cfg = os.path.join(tmp_dir, "feeds.json")
    with open(cfg, "w") as f:
        json.dump({"feeds": ["https://feed2.example.com/rss"]}, f)
    path = os.path.join(tmp_dir, "frame")
    frame_job(spark, cfg, _landed(spark), path, registry=reg)
    t = spark.read.parquet(path)
    assert t.count() == 5 and {r.Sentiment for r in t.collect()} == {"Mixed"}
    assert all(len(json.loads(r.Embedding)) == 64 for r in t.collect())
