"""Scoring: retry, error policy, offline models, registry."""

import pytest
from pyspark.sql import functions as F

from rivulet.operators import enrich as E


class Flaky:
    """Fails the first ``fails`` calls, then upper-cases."""
    calls = 0

    def __init__(self, fails):
        self.fails = fails

    def __call__(self, texts):
        Flaky.calls += 1
        if Flaky.calls <= self.fails:
            raise RuntimeError("service down")
        return [t.upper() for t in texts]


def test_retry_call_counts():
    Flaky.calls = 0
    assert E.retry_call(Flaky(1), ["a"], retries=2, delay_ms=0, sleep=lambda s: None) == ["A"]
    assert Flaky.calls == 2
    Flaky.calls = 0
    with pytest.raises(RuntimeError):
        E.retry_call(Flaky(99), ["a"], retries=2, delay_ms=0, sleep=lambda s: None)
    assert Flaky.calls == 3  # 1 + retries
    waits = []
    Flaky.calls = 0
    with pytest.raises(RuntimeError):
        E.retry_call(Flaky(99), ["a"], retries=3, delay_ms=1000, backoff=2.0, sleep=waits.append)
    assert waits == [1.0, 2.0, 4.0]


def test_score_text_policies(spark):
    # factories are local so they are pickled by value for the workers
    def _upper_factory():
        return lambda texts: [t.upper() for t in texts]

    def _broken_factory():
        def predict(texts):
            raise RuntimeError("model unavailable")
        return predict

    df = spark.createDataFrame([("a",), ("b",)], "t string").repartition(2)
    ok = E.score_text(df, "t", _upper_factory, "u", retries=0, delay_ms=0)
    assert sorted(r.u for r in ok.collect()) == ["A", "B"]
    nul = E.score_text(df, "t", _broken_factory, "u", on_error="null", retries=1, delay_ms=0).collect()
    assert all(r.u is None and "model unavailable" in r.u_error for r in nul)
    dflt = E.score_text(df, "t", _broken_factory, "u", on_error="default", default="n/a", retries=0, delay_ms=0)
    assert {r.u for r in dflt.collect()} == {"n/a"}
    with pytest.raises(Exception, match="model unavailable"):
        E.score_text(df, "t", _broken_factory, "u", on_error="raise", retries=0, delay_ms=0).collect()


def test_lexicon_and_pipeline(spark):
    df = spark.createDataFrame([("A good day. Then more.",), ("bad and awful",), ("good but bad",), ("plain",)],
                               "summary string")
    s = [tuple(r) for r in df.select(E.lexicon_sentiment("summary").alias("s")).select("s.sentiment", "s.score").collect()]
    assert s == [("Positive", 1.0), ("Negative", -1.0), ("Mixed", 0.0), ("Neutral", 0.0)]
    out = E.enrich(df).collect()
    assert out[0].ai_summary == "A good day." and out[0].sentiment == "Positive"
    assert len(out[0].embedding) == 64 and abs(sum(x * x for x in out[0].embedding) - 1.0) < 1e-5


def test_registry():
    reg = E.ModelRegistry(summary=lambda: (lambda texts: texts))
    reg.require("summary")
    with pytest.raises(ValueError):
        reg.require("summary", "embedding")


def test_native_pipeline_has_no_python_eval(spark):
    df = spark.createDataFrame([("x",)], "summary string")
    plan = E.enrich(df, embed=False)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_offline_registry_roles(spark):
    reg = E.offline_registry()
    reg.require("MODEL_SUMMARY", "MODEL_RANKING", "EMBEDDING_FAST")
    df = spark.createDataFrame([("One two. Three",)], "t string")
    out = E.score_text(df, "t", reg["EMBEDDING_FAST"], "e", "array<float>", retries=0, delay_ms=0).first()
    assert len(out.e) == 64 and out.e_error is None
    s = E.score_text(df, "t", reg["MODEL_SUMMARY"], "s", retries=0, delay_ms=0).first()
    assert s.s == "One two."


def test_enrich_with_models(spark):
    def summary():
        return lambda texts: ["  " + t.split(".")[0] + ".  " for t in texts]

    def ranking():
        import json as _j
        return lambda texts: [_j.dumps({"sentiment": "Positive", "score": 0.5}) if "good" in t else "garbage"
                              for t in texts]

    reg = E.ModelRegistry(MODEL_SUMMARY=summary, MODEL_RANKING=ranking,
                          EMBEDDING_FAST=E.offline_registry()["EMBEDDING_FAST"])
    df = spark.createDataFrame([("A good day. More.",), ("Plain text. More.",)], "summary string")
    out = {r.ai_summary: r for r in E.enrich_with_models(df, reg, retries=0, delay_ms=0).collect()}
    assert out["A good day."].sentiment == "Positive" and out["A good day."].sentiment_score == 0.5
    assert (out["Plain text."].sentiment, out["Plain text."].sentiment_score) == ("Error", 0.0)
    assert len(out["Plain text."].embedding) == 64
    with pytest.raises(ValueError):
        E.enrich_with_models(df, E.ModelRegistry(MODEL_SUMMARY=summary))


def test_one_bad_row_of_five_gives_one_null(spark):
    def fussy():
        def predict(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("cannot read this")
            return [t.upper() for t in texts]
        return predict
    df = spark.createDataFrame([(t,) for t in ("a", "b", "bad", "c", "d")], "t string").coalesce(1)
    out = {r.t: (r.u, r.u_error) for r in E.score_text(df, "t", fussy, "u", retries=0, delay_ms=0).collect()}
    assert out == {"a": ("A", None), "b": ("B", None), "c": ("C", None), "d": ("D", None), "bad": (None, "RuntimeError: cannot read this")}


def test_offline_registry_runs_whole_enrichment(spark):
    df = spark.createDataFrame([("A good day. More.",), ("bad and awful",)], "summary string")
    for roles in ({}, {"summary_role": "MODEL_SUMMARY_LIGHT", "embedding_role": "EMBEDDING_DEEP"}):
        out = {r.ai_summary: r for r in E.enrich_with_models(df, E.offline_registry(), retries=0, delay_ms=0, **roles).collect()}
        assert (out["A good day."].sentiment, out["A good day."].sentiment_score) == ("Positive", 1.0)
        assert out["bad and awful"].sentiment == "Negative"
        assert len(out["A good day."].embedding) == (256 if roles else 64)


def test_prompts_and_token_limits_reach_chat_clients(spark):
    def echo():
        import json as _j

        class Client:
            chat = True

            def __call__(self, requests):
                return [_j.dumps(r) for r in requests]
        return Client()
    import json
    from rivulet import fixed
    df = spark.createDataFrame([("Some text.",)], "t string")
    r = json.loads(E.improve_summary(df, "t", echo, retries=0, delay_ms=0).first().ai_summary)
    assert r == {"messages": [{"role": "system", "content": fixed.SUMMARY_SYSTEM_PROMPT}, {"role": "user", "content": "Some text."}],
                 "max_tokens": fixed.SUMMARY_MAX_TOKENS}
    prompt = E.ChatPrompt(fixed.ENGAGEMENT_SYSTEM_PROMPT, fixed.ENGAGEMENT_USER_TEMPLATE)
    r = json.loads(E.score_text(df, "t", echo, "o", prompt=prompt, retries=0, delay_ms=0).first().o)
    assert "Some text." in r["messages"][1]["content"] and "{content_text}" not in r["messages"][1]["content"]


def test_whole_text_is_scored(spark):
    df = spark.createDataFrame([("A plain start. Then a good day.",)], "summary string")
    assert E.enrich(df).first().sentiment == "Positive"
