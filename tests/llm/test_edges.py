"""Every operator on odd rows and on empty tables, and the defined result of each case."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import decontaminate, html_text, language, licenses, mixing, neighbours, ngram_lm, pii, simhash, url_filter
from rivulet.llm.common import read, sampled

from .conftest import LONG, TEXTS

N = len(TEXTS)


def ids(df, c="doc_id"):
    return sorted((r[c] for r in df.select(c).collect()), key=lambda x: (x is None, x))


ALL_IDS = sorted((t[0] for t in TEXTS), key=lambda x: (x is None, x))


def test_simhash_rows(odd):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == N
    by = {}
    for r in out:
        by.setdefault(r["id"], set()).add((r["fp"], r["component"]))
    assert by[1] == by[2] and next(iter(by[1]))[1] == 1                # exact copies
    assert {next(iter(by[i])) for i in (3, 4, 5)} == {(0, 3)}          # null, empty and blank: fingerprint zero
    assert next(iter(by[None]))[1] is None                             # no id reachable


def test_simhash_deduplicate_repeated_and_null_ids(odd):
    out = simhash.deduplicate(odd)
    assert out.columns == odd.columns
    assert ids(out) == [1, 3, 6, 7, 8, 9, None]


def test_simhash_deduplicate_plain(odd):
    plain = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert ids(simhash.deduplicate(plain)) == [1, 3, 6, 7, 8, 9]


def test_simhash_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.deduplicate(nothing).collect() == []


def test_decontaminate_rows(spark, odd, nothing):
    items = spark.createDataFrame([(10, "fox jumps over the LAZY dog near the old river bank"), (11, None), (12, ""), (13, "Deutsch und"),
                                   (None, "row without"), (14, "nowhere to be found at all in these few lines of text")], "item_id long, text string")
    out = {}
    for r in decontaminate.contamination(odd, items).collect():
        out.setdefault(r["id"], []).append((r["n_words"], r["n_hit"], r["items"]))
    assert sum(map(len, out.values())) == N
    assert out[1] == [(15, 11, [10])] * 2 and out[2] == [(15, 11, [10])]
    assert out[3] == out[4] == out[5] == [(0, 0, [])]
    assert out[8][0][1:] == (2, [13])
    assert out[None][0][1:] == (0, [])           # an item without an id is skipped
    assert ids(decontaminate.clean(odd, items)) == [3, 4, 5, 6, 7, 9, None]
    assert decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.contamination(odd, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(nothing, items).count() == 0


def test_pii_rows(odd, nothing):
    red = pii.learn(odd)
    out = {r["doc_id"]: r for r in pii.digest(odd, red).collect()}
    assert len(pii.digest(odd, red).collect()) == N
    r = out[7]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert r["spans"] == "email:10:38,phone:42:59,card:67:86,ip:93:103"
    assert out[3]["spans"] == "" and out[3]["n_email"] == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redact(odd, red).collect()}
    assert clean[7] == "Écrivez à [EMAIL] ou [PHONE], carte [CARD], hôte [IP]."
    assert clean[3] is None and clean[6] == LONG
    assert pii.redact(odd, red).columns == odd.columns
    empty = pii.learn(nothing)
    assert pii.digest(nothing, empty).count() == 0


def test_mixing_rows(odd, nothing):
    out = mixing.mix(odd, entropy_share=0.5)
    assert set(out.columns) == {"doc_id", "source", "n_tokens", "weight", "epoch", "block", "block_key", "doc_key"}
    got = {r["doc_id"] for r in out.collect()}
    assert not got & {3, 4, 5}                    # no tokens: never taken
    assert None in {r["source"] for r in out.collect()}
    assert mixing.mix(nothing).count() == 0


def test_language_rows(odd, nothing):
    kw = dict(declared=F.col("lang"), host=F.col("source"), label_col="lang")
    out = {r["doc_id"]: r for r in language.identify(odd, **kw).collect()}
    assert language.identify(odd, **kw).count() == N
    assert not any(out[i]["__keep"] for i in (3, 4, 5, 9)) and out[3]["__language"] is None
    assert out[1]["__keep"] and out[1]["__language"] == "en"
    assert language.accept(odd, **kw).columns == odd.columns
    assert language.identify(nothing, **kw).count() == 0
    unlabelled = language.identify(odd.withColumn("lang", F.lit(None).cast("string")), **kw)
    assert unlabelled.where("__keep").count() == 0 and unlabelled.count() == N


def test_lm_rows(odd, nothing):
    model = ngram_lm.fit(odd, where=ngram_lm.in_training(F.col("doc_id")), shard_tokens=5_000)
    out = ngram_lm.score(odd, model).collect()
    assert ids(ngram_lm.score(odd, model)) == ALL_IDS
    by = {r["doc_id"]: r for r in out}
    assert by[3]["n_tokens"] == by[4]["n_tokens"] == 1                 # the end
    assert by[6]["n_tokens"] == len(LONG.split()) + 1
    none = ngram_lm.fit(nothing)
    assert none.tokens == 0 and ngram_lm.score(nothing, none).count() == 0
    assert {r["n_known"] for r in ngram_lm.score(odd, none).collect()} == {0}


def test_license_rows(odd, nothing):
    assert licenses.scan(odd).count() == N
    assert licenses.scan(odd).where("best is not null or score > 0 or size(licences) > 0").count() == 0
    assert licenses.scan(nothing).count() == 0


PAGES = [(1, "https://A.Example.net/en/x?y#z", "<p>Some text.</p>"), (1, "https://A.Example.net/en/x?y#z", "<p>Some text.</p>"), (2, None, None), (3, "no scheme", ""),
         (4, "http://x.cheap-pills.example.com", "<article><p>a &lt;b&gt;<!-- c"), (None, "://", "<" * 50_000), (5, "http://" + "a." * 30_000 + "net/", "<div>" * 20_000 + "deep")]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return df.select("*", *[F.lit("clash").alias(c) for c in ("host", "path", "key", "u", "h", "id", "text", "rule", "verdict")])


RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def test_url_rows(pages):
    listed = lambda u: u.where("key like 'cheap-pills.%'")
    out = url_filter.judge_urls(pages, listed, RULES)
    assert out.count() == len(PAGES)
    by = {r["page_id"]: r for r in out.collect()}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (by[2]["host"], by[2]["path"], by[2]["rule"], by[2]["verdict"]) == ("", "", None, "allow")
    assert (by[3]["host"], by[3]["verdict"]) == ("", "allow")
    assert (by[4]["path"], by[4]["rule"], by[4]["verdict"], by[4]["listed_key"]) == ("", None, "block", "cheap-pills.example.com")
    assert by[5]["rule"] == "net/" and by[None]["host"] == ""
    assert url_filter.judge_urls(pages.limit(0), listed, RULES).count() == 0
    joined = url_filter.judge_urls(pages, listed, RULES, max_bytes=0)         # beyond the size bound: by join
    assert sorted(map(str, joined.collect())) == sorted(map(str, out.collect()))


def test_html_rows(pages):
    trees = html_text.learn(pages)
    out = html_text.extract(pages, trees=trees)
    assert out.count() == len(PAGES)
    by = {r["page_id"]: r for r in out.collect()}
    assert by[2]["text"] == by[3]["text"] == "" and by[2]["n_chars"] == 0
    assert by[4]["text"] == "a <b>"
    assert html_text.extract(pages.limit(0), trees=trees).count() == 0


def test_neighbour_rows(spark):
    rows = [(i, [float(i), 1.0, 0.5]) for i in range(1, 30)] + [(5, [5.0, 1.0, 0.5]), (40, None), (41, [0.0, 0.0, 0.0]), (42, [1.0, None, 2.0]),
                                                                (43, [1.0, float("nan"), 2.0]), (44, [1.0, float("inf"), 0.0]), (45, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).withColumn("o", F.lit(1))
    out = neighbours.search(df, F.col("vec_id") % 10 == 0, k=4).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {10: [(9, 1.0), (11, 1.0), (8, 2.0), (12, 2.0)], 20: [(19, 1.0), (21, 1.0), (18, 2.0), (22, 2.0)]}   # ties to the smaller id
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0
    few = neighbours.search(df.where("vec_id in (1, 2, 3)"), F.col("vec_id") == 1, k=10).collect()
    assert [r["vec_id"] for r in sorted(few, key=lambda r: r["rank"])] == [2, 3]


def test_neighbour_windows_grow_with_the_rows_and_pass_copies(spark):
    """Recall holds at several sizes, inside a hot cluster, and beside many copies of one vector; of copies the smallest ids count."""
    rng = np.random.default_rng(4)
    hot = rng.standard_normal(16)
    for n in (1000, 8000):
        x = rng.standard_normal((n, 16))
        x[:n // 4] = hot + 0.01 * rng.standard_normal((n // 4, 16))            # a cluster within one cell
        x[n // 4:n // 2] = hot                                                # copies
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
        got = {}
        for r in neighbours.search(df, F.col("vec_id") % 100 == 7, half_window=20).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        parts = {"cluster": (0, n // 4), "copies": (n // 4, n // 2), "others": (n // 2, n)}
        for part, (lo, hi) in parts.items():
            hit = total = 0
            for q in range(7, n, 100):
                if lo <= q < hi:
                    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
                    best = [i for i in np.lexsort((np.arange(n), d)) if i != q][:10]
                    hit, total = hit + len(set(best) & set(got[q])), total + 10
                    assert len(got[q]) == 10
            assert hit / total >= (1.0 if part == "copies" else 0.9), (n, part, hit / total)


def test_clean_goes_by_row(spark):
    """A contaminated row takes no other row of a null or repeated id with it, with a bitmap that tells words apart or hardly any."""
    leak = "fox jumps over the lazy dog near the old river bank"
    rows = [(None, f"so {leak}"), (None, "a clean text without id"), (7, leak), (7, "a clean text of a repeated id"), (8, "clean"), (9, "nowhere to be found"),
            (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, leak), (2, "nowhere to be found")], "item_id long, text string")
    for bits in (decontaminate.BITS, 1):
        out = decontaminate.clean(docs, items, bits=bits).collect()
        assert sorted(map(str, map(tuple, out))) == sorted(str(rows[i]) for i in (1, 3, 4, 6))


def test_simhash_deduplicate_id_repeated_in_another_component(spark):
    same = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [(5, "one text about ships and harbours that nothing else here is like at all"), (5, same), (1, same)]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == sorted((rows[0], rows[2]))


def test_language_counts_more_labels_than_are_held(spark):
    """Every label gets its language, with the counts of all its rows."""
    word = lambda i: chr(97 + i // 10) * 2 + chr(107 + i % 10) * 2 + chr(97 + i % 7)
    rows = [(j * 100 + i, " ".join([word(i)] * 12), f"l{i:03d}") for j in range(3) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    model = language.learn_text(df, "text", "lang", "doc_id")
    assert model.languages == [f"l{i:03d}" for i in range(100)]
    out = language.identify(df, model=model)
    assert out.where("lang = __language").count() == len(rows)


def test_pii_thresholds_cover_all_documents(spark):
    """A kind too rare in the sample for a threshold gets one from the whole table."""
    rows = [(i, f"paid by card 4111 1111 1111 1111 today, item x{i}a1234567890b") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.learn(df, sample_docs=40).thresholds


def without_ids(spark, docs, kind):
    ids = {"null": F.lit(None).cast("long"), "same": F.lit(7).cast("long")}
    return docs.withColumn("doc_id" if "doc_id" in docs.columns else "page_id", ids[kind])


@pytest.mark.parametrize("kind", ["null", "same"])
def test_samples_do_not_hang_on_ids(spark, kind):
    """Above the bound, rows without ids or of one id still give a sample of about its size, and nothing is lost."""
    docs = without_ids(spark, read(spark, "/root/testdata/sf0.01", "documents"), kind)
    part = docs.select("doc_id", "text")
    assert 40 < sampled(part, 100, "x").count() < 200
    model = language.learn_text(docs, "text", "lang", "doc_id", sample_docs=100)
    assert len(model.languages) == 4
    assert language.accept(docs, declared=F.col("lang"), host=F.col("source"), label_col="lang", sample_docs=100).count() > 900
    assert pii.learn(docs, sample_docs=200).margin is not None
    pages = without_ids(spark, read(spark, "/root/testdata/sf0.01", "pages"), kind)
    trees = html_text.learn(pages, sample_pages=50)
    assert html_text.extract(pages, trees=trees).where("n_chars > 0").count() == pages.count()


def test_samples_of_repeated_rows(spark):
    """Equal rows are one row of the sample; few distinct rows are all taken; a bound far below the rows still takes some."""
    df = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 10).alias("doc_id"), F.lit("t").alias("text"))
    assert sampled(df, 20, "x").count() == 10
    assert 0 < sampled(spark.range(3_000_000).toDF("id"), 5, "x").count() < 30
    assert sampled(df.limit(0), 20, "x").count() == 0


def test_decontamination_by_other_ids(spark):
    """Item and document ids of any type; equal windows of several items; overlapping and repeated hits."""
    leak = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([("x", f"a {leak} b {leak}"), ("y", "Seven, eight! NINE"), (None, leak), ("x", None)], "doc_id string, text string")
    items = spark.createDataFrame([("q-10", leak), ("q-9", leak.upper()), ("short", "eight nine"), ("none", "...")], "item_id string, text string")
    got = sorted(((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, items).collect()), key=str)
    assert got == sorted([("x", 24, 22, ["q-10", "q-9", "short"]), ("y", 3, 2, ["short"]), (None, 11, 11, ["q-10", "q-9", "short"]), ("x", 0, 0, [])], key=str)


def test_pii_written_addresses_and_local_numbers_are_added(spark):
    """What the generators are for: signs written out, and numbers without a plus beside one with it or behind a word."""
    rows = []
    for i in range(400):
        name = "".join(chr(97 + (i * k + 3 * k) % 26) for k in (1, 3, 5, 7))
        at, dot = (("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("@", "."))[i % 4]
        rows.append((i, f"please write to {name}{at}mail{dot}example{dot}org about item number {i} of the list"))
        rows.append((1000 + i, f"reach us under +49 30 55{i:04d}1 or 030 77{i:05d} until noon"))
        rows.append((2000 + i, f"tel. 089 {3000000 + i * 7} or come by"))
        rows.append((3000 + i, f"order {70000000 + i * 31} was shipped in {i} boxes to aisle {i % 9}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in pii.digest(df, pii.learn(df)).collect()}
    found = lambda lo, kind, n: sum(out[i].count(kind) >= n for i in range(lo, lo + 400))
    assert found(0, "email", 1) >= 380 and found(1000, "phone", 2) >= 380 and found(2000, "phone", 1) >= 380
    assert not any(out[i] for i in range(3000, 3400))


def test_host_prior_counts_once_without_a_zone(spark):
    """A host of one label is smoothed by all rows; hosts below a zone by the zone."""
    counts = spark.createDataFrame([("a", 0, 10), ("b.x", 1, 30), ("c.x", 0, 2)], "host string, best int, n long")
    lp = {r["host"]: r["lp"] for r in language._host_priors(counts, 2).collect()}
    world = [(12 + language.SMOOTH) / (42 + 2 * language.SMOOTH), (30 + language.SMOOTH) / (42 + 2 * language.SMOOTH)]
    k = language.HOST_STRENGTH
    assert np.allclose(lp["a"], [np.log((10 + k * world[0]) / (10 + k)), np.log(k * world[1] / (10 + k))])
    zone = [(2 + k * world[0]) / (32 + k), (30 + k * world[1]) / (32 + k)]
    assert np.allclose(lp["c.x"], [np.log((2 + k * zone[0]) / (2 + k)), np.log(k * zone[1] / (2 + k))])


def test_one_wrong_label_does_not_decide(spark):
    """The declared language of a row is weighed against its text, even though other rows' labels teach the text model."""
    docs = read(spark, "/root/testdata/sf0.01", "documents").where("length(text) > 400").select("doc_id", "text", "lang", "source")
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 50 == 3, F.when(F.col("lang") == "en", "fr").otherwise("en")).otherwise(F.col("lang")))
    got = {r["doc_id"]: r["__language"] for r in language.identify(wrong, declared=F.col("lang"), host=F.col("source"), label_col="lang").collect()}
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    changed = [i for i in true if i % 50 == 3]
    assert len(changed) > 5 and all(got[i] == true[i] for i in changed)
