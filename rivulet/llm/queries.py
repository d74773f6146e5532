"""Registered queries of this subpackage: each applies one operator, with its
production parameters, to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, html_text, language, licenses, mixing, neighbours, ngram_lm, pii, simhash, substrings, token_alignment, url_filter,
               vector_codes)
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Fixed values of the URL filter's query: rules, and the names whose domains are listed.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def listed_domains(universe: DataFrame) -> DataFrame:
    """The list: every domain of the corpus whose own name is a listed one."""
    return universe.where(F.split_part("key", F.lit("."), F.lit(1)).isin(*LISTED_NAMES))


@query
def op1_url_filter(spark, sf_dir):
    """Every page's url: host, path, rule and verdict."""
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), listed_domains, URL_RULES)


@query
def op2_pii(spark, sf_dir):
    """Every document: base spans counted and digested, all spans."""
    docs = read(spark, sf_dir, "documents")
    return pii.digest(docs, pii.learn(docs))


@query
def op3_neighbours(spark, sf_dir):
    """The 10 nearest of every 100th vector."""
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op4_html_text(spark, sf_dir):
    """Every page's main text."""
    return html_text.extract(read(spark, sf_dir, "pages"))


@query
def op5_simhash(spark, sf_dir):
    """Every document's fingerprint and component."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query
def op6_ngram_lm(spark, sf_dir):
    """Every document's score under a model of the training documents."""
    docs = read(spark, sf_dir, "documents")
    training = ngram_lm.in_training(F.col("doc_id"))
    model = ngram_lm.fit(docs, where=training)
    return (ngram_lm.score(docs, model)
            .select("doc_id", (~ngram_lm.in_training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known",
                    F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"))


@query
def op7_licenses(spark, sf_dir):
    """Every document's licences."""
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), "best", "score", "n_units")


@query
def op8_mixing(spark, sf_dir):
    """The documents taken for training, per epoch, with their places in the order."""
    return mixing.mix(read(spark, sf_dir, "documents"))


@query
def op9_decontamination(spark, sf_dir):
    """Every document's words inside windows of benchmark items."""
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op10_language_id(spark, sf_dir):
    """Every document's language, from its text, its declared language and its source's prior."""
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs, declared=F.col("lang"), host=F.col("source"), label_col="lang")
    return found.select("doc_id", F.col("lang").alias("declared"), "source", F.col("__language").alias("language"),
                        F.col("__posterior").alias("posterior"), F.col("__keep").alias("keep"))


@query
def op11_vector_codes(spark, sf_dir):
    """Every usable vector's code, its error and the error of its label's vectors."""
    codes, books = vector_codes.compress(read(spark, sf_dir, "embeddings"), carry=["label"])
    code = F.array_join(F.transform("codes", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    digest = hashlib.sha256((books.text() if books else "").encode()).hexdigest()
    return vector_codes.error_by(codes, "label").select(F.col("id").alias("vec_id"), code.alias("code"), "error",
                                                        F.col("key_error").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


@query
def op12_substring_dedup(spark, sf_dir):
    """Every document's words, those removed as repeats of a smaller doc_id, and a digest of those that stay."""
    found = substrings.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_token_alignment(spark, sf_dir):
    """Every document's tokens, groups and links under both tokenizers."""
    found = token_alignment.statistics(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        F.col("groups").alias("groups_sha256"))


@query
def page_language_id(spark, sf_dir):
    """Every page's language, from its text, markup language, address suffix and host prior;
    the text model comes from the documents."""
    docs = read(spark, sf_dir, "documents")
    model = language.learn_text(docs, "text", "lang", "doc_id")
    pages = read(spark, sf_dir, "pages")
    host, path = url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url"))
    rows = pages.select("page_id", language.visible_text(F.col("html")).alias("t"), language.markup_language(F.col("html")).alias("markup"),
                        host.alias("host"), language.address_suffix(host, path).alias("suffix"))
    found = language.identify(rows, text_col="t", declared=F.col("markup"), suffix=F.col("suffix"),
                              host=F.when(F.col("host") != "", F.col("host")), id_col="page_id", model=model)
    return found.select("page_id", "host", "markup", "suffix", F.col("__language").alias("language"),
                        F.col("__posterior").alias("posterior"), F.col("__keep").alias("keep"))
