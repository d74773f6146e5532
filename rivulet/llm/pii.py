r"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

Base spans follow fixed patterns with their checks (octets, Luhn, digit counts).
Generators propose further, overlapping candidates: addresses written with
``(at)``/``(dot)`` and digit groups with any separators, each as every kind that
its digit count allows.  Gradient-boosted trees see a candidate's format
(lengths, separators, groups, neighbouring characters) and context (cue words
before it, digits around it), not the base checks.  They learn from candidates
of a bounded sample of documents.  Labels do not hang on the shape that the base
patterns ask for: a candidate is one of its kind if it is a base span, if its ``(at)``
and ``(dot)`` read as signs make an address, or if it is a number that a cue word or
another, international number introduces.  Over the candidates of all documents, but for those learnt
from, each kind gets the lowest threshold of an even chance or more whose precision
reaches ``precision``; candidates above it that touch no base span are added.  Base
spans always stay.

All work is DataFrame functions and Spark's own tree learner; the learnt trees
are compiled to CASE expressions.

Patterns are written with possessive quantifiers and a look-behind (or ``\G``)
so that a start inside a long run is refused at once: the same leftmost matches,
in linear time and without recursion.

Defined cases: null text is the empty text; offsets are code points, end
exclusive; repeated rows give repeated results; with no candidate, or all of one
label, nothing is added; an empty table gives no rows; extra columns are kept by
``redact`` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_sample, stored
from .trees import export

# --- fixed values: kinds in their order, base patterns and limits ---
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
OCTET = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))$"

# --- generators ---
WRITTEN_EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|[(\[]\x20?(?:at|AT)\x20?[)\]])\x20?[A-Za-z0-9-]++"
                 r"(?:\x20?(?:\.|[(\[]\x20?(?:dot|DOT)\x20?[)\]])\x20?[A-Za-z0-9-]++)++")
DIGIT_GROUPS = r"[+(]?[0-9](?:[\x20().-]{0,2}+[0-9])++"
GENERATORS = {"written": WRITTEN_EMAIL, "digits": DIGIT_GROUPS}
ADDRESS = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"
#: What introduces a number: a word for it, or another number and a few characters between.
INTRODUCED = (r"(?i)(?:\b(?:tele)?(?:phone|fax)|\b(?:tel|call|mobile|cell)\b)[^0-9\p{L}+]{0,4}$"
              r"|\+[0-9][\x20().0-9-]{5,}[0-9][^0-9+(]{1,6}$")
CUES = {"cue_mail": "(?i)mail|contact|write", "cue_ip": r"(?i)\bip\b|host|server|address",
        "cue_card": "(?i)card|visa|credit|account", "cue_phone": "(?i)phone|tel|call|fax|mobile"}
CONTEXT = 24

SAMPLE_DOCS = 20_000
TREES = 10
DEPTH = 3
PRECISION = 0.98
MIN_SUPPORT = 20
HOLD_OUT = 3   # of 10 folds


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    d = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int"))
                    .otherwise(F.when(x.cast("int") * 2 > 9, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2))),
        F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def base_check(kind: str, m: Column) -> Column:
    n = F.length(digits_of(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(OCTET))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits_of(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _cheap_guard(name: str, text: Column) -> Column:
    """A literal that every match holds, to skip the pattern on most texts."""
    if name == "email":
        return F.contains(text, F.lit("@"))
    if name == "phone":
        return F.contains(text, F.lit("+"))
    if name == "written":
        return F.contains(text, F.lit("@")) | F.contains(text, F.lit("(")) | F.contains(text, F.lit("["))
    return F.lit(True)


def _located(text: Column, hits: Column, pattern: str, keep) -> Column:
    """The kept hits as (start, end, match): the gaps between hits, from
    splitting by the same pattern, give each hit's place."""
    step = lambda acc, x: F.struct(
        (acc["at"] + x["g"] + F.length(x["m"])).alias("at"),
        F.when(keep(x["m"]), F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + F.length(x["m"])).alias("e"), x["m"].alias("m")))))
        .otherwise(acc["out"]).alias("out"))
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), F.length)
    pairs = F.zip_with(gaps, hits, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step,
                                                lambda acc: acc["out"])).otherwise(empty)


def _matches(rows: DataFrame, patterns: dict[str, str], check) -> DataFrame:
    """Adds an array of (s, e, m) per pattern to rows with ``__text``."""
    text = F.col("__text")
    rows = rows.select("*", *[
        F.when(_cheap_guard(k, text), F.regexp_extract_all(text, F.lit(p), F.lit(0)))
        .otherwise(F.array().cast("array<string>")).alias(f"__h_{k}") for k, p in patterns.items()])
    return rows.select(*[c for c in rows.columns if not c.startswith("__h_")], *[
        _located(text, F.col(f"__h_{k}"), p, lambda m, k=k: check(k, m)).alias(f"__m_{k}") for k, p in patterns.items()])


def _base_spans() -> Column:
    """(s, k, e) of all base spans, by start, then kind."""
    def of(i: int, k: str) -> Column:
        return F.transform(F.col(f"__m_{k}"), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))

    return F.array_sort(F.concat(*[of(i, k) for i, k in enumerate(KINDS)]))


def _candidates() -> Column:
    """Candidates (s, e, k, m, pre, post): every generated span as each kind its digits allow."""
    text = F.col("__text")
    around = lambda x, k: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k"), x["m"].alias("m"),
        F.substring(text, F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT))).alias("pre"),
        F.substring(text, x["e"] + 1, F.lit(CONTEXT)).alias("post"))
    digits = F.col("__m_digits")
    n = lambda x: F.length(digits_of(x["m"]))
    dots = lambda x: F.length(F.regexp_replace(x["m"], r"[^.]", ""))
    return F.concat(
        F.transform(F.col("__m_written"), lambda x: around(x, 0)),
        F.transform(F.filter(digits, lambda x: dots(x) >= 3), lambda x: around(x, 1)),
        F.transform(F.filter(digits, lambda x: n(x).between(12, 19)), lambda x: around(x, 2)),
        F.transform(F.filter(digits, lambda x: n(x).between(7, 15)), lambda x: around(x, 3)))


def _features(c: Column) -> dict[str, Column]:
    """Format and context of a candidate, as numbers."""
    m, pre, post = c["m"], c["pre"], c["post"]
    count = lambda cls: F.length(F.regexp_replace(m, f"[^{cls}]", ""))
    out = {"kind": c["k"], "length": F.length(m), "digits": count("0-9"), "letters": count("A-Za-z"), "spaces": count(r"\x20"),
           "dashes": count("-"), "dots": count("."), "parens": count("()"), "plus": m.startswith("+"),
           "at": F.contains(m, F.lit("@")), "groups": F.size(F.split(m, "[^0-9]+")),
           "first_group": F.length(F.regexp_extract(m, "^[^0-9]*([0-9]*)", 1)),
           "last_group": F.length(F.regexp_extract(m, "([0-9]*)[^0-9]*$", 1)),
           "glued_before": pre.rlike(r"[\p{L}0-9_=#/.-]$"), "glued_after": post.rlike(r"^[\p{L}0-9_=#/@-]"),
           "digits_around": F.length(digits_of(F.concat(pre, post))), "plus_before": F.contains(pre, F.lit("+")),
           "introduced": pre.rlike(INTRODUCED), "signs_written": m.rlike(r"(?i)[(\[]\x20?(?:at|dot)\x20?[)\]]")}
    out |= {k: pre.rlike(p) for k, p in CUES.items()}
    return {k: v.cast("double") for k, v in out.items()}


def _with_matches(docs: DataFrame, text_col: str) -> DataFrame:
    rows = docs.withColumn("__text", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = _matches(rows, BASE, base_check)
    rows = _matches(rows, GENERATORS, lambda k, m: F.length(m) >= 6)
    return rows.select("*", _base_spans().alias("__base"), _candidates().alias("__cand"))


def _tree(tree: tuple, features: list[str], cols: dict[str, Column]) -> Column:
    if len(tree) == 1:
        return F.lit(tree[0])
    at, threshold, left, right = tree
    return F.when(cols[features[at]] <= threshold, _tree(left, features, cols)).otherwise(_tree(right, features, cols))


def _signs(m: Column) -> Column:
    """An address with (at), [dot] and spaces around signs as it is meant."""
    for word, sign in (("at", "@"), ("dot", ".")):
        m = F.regexp_replace(m, rf"(?i)\x20?[(\[]\x20?{word}\x20?[)\]]\x20?", sign)
    return F.regexp_replace(m, r"\x20?([@.])\x20?", "$1")


def _is_one(c: Column) -> Column:
    """Labels beside the base spans."""
    return F.when(c["k"] == 0, _signs(c["m"]).rlike(ADDRESS)).when(c["k"] == 3, c["pre"].rlike(INTRODUCED)).otherwise(False)


class Redactor:
    """The compiled trees and the threshold of each kind that has one."""

    def __init__(self, margin=None, thresholds: dict[int, float] | None = None):
        self.margin, self.thresholds = margin, thresholds or {}

    def selects(self, cand: Column) -> Column:
        if self.margin is None or not self.thresholds:
            return F.lit(False)
        floor = F.lit(None).cast("double")
        for k, t in self.thresholds.items():
            floor = F.when(cand["k"] == k, F.lit(t)).otherwise(floor)
        return F.coalesce(self.margin(cand) >= floor, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
          precision: float = PRECISION) -> Redactor:
    """Trees from the candidates of about ``sample_docs`` of the distinct documents (id and
    text), chosen by a hash of both; thresholds from all other candidates of all documents."""
    part = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    part = part.select("*", in_sample(part, sample_docs, "pii").alias("sampled"))
    is_base = F.exists("__base", lambda b: (b["k"] == F.col("c")["k"]) & (b["s"] >= F.col("c")["s"]) & (b["e"] <= F.col("c")["e"])
                       & (b["e"] - b["s"] >= F.col("c")["e"] - F.col("c")["s"] - 1))
    feats = _features(F.col("c"))
    names = list(feats)
    learnt = F.coalesce(F.col("sampled"), F.lit(False)) & (F.pmod(F.xxhash64("id", F.col("c")["s"], F.lit("fold")), F.lit(10)) >= HOLD_OUT)

    def labelled(some: DataFrame) -> DataFrame:
        rows = _with_matches(some, "text").select("id", "sampled", "__base", F.explode("__cand").alias("c"))
        return rows.select("c", (is_base | _is_one(F.col("c"))).cast("double").alias("label"), learnt.alias("learnt"))

    fit = stored(labelled(part.where("sampled").distinct()).where("learnt").select("label", *[v.alias(k) for k, v in feats.items()]).repartition(4), "pii-sample")
    fit = VectorAssembler(inputCols=names, outputCol="features").transform(fit)
    if fit.select("label").distinct().count() < 2:
        return Redactor()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(fit)
    roots = [export(t) for t in model.trees]

    def margin(cand: Column) -> Column:
        cols = _features(cand)
        return sum((F.lit(w) * _tree(r, names, cols) for w, r in zip(model.treeWeights, roots)), F.lit(0.0))

    scored = labelled(part).where(~F.col("learnt")).select(F.col("c")["k"].alias("kind"), "label", margin(F.col("c")).alias("score"))
    # one row per kind and distinct score (few: a sum of TREES leaves); precision of all at or above it
    steps = scored.where("score > 0").groupBy("kind", "score").agg(F.sum("label").alias("good"), F.count("*").alias("n"))
    found, above = {}, {}
    for r in sorted(steps.collect(), key=lambda r: -r["score"]):
        good, n = above.get(r["kind"], (0, 0))
        above[r["kind"]] = good, n = good + r["good"], n + r["n"]
        if n >= MIN_SUPPORT and good >= precision * n:
            found[r["kind"]] = r["score"]
    return Redactor(margin, found)


def find_spans(docs: DataFrame, redactor: Redactor, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``__base`` and ``__spans``: (s, k, e) of the base
    spans and of all spans, by start, then kind."""
    rows = _with_matches(docs, text_col)
    clear = lambda c: ~F.exists("__base", lambda b: (b["s"] < c["e"]) & (b["e"] > c["s"]))
    added = F.transform(F.filter("__cand", lambda c: redactor.selects(c) & clear(c)),
                        lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], "__base",
                       F.when(F.size("__cand") > 0, F.array_sort(F.concat("__base", added))).otherwise(F.col("__base")).alias("__spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame, redactor: Redactor, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, base spans per kind, digest of the base spans, all spans."""
    part = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    rows = find_spans(part, redactor, text_col)
    count = lambda i: F.size(F.filter("__base", lambda x: x["k"] == i)).cast("bigint")
    return rows.select(id_col, *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                       F.sha2(spans_text(F.col("__base")), 256).alias("base_sha256"),
                       spans_text(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame, redactor: Redactor, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (overlapping
    spans become one, named after the first); null texts stay null."""
    rows = find_spans(docs, redactor, text_col)
    kinds = F.array(*[F.lit(k.upper()) for k in KINDS])
    text = F.col(f"`{text_col}`")
    state = "struct<at:int,out:array<string>>"
    step = lambda a, x: F.when(x["s"] >= a["at"], F.struct(
        x["e"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, x["s"] - a["at"]),
                                                       F.concat(F.lit("["), F.get(kinds, x["k"]), F.lit("]")))).alias("out"))
    ).otherwise(F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out")))
    pieces = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(state), step,
                         lambda a: F.concat_ws("", F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, F.length(text))))))
    clean = F.when((F.size("__spans") > 0) & text.isNotNull(), pieces).otherwise(text)
    out = [clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    rows = rows.select(*out)
    if length_col in docs.columns:
        rows = rows.withColumn(length_col, F.coalesce(F.length(text), F.lit(0)).cast(docs.schema[length_col].dataType))
    return rows
