"""Row validation: every rule is a native Column predicate.

``validate(df, rules)`` adds ``violations array<string>`` (names of the
rules a row breaks); ``split_valid`` returns the good rows and the
quarantine.  Nothing is dropped silently: every row lands on one side.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed


# Each rule refers to its column once, so Catalyst never has to copy an
# expensive column expression (a cleaned summary) into several places.

def _len_outside(c: Column, lo: int | None, hi: int | None, nullable: bool = True) -> Column:
    n = F.length(c)
    if lo is not None and hi is not None:
        bad = ~n.between(lo, hi)
    elif lo is not None:
        bad = n < lo
    elif hi is not None:
        bad = n > hi
    else:
        bad = F.lit(False) & n.isNotNull()
    return F.coalesce(bad, F.lit(not nullable))


def _range_outside(c: Column, lo: float, hi: float) -> Column:
    return F.coalesce(~c.between(lo, hi), F.lit(False))


def _pattern_fails(c: Column, pattern: str, nullable: bool = False) -> Column:
    return F.coalesce(~c.rlike(pattern), F.lit(not nullable))


def _subset_fails(c: Column, allowed: list[str], lo: int, hi: int) -> Column:
    d = F.array_distinct(c)
    bad = (F.size(F.array_except(d, F.array(*[F.lit(a) for a in allowed]))) > 0) \
        | (F.size(d) < lo) | (F.size(d) > hi)
    return F.coalesce(F.when(c.isNotNull(), bad), F.lit(False))


def feed_rules() -> dict[str, Column]:
    c = F.col
    return {
        "partition_key_pattern": _pattern_fails(c("partition_key"), fixed.KEY_PATTERN),   # V1
        "title_length": _len_outside(c("title"), 1, 200),                                 # V4
        "link_not_http_url": c("link").isNull(),                                          # V5
        "language_pattern": _pattern_fails(c("language"), fixed.LANGUAGE_PATTERN, True),  # V6
        "publisher_length": _len_outside(c("publisher"), 1, 200),                         # V7
        "rights_length": _len_outside(c("rights"), None, 500),
        "subtitle_length": _len_outside(c("subtitle"), None, 500),
        "updated_unparsable": c("updated").isNull(),                                      # V10
    }


def entry_rules() -> dict[str, Column]:
    c = F.col
    return {
        "partition_key_pattern": _pattern_fails(c("partition_key"), fixed.KEY_PATTERN),   # V1
        "id_length": _len_outside(c("id"), 1, 200, nullable=False),                       # V2
        "feed_key_pattern": _pattern_fails(c("feed_key"), fixed.FEED_KEY_PATTERN),        # V3
        "title_length": _len_outside(c("title"), 1, 200),                                 # V4
        "link_not_http_url": c("link").isNull(),                                          # V5
        "author_length": _len_outside(c("author"), None, 50),                             # V8
        "summary_length": _len_outside(c("summary"), None, fixed.MAX_SUMMARY_CHARACTERS),  # V9
        "published_unparsable": c("published").isNull(),                                  # V10
    }


def enrichment_rules() -> dict[str, Column]:
    c = F.col
    return {
        "partition_key_pattern": _pattern_fails(c("partition_key"), fixed.KEY_PATTERN),   # V1
        "row_key_pattern": _pattern_fails(c("row_key"), fixed.KEY_PATTERN),
        "summary_length": _len_outside(c("summary"), None, fixed.MAX_SUMMARY_CHARACTERS),  # V9
        "grade_level_range": _range_outside(c("grade_level"), *fixed.GRADE_LEVEL_RANGE),  # V11
        "difficulty_range": _range_outside(c("difficulty"), *fixed.DIFFICULTY_RANGE),     # V12
        "engagement_score_range": _range_outside(c("engagement_score"),                  # V13
                                                 *fixed.ENGAGEMENT_SCORE_RANGE),
        "engagement_categories": _subset_fails(c("engagement_categories"),                # V14
                                               fixed.ENGAGEMENT_CATEGORIES, 1, 3),
    }


def post_rules() -> dict[str, Column]:
    c = F.col
    return {
        "title_length": _len_outside(c("title"), 1, 100, nullable=False),                 # V4
        "keywords_size": F.coalesce((F.size(c("keywords")) < 1) | (F.size(c("keywords")) > 10),  # V15
                                    F.lit(True)),
        "content_length": _len_outside(c("content"), 1, 10000, nullable=False),           # V16
        "draft_status": F.coalesce((F.size(c("draft_status")) != 1)                        # V17
                                   | (F.size(F.array_except(c("draft_status"), F.array(
                                       *[F.lit(s) for s in fixed.DRAFT_STATUSES]))) > 0), F.lit(True)),
        "draft_date_unparsable": c("draft_date").isNull(),                                # F12
        "row_key_missing": c("row_key").isNull(),                                         # F3
    }


def content_rules() -> dict[str, Column]:
    c = F.col("content")
    return {"content_missing": c.isNull() | (c == "") | (c == fixed.MISSING_CONTENT_SENTINEL)}  # V20


def rules_from_list_schema(schema_json: str | dict) -> dict[str, Column]:
    """Rules compiled from a list schema (nullable, allowed values,
    numeric range) into Column predicates, one per field and kind."""
    spec = json.loads(schema_json) if isinstance(schema_json, str) else schema_json
    rules: dict[str, Column] = {}
    for f in spec.get("fields", []):
        name = f["display_name"]
        col = F.col(name)
        if f.get("nullable") is False:
            rules[f"{name}_null"] = col.isNull()
        allowed = f.get("allowed_values")
        if allowed:
            allowed = list(allowed)
            if f.get("type", "").startswith("Choice (Multi"):
                rules[f"{name}_allowed"] = F.coalesce(
                    F.size(F.array_except(col, F.array(*[F.lit(a) for a in allowed]))) > 0, F.lit(False))
            else:
                rules[f"{name}_allowed"] = F.coalesce(~col.isin(allowed), F.lit(False))
        rng = f.get("range")
        if rng:
            rules[f"{name}_range"] = _range_outside(col, float(rng[0]), float(rng[1]))
    return rules


def to_list_values(df: DataFrame, schema_json: str | dict) -> DataFrame:
    """Rows as the list takes them: NULLs become the field's ``default`` where the
    schema names one, and an engine's ``Comment`` the list's ``Commented``."""
    spec = json.loads(schema_json) if isinstance(schema_json, str) else schema_json
    out = {}
    for f in spec.get("fields", []):
        name = f["display_name"]
        if name not in df.columns:
            continue
        kind, col = df.schema[name].dataType, F.col(name)
        if "Commented" in f.get("allowed_values", []) and kind.typeName() == "array":
            col = F.transform(col, lambda x: F.when(x == "Comment", F.lit("Commented")).otherwise(x))
        default = f.get("default")
        if default is not None:
            value = F.array(*[F.lit(x) for x in default]) if isinstance(default, list) else F.lit(default)
            col = F.coalesce(col, value.cast(kind))
        out[name] = col
    return df.withColumns(out) if out else df


def validate(df: DataFrame, rules: dict[str, Column], out: str = "violations") -> DataFrame:
    """Add ``violations``: the names of the broken rules, in rule order."""
    flagged = [F.when(pred, F.lit(name)) for name, pred in rules.items()]
    return df.withColumn(out, F.array_compact(F.array(*flagged)) if flagged
                         else F.array().cast("array<string>"))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows without the ``violations`` column, quarantined rows)."""
    v = validate(df, rules)
    return v.filter(F.size("violations") == 0).drop("violations"), v.filter(F.size("violations") > 0)
