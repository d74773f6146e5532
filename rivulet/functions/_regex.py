"""Regex rules written once, rendered for Spark (Java regex) or RE2 SQL.

Patterns are kept to the subset Java and RE2 agree on (no look-around, no
back-references in patterns, ``\\z`` for end of text, ``\\x{..}`` escapes).
Replacements use ``{1}`` for group 1; Spark wants ``$1``, RE2 wants ``\\1``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set, which str.split()/str.strip() use.
WS = (r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
NOT_WS = "[^" + WS[1:]

# The same set as characters, derived from Python's own definition.
WS_CHARS = "".join(c for c in map(chr, range(0x110000)) if c.isspace())


def java_repl(repl: str) -> str:
    return re.sub(r"\{(\d)\}", r"$\1", repl)


def re2_repl(repl: str) -> str:
    return re.sub(r"\{(\d)\}", r"\\\1", repl.replace("\\", "\\\\"))


def apply_rules(col: Column, rules) -> Column:
    for pattern, repl in rules:
        col = F.regexp_replace(col, pattern, java_repl(repl))
    return col


def sql_str(s: str) -> str:
    """A DuckDB string literal (standard quoting, no escapes)."""
    return "'" + s.replace("'", "''") + "'"


def sql_apply_rules(expr: str, rules) -> str:
    for pattern, repl in rules:
        expr = f"regexp_replace({expr}, {sql_str(pattern)}, {sql_str(re2_repl(repl))}, 'g')"
    return expr


def fold_ws(col: Column) -> Column:
    """Every whitespace character becomes a plain space (one pass)."""
    return F.translate(col, WS_CHARS, " " * len(WS_CHARS))


def strip_ws(col: Column) -> Column:
    """Python ``str.strip()``: drop leading and trailing whitespace.

    Both ends use a start-anchored pattern (the tail on the reversed
    text): an unanchored ``WS+\\z`` would test the class at every position."""
    head = F.regexp_replace(col, f"^{WS}+", "")
    return F.reverse(F.regexp_replace(F.reverse(head), f"^{WS}+", ""))


def sql_strip_ws(expr: str) -> str:
    return f"regexp_replace({expr}, {sql_str(f'^{WS}+|{WS}+\\z')}, '', 'g')"
