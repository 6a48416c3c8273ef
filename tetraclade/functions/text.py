"""NEWICK text predicates as built-in expressions, which stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_newick(text: Column) -> Column:
    """Trimmed text with a final semicolon."""
    t = F.trim(text)
    return F.when(t.endswith(";"), t).otherwise(F.concat(t, F.lit(";")))


def count_of(text: Column, sign: str) -> Column:
    """Occurrences of one character."""
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def valid_newick(text: Column) -> Column:
    """Whether a text has one semicolon, at its end, and balanced parentheses; null for null."""
    t = F.trim(text)
    signs = F.regexp_replace(t, "[^()]", "")
    # the running depth, or null for good once it falls below zero
    step = lambda depth, x: F.when(x == "(", depth + 1).when((x == ")") & (depth > 0), depth - 1)
    depth = F.aggregate(F.filter(F.split(signs, ""), lambda x: x != ""), F.lit(0), step)
    return F.when(text.isNotNull(), t.endswith(";") & (count_of(t, ";") == 1) & (F.coalesce(depth, F.lit(-1)) == 0))


def has_multifurcations(text: Column) -> Column:
    """Whether a tree has more commas than opening parentheses."""
    return count_of(text, "(") < count_of(text, ",")
