"""Projections, filters and predicates.

All filters are plain column predicates, so Catalyst pushes them into the
parquet scan where the column is stored (``PushedFilters`` in ``explain``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Embedding-input rule of the reference.
EMBED_MAX_CHARS = 8000
EMBED_KEEP_CHARS = 7000
EMBED_ELLIPSIS = "..."
# Name rule of the reference.
NAME_MAX_WORDS = 6
NAME_MAX_CHARS = 50


def time_slice(df: DataFrame, start: Column, end: Column, ts_col: str = "published_date",
               need_vector: str | None = "embedding") -> DataFrame:
    """B1: half-open ``[start, end)`` and, optionally, a vector present."""
    cond = (F.col(ts_col) >= start) & (F.col(ts_col) < end)
    if need_vector:
        cond = cond & F.col(need_vector).isNotNull()
    return df.where(cond)


def lookback(df: DataFrame, now: Column, days: int, ts_col: str = "published_date",
             need_vector: str | None = None) -> DataFrame:
    """B2: ``ts >= now − days``; explicit ``now`` so reruns are reproducible."""
    cond = F.col(ts_col) >= now - F.make_dt_interval(days=F.lit(days))
    if need_vector:
        cond = cond & F.col(need_vector).isNotNull()
    return df.where(cond)


def backlog(df: DataFrame, vec_col: str = "embedding", limit: int | None = None) -> DataFrame:
    """Rows still without a vector; a limit takes the newest (id breaks ties), without one nothing is sorted."""
    out = df.where(F.col(vec_col).isNull())
    if limit is None:
        return out
    return out.orderBy(F.col("published_date").desc(), F.col("id")).limit(limit)


def embed_input(title: Column, content: Column) -> Column:
    """``title + blank line + content``; above 8000 characters keep 7000 + '...'."""
    t = F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(content, F.lit("")))
    return F.when(F.length(t) > EMBED_MAX_CHARS,
                  F.concat(F.substring(t, 1, EMBED_KEEP_CHARS), F.lit(EMBED_ELLIPSIS))).otherwise(t)


def equality_filter(df: DataFrame, filters: Mapping[str, object], allowed: Iterable[str]) -> DataFrame:
    """Equality filters from a dict, restricted to the declared filter fields."""
    allowed = set(allowed)
    for k, v in filters.items():
        if k not in allowed:
            raise ValueError(f"filter on {k!r} not allowed; allowed: {sorted(allowed)}")
        df = df.where(F.col(k) == F.lit(v))
    return df


def search_terms(query: str) -> list[str]:
    """Split a search string on blanks and commas (the list library's rule)."""
    return [t for t in re.split(r"[\s,]+", query.strip()) if t]


def text_search(df: DataFrame, query: str, fields: Iterable[str]) -> DataFrame:
    """Every term must occur (case-insensitive substring) in at least one field."""
    fields = list(fields)
    for term in search_terms(query):
        t = term.lower()
        any_field = None
        for f in fields:
            c = F.coalesce(F.lower(F.col(f)).contains(t), F.lit(False))
            any_field = c if any_field is None else (any_field | c)
        df = df.where(any_field)
    return df


def clean_name(raw: Column) -> Column:
    """B16 first half: strip surrounding whitespace, then drop both quote kinds."""
    return F.translate(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), "\"'", "")


def valid_name(name: Column) -> Column:
    """B16 second half: at most 6 blank-separated words and 50 characters (empty passes)."""
    words = F.size(F.filter(F.split(name, r"(?U)\s+"), lambda w: w != ""))
    return (words <= NAME_MAX_WORDS) & (F.length(name) <= NAME_MAX_CHARS)


def name_or_fallback(raw: Column, fallback: Column) -> Column:
    cleaned = clean_name(raw)
    return F.when(raw.isNotNull() & valid_name(cleaned), cleaned).otherwise(fallback)
