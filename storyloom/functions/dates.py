"""Week grids as column arithmetic.

No driver loop over weeks: every row gets its week index from one expression,
so all weeks are processed by the same plan and ``week`` is a grouping key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK_MICROS = 7 * 86400 * 1_000_000


def midnight(now: Column) -> Column:
    return F.date_trunc("DAY", now)


def week_back(ts: Column, now: Column) -> Column:
    """Backward grid: week w = [mid − 7(w+1) days, mid − 7w days); future → negative."""
    return F.floor((F.unix_micros(midnight(now)) - F.unix_micros(ts) - F.lit(1))
                   / F.lit(WEEK_MICROS)).cast("int")


def week_back_start(week: Column, now: Column) -> Column:
    return midnight(now) - F.make_dt_interval(days=(week + F.lit(1)) * F.lit(7))


def week_back_end(week: Column, now: Column) -> Column:
    return midnight(now) - F.make_dt_interval(days=week * F.lit(7))


def forward_start(now: Column, months: int) -> Column:
    """Start of the forward grid: midnight − 30·months days."""
    return midnight(now) - F.make_dt_interval(days=F.lit(30 * months))


def week_fwd(ts: Column, now: Column, months: int) -> Column:
    """Forward grid index: floor((ts − start) / 7 days) for start ≤ ts < midnight, else null."""
    start = forward_start(now, months)
    idx = F.floor((F.unix_micros(ts) - F.unix_micros(start)) / F.lit(WEEK_MICROS)).cast("int")
    return F.when((ts >= start) & (ts < midnight(now)), idx)
