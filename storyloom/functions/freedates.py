"""Dates in free form as column expressions (H2).

A text is taken apart by token class: one clock time with what follows it
(am/pm, zone, offset), names of months and weekdays, and numbers.  What is left
must be separators or filler words, else the text is unreadable.  The numbers
become year, month and day by their count, size and place beside the month.
Everything is built-in functions, so any number of texts is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and filler words of the reference's date reader.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH = (r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
         r"|nov(?:ember)?|dec(?:ember)?)")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
WEEKDAY = r"(?:mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)"
FILLER = r"(?:at|on|and|ad|m|t|of|st|nd|rd|th)"

ZONE = rf"(?!(?i:{MONTH}|{WEEKDAY})\b)([A-Z]{{3,5}}|[Zz])(?![A-Za-z])"
#: Hour, minute, second, fraction, am/pm, zone name, sign, hours and minutes of the offset.
CLOCK = (r"(?<!\d)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?![\d:])\s*(?:([AaPp])\.?[Mm]\b\.?)?"
         rf"\s*(?:{ZONE})?\s*(?:([+-])(\d{{1,2}}):?(\d{{2}})?(?!\d)(?:\s*\([A-Z]{{3,5}}\))?)?")
#: Clock times without colons: after a date of eight digits, or an hour with am or pm.
COMPACT = rf"(?<=\d{{8}})[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?()\s*(?:{ZONE})?\s*(?:([+-])(\d{{1,2}}):?(\d{{2}})?)?$"
HOUR = rf"(?<!\d)(\d{{1,2}})()()()\s*([AaPp])\.?[Mm]\b\.?\s*(?:{ZONE})?\s*(?:([+-])(\d{{1,2}}):?(\d{{2}})?(?!\d))?"
UTC_NAMES = ("UTC", "GMT", "Z", "z")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(text: Column) -> Column:
    return F.when(text != "", text.cast("int"))


def _tokens(s: Column) -> Column:
    """The groups of the clock time, and the lower-case text without it."""
    forms = (CLOCK, COMPACT, HOUR)
    found = F.when(s.rlike(CLOCK), 0).when(s.rlike(COMPACT), 1).when(s.rlike(HOUR), 2)

    def by_form(of, otherwise: Column) -> Column:
        out = None
        for k, form in enumerate(forms):
            out = F.when(found == k, of(form)) if out is None else out.when(found == k, of(form))
        return out.otherwise(otherwise)

    clock = F.array(*[by_form(lambda form, g=g: F.regexp_extract(s, form, g), F.lit("")) for g in range(1, 10)])
    rest = F.lower(by_form(lambda form: F.regexp_replace(s, form, " "), s))
    rest = F.regexp_replace(rest, r"(?<=\d)(st|nd|rd|th)\b", "")
    rest = F.regexp_replace(rest, r"(?<=\d)t(?=\s|$|\d)", " ")
    return F.struct(clock.alias("clock"), rest.alias("rest"), found.isNotNull().alias("timed"))


def _date(rest: Column, timed: Column) -> Column:
    """Year, month and day as far as they are given, and the weekday; null if the text is unreadable."""
    named = F.regexp_extract(rest, rf"\b({MONTH})\b", 1)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(named, 1, 3)).cast("int")
    ahead = F.size(F.regexp_extract_all(F.regexp_extract(rest, rf"^(.*?)\b{MONTH}\b", 1), F.lit(r"(\d+)"), 1))
    day_name = F.substring(F.regexp_extract(rest, rf"\b({WEEKDAY})\b", 1), 1, 3)
    weekday = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), day_name).cast("int") - 1
    raw = F.regexp_extract_all(rest, F.lit(r"(\d+)"), 1)
    one = F.get(raw, F.lit(0))
    packed = (F.size(raw) == 1) & (named == "") & F.length(one).isin(6, 8)
    cut = F.when(F.length(one) == 8, F.array(F.substring(one, 1, 4), F.substring(one, 5, 2), F.substring(one, 7, 2))) \
        .otherwise(F.array(F.substring(one, 1, 2), F.substring(one, 3, 2), F.substring(one, 5, 2)))
    left = F.regexp_replace(F.regexp_replace(rest, rf"\b(?:{MONTH}|{WEEKDAY}|{FILLER})\b", " "), r"[\d\s.,;/'-]", "")
    tokens = F.struct(named.alias("named"), month.alias("month"), ahead.alias("ahead"), weekday.alias("weekday"),
                      F.when(packed, cut).otherwise(raw).alias("digits"), (left == "").alias("readable"))

    def resolved(t: Column) -> Column:
        n, has_month, none = F.size(t["digits"]), t["named"] != "", F.lit(None).cast("int")
        short = F.forall(t["digits"], lambda d: F.length(d) <= 4)

        def value(k: int) -> Column:
            return F.get(t["digits"], F.lit(k)).cast("int")

        def great(k: int) -> Column:  # a year by its size or its digits
            return (value(k) > 31) | (F.length(F.get(t["digits"], F.lit(k))) > 2)

        def day(y: Column | int | None, m: Column, d: Column) -> Column:
            year = none if y is None else value(y)
            full = F.lit(False) if y is None else F.length(F.get(t["digits"], F.lit(y))) > 2
            return F.struct(year.alias("y"), full.alias("full"), m.alias("m"), d.alias("d"), t["weekday"].alias("weekday"))

        a, b, c, m = value(0), value(1), value(2), t["month"]
        ymd = (
            F.when(has_month & (n == 2) & (t["ahead"] < 2), F.when(great(0), day(0, m, b)).otherwise(day(1, m, a)))
            .when(has_month & (n == 2), F.when(great(1), day(1, m, a)).otherwise(day(0, m, b)))
            .when(has_month & (n == 1), F.when(great(0), day(0, m, none)).otherwise(day(None, m, a)))
            .when(has_month & (n == 0), day(None, m, none))
            .when(~has_month & (n == 3), F.when(great(0), day(0, b, c)).when(a > 12, day(2, b, a)).otherwise(day(2, a, b)))
            .when(~has_month & (n == 2), F.when(great(0), day(0, b, none)).when(great(1), day(1, a, none))
                  .when(a > 12, day(None, b, a)).otherwise(day(None, a, b)))
            .when(~has_month & (n == 1), F.when(great(0), day(0, none, none)).otherwise(day(None, none, a)))
            .when((n == 0) & (timed | (t["weekday"] >= 0)), day(None, none, none)))
        return F.when(t["readable"] & short, ymd)

    return _let(tokens, resolved)


def parse(text: Column, now: Column, local_tz: str) -> Column:
    """The instant a text names, or null if it is unreadable.

    Dates without a zone, or with a zone name other than UTC, GMT and Z, are in
    ``local_tz``.  Of three numbers a four-digit or great first one is the year,
    then come month and day; otherwise a first one above 12 is the day, else the
    month.  Missing parts are those of today.
    """
    today = F.from_utc_timestamp(now, local_tz)
    this_year = F.year(today)

    def instant(t: Column, date: Column) -> Column:
        clock = [F.get(t["clock"], F.lit(k)) for k in range(9)]
        y = date["y"]
        nearest = y + F.floor(this_year / 100).cast("int") * 100
        nearest = (F.when(nearest >= this_year + 50, nearest - 100).when(nearest < this_year - 50, nearest + 100).otherwise(nearest))
        year = F.coalesce(F.when((y < 100) & ~date["full"], nearest).otherwise(y), this_year)
        month = F.coalesce(date["m"], F.month(today))
        first = F.try_make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        day = F.coalesce(date["d"], F.least(F.day(today), F.day(F.last_day(first))))

        hour, half = _number(clock[0]), F.lower(clock[4])
        hour = (F.when(half == "", F.coalesce(hour, F.lit(0)))
                .when(hour.between(0, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)))
        micros = F.coalesce(F.rpad(F.substring(clock[3], 1, 6), 6, "0").try_cast("int"), F.lit(0))
        second = (F.coalesce(_number(clock[2]), F.lit(0)) + micros / F.lit(1000000)).cast("decimal(16,6)")
        plain = F.try_make_timestamp(year, month, day, F.when(hour < 24, hour), F.coalesce(_number(clock[1]), F.lit(0)), second)
        # A weekday without a day is the next such day from today on.
        shift = F.when((date["weekday"] >= 0) & date["d"].isNull(), F.pmod(date["weekday"] - F.weekday(plain), F.lit(7))).otherwise(0)
        plain = plain + F.make_dt_interval(days=shift)

        zone = clock[5]
        hours, minutes = F.coalesce(_number(clock[7]), F.lit(0)), F.coalesce(_number(clock[8]), F.lit(0))
        # "GMT+3" names the zone in which 3 hours more are GMT, as for any named zone.
        sign = F.when(clock[6] == "-", -1).otherwise(1) * F.when((zone != "") & ~zone.isin("Z", "z"), -1).otherwise(1)
        offset = F.make_dt_interval(mins=sign * (hours * 60 + minutes))
        return (F.when(clock[6] != "", plain - offset).when(zone.isin(*UTC_NAMES), plain)
                .otherwise(F.to_utc_timestamp(plain, local_tz)))

    return _let(_tokens(F.trim(text)), lambda t: _let(_date(t["rest"], t["timed"]), lambda date: F.when(date.isNotNull(), instant(t, date))))
