"""Dates in texts; local times without a zone count as +08:00, impossible dates are null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom import config as C
from pressloom.functions.text import let


def has_zone(c: Column) -> Column:
    """A clock time with a zone."""
    return c.rlike(C.ZONE)


def has_clock(c: Column) -> Column:
    """A clock time, with a colon or in fourteen digits."""
    return c.rlike(C.CLOCK)


def _made(parts: list[Column]) -> Column:
    """A checked calendar time of year, month, day, hour, minute and second; blank clock parts are 0."""
    y, mo, d, h, mi, s = (F.coalesce(F.nullif(p, F.lit("")), F.lit("0")) for p in parts)
    whole = [p.try_cast("int") for p in (y, mo, d, h, mi)]
    return F.when((whole[3] < 24) & (whole[4] < 60) & (s.try_cast("decimal(16,6)") < 60), F.try_make_timestamp(*whole, s.try_cast("decimal(16,6)")))


def local_time(parts: list[Column]) -> Column:
    """Calendar-checked local year, month, day, hour, minute and second as UTC."""
    return _made(parts) - F.expr("interval 8 hours")


def _offset(zone: Column) -> Column:
    """Minutes ahead of UTC that a zone names; none is 0."""
    sign, h, m = (F.regexp_extract(zone, r"([+-])(\d{2}):?(\d{2})$", i) for i in (1, 2, 3))
    return F.when(sign == "", 0).otherwise(F.when(sign == "-", -1).otherwise(1) * (h.try_cast("int") * 60 + m.try_cast("int")))


def parse_free(c: Column) -> Column:
    """ISO times and dates with an English month, as mail and feeds write them; without a zone they are UTC."""
    out = []
    for pattern, y, mo, d in ((C.ISO_DATE, 1, 2, 3), (C.DAY_FIRST, 3, 2, 1), (C.MONTH_FIRST, 3, 1, 2)):
        part = lambda i, p=pattern: F.regexp_extract(c, p, i)
        month = part(mo)
        if pattern != C.ISO_DATE:
            at = F.array_position(F.array(*[F.lit(m) for m in C.MONTHS]), F.lower(month))
            month = F.when(at > 0, at.cast("string"))
        time = _made([part(y), month, part(d), part(4), part(5), F.concat(part(6), part(7))])
        out.append(F.when(c.rlike(pattern), time - F.make_interval(mins=_offset(part(8)))))
    return F.coalesce(*out)


def parse_published(text: Column) -> Column:
    """The time a cleaned text names (X40): zoned as it is, else the first separated or compact local time, else free."""
    return let(text, _parsed)


def _parsed(c: Column) -> Column:
    local = [F.regexp_extract(c, C.LOCAL_DATE, i) for i in range(1, 7)]
    compact = [F.regexp_extract(c, C.COMPACT_DATE, i) for i in range(1, 10)]
    clock = [F.coalesce(F.nullif(compact[i], F.lit("")), compact[i + 3]) for i in (3, 4, 5)]
    return F.when(has_zone(c), parse_free(c)).when(c.rlike(C.LOCAL_DATE), local_time(local)).when(c.rlike(C.COMPACT_DATE), local_time([*compact[:3], *clock])).otherwise(parse_free(c))


def first_parsed(candidates: Column) -> Column:
    """The first time that can be read from an array of texts: those with a clock time come first."""
    ranked = let(candidates, lambda c: F.concat(F.filter(c, has_clock), F.filter(c, lambda t: ~has_clock(t))))
    return F.get(F.filter(F.transform(ranked, _parsed), lambda t: t.isNotNull()), F.lit(0))


def date_in_url(url: Column, path: Column) -> Column:
    """The calendar date that a path, or else a query value, names, as +08:00 midnight."""
    tries = [(path, p) for p in C.PATH_DATES] + [(url, C.QUERY_DATE)]
    named = lambda c, p: F.when(c.rlike(p), local_time([F.regexp_extract(c, p, i) for i in (1, 2, 3)] + [F.lit("")] * 3))
    return reduce(F.coalesce, [named(c, p) for c, p in tries])


def not_future(t: Column, now: Column) -> Column:
    """Null for times after now."""
    return F.when(t <= now, t)


def age_minutes(t: Column, now: Column) -> Column:
    """Minutes with three decimals."""
    return F.floor((F.unix_micros(now) - F.unix_micros(t)) / 60e6 * 1000 + 0.5) / 1000


def local_day(t: Column) -> Column:
    """The calendar day at +08:00."""
    return F.date_format(t + F.expr("interval 8 hours"), "yyyy-MM-dd")
