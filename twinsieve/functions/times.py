"""Saved times: whole seconds, UTC offsets and comparison with a report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
_DAY = 86_400
_OFFSET = r"^([+-])(\d{2}):(\d{2})(?::(\d{2}))?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def saved_second(micros: Column | str) -> Column:
    """Whole second of a time in microseconds, rounded down (also before 1970)."""
    m = _col(micros).cast("bigint")
    return F.call_function("div", m - F.pmod(m, F.lit(MICROS).cast("bigint")), F.lit(MICROS).cast("bigint"))


def utc_offset(second: Column | str, tz: str) -> Column:
    """Local time minus UTC, in seconds, at an instant given in whole seconds."""
    s = _col(second).cast("bigint")
    return (F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), tz)) - s).cast("int")


def local_utc_offset(local_second: Column | str, tz: str) -> Column:
    """UTC offset at a wall-clock time; the smaller one if it occurs twice or not at all."""
    wall = _col(local_second).cast("bigint")
    before, after = utc_offset(wall - _DAY, tz), utc_offset(wall + _DAY, tz)
    before_fits, after_fits = utc_offset(wall - before, tz) == before, utc_offset(wall - after, tz) == after
    return (
        F.when(before_fits & ~after_fits, before)
        .when(after_fits & ~before_fits, after)
        .otherwise(F.least(before, after))
    )


def offset_text(seconds: Column | str) -> Column:
    """+10:00, -04:30, or with seconds where a historic zone has them."""
    s = _col(seconds).cast("bigint")
    size = F.abs(s)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    part = lambda unit: F.floor(size / F.lit(unit)).cast("bigint")
    tail = F.when(F.pmod(size, F.lit(60)) != 0, F.concat(F.lit(":"), two(F.pmod(size, F.lit(60))))).otherwise("")
    sign = F.when(s < 0, F.lit("-")).otherwise(F.lit("+"))
    return F.concat(sign, two(part(3600)), F.lit(":"), two(F.pmod(part(60), F.lit(60))), tail)


def parse_offset(text: Column | str, report: str) -> Column:
    """Seconds of an offset text; anything else is an error that names the report."""
    t = F.coalesce(_col(text), F.lit(""))
    number = lambda group: F.coalesce(F.try_to_number(F.regexp_extract(t, _OFFSET, group), F.lit("99")), F.lit(0))
    size = (number(2) * 3600 + number(3) * 60 + number(4)).cast("int")
    problem = F.concat(F.lit(f"'{report}' is not a usable report: '"), t, F.lit("' is not a UTC offset."))
    return F.when(~F.rlike(t, F.lit(_OFFSET)), F.raise_error(problem).cast("int")).when(
        t.startswith("-"), -size
    ).otherwise(size)


def same_saved_date(
    mtime_us: Column | str, local_us: Column | str, utc_offset_s: Column | str, tz: str
) -> Column:
    """Whether a file still has a report's saved time, to the whole second.

    Instants are compared when the report has the offset; rows without one compare local times.
    """
    second, offset = saved_second(mtime_us), _col(utc_offset_s).cast("bigint")
    by_instant = second == saved_second(_col(local_us) - offset * MICROS)
    by_wall_clock = second + utc_offset(second, tz) == saved_second(local_us)
    return F.when(offset.isNull(), by_wall_clock).otherwise(by_instant)
