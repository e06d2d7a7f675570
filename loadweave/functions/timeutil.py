"""Time expressions on naive UTC timestamps (``timestamp_ntz``).

No expression here reads the session time zone, so results are the same under
any setting of ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL_ZONE = "Europe/Paris"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def naive(moment: datetime | str) -> Column:
    """A constant naive timestamp; it folds to a literal and reaches the scan."""
    text = moment if isinstance(moment, str) else moment.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def interval(days=0, hours=0, minutes=0, seconds=0) -> Column:
    """A day-time interval from numbers or columns."""
    parts = [p if isinstance(p, Column) else F.lit(p) for p in (days, hours, minutes, seconds)]
    return F.make_dt_interval(*parts)


def day_floor(t: Column | str) -> Column:
    return col(t).cast("date").cast("timestamp_ntz")


def hour_floor(t: Column | str) -> Column:
    return day_floor(t) + interval(hours=F.hour(col(t)))


def step_floor(t: Column | str, minutes: int) -> Column:
    """Start of the step that holds the instant; steps count from midnight."""
    of_day = F.hour(col(t)) * 60 + F.minute(col(t))
    return day_floor(t) + interval(minutes=(of_day - of_day % minutes).cast("int"))


def epoch_seconds(t: Column | str) -> Column:
    """Whole seconds since 1970 of a naive timestamp, as a long."""
    since = col(t) - naive("1970-01-01 00:00:00")
    return since.cast("interval second").cast("long")


def parse_timestamp(text: Column | str, fmt: str = "d/M/yyyy") -> Column:
    """Naive timestamp in a fixed format; what does not parse becomes null.

    Read as if at offset zero, so that no session time zone has gaps in it.
    """
    zoned = F.concat(F.trim(col(text)), F.lit(" +00:00"))
    return naive_utc(F.try_to_timestamp(zoned, F.lit(f"{fmt} xxx")))


def utc_from_text(text: Column | str, formats: Sequence[str] = ()) -> Column:
    """ISO text as in utc_from_iso, else the first of the given formats (of UTC times) that fits; null if none."""
    return F.coalesce(utc_from_iso(text), *[parse_timestamp(text, f) for f in formats])


def parse_day(text: Column | str) -> Column:
    """Day-first date text (31/12/2024) to midnight; anything else is null."""
    parts = [F.regexp_extract(F.trim(col(text)), r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i) for i in (3, 2, 1)]
    iso = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return iso.try_cast("date").cast("timestamp_ntz")


def utc_from_iso(text: Column | str) -> Column:
    """ISO text with any offset, or none (taken as UTC), to naive UTC."""
    raw = F.trim(col(text))
    raw = F.regexp_replace(raw, r"^(\d{4}-\d{2}-\d{2})$", "$1 00:00:00")
    raw = F.regexp_replace(raw, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?=$|Z|[+-])", "$1:00")
    zoned = F.when(raw.rlike(r":\d{2}(\.\d+)? ?(Z|UTC|[+-]\d{2}(:?\d{2})?)$"), raw).otherwise(F.concat(raw, F.lit("Z")))
    instant = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), zoned).try_cast("timestamp")
    return naive_utc(instant)


def naive_utc(instant: Column | str) -> Column:
    """Zone-aware ``timestamp`` to the naive UTC wall time of the same instant."""
    micros = F.unix_micros(col(instant)).cast("decimal(20,0)")
    seconds = (micros / F.lit(1000000)).cast("decimal(18,6)")
    return naive("1970-01-01 00:00:00") + interval(seconds=seconds)


def utc_from_local(t: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """Naive local wall time to naive UTC, in any zone and at any of its offsets.

    A wall time that occurs twice becomes null; one that does not exist moves to the
    first valid instant, that is the second in which the clocks change. Two changes of
    one zone are taken to be more than two days apart.
    """
    local = col(t)
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)  # of two instants the one before the change
    later = local + interval(days=1)
    shift = local_from_utc(later, zone) - later
    other = local - shift
    twice = (other != utc) & (local_from_utc(other, zone) == local)
    return F.when(twice, F.lit(None)).when(local_from_utc(utc, zone) != local, _clock_change(other, shift, zone)).otherwise(utc)


def _clock_change(before: Column, shift: Column, zone: str) -> Column:
    """The instant, in UTC and at most 36 hours after ``before``, from which local time is ahead by ``shift``.

    Halving steps lead to the last of the seconds counted from ``before`` that are not
    yet shifted; clocks change on whole seconds.
    """

    def step(at: Column, seconds: Column) -> Column:
        ahead = at + interval(seconds=seconds)
        return F.when(local_from_utc(ahead, zone) - ahead != shift, ahead).otherwise(at)

    steps = F.array(*[F.lit(2**k).cast("decimal(18,6)") for k in range(16, -1, -1)])
    after = F.aggregate(steps, before, step) + interval(seconds=1)
    second = F.date_part(F.lit("SECOND"), after)
    return after - interval(seconds=(second - F.floor(second)).cast("decimal(18,6)"))


def local_from_utc(t: Column | str, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(t))


def slot_timestamp(day: Column | str, slot: Column | str, step_minutes: int = 30) -> Column:
    """Start of a slot: midnight plus slot number times step."""
    return col(day).cast("timestamp_ntz") + interval(minutes=(col(slot) * step_minutes).cast("int"))


def select_years(df: DataFrame, years: str, column: str = "year") -> DataFrame:
    """Keep the years of ``a-b`` (inclusive) or ``a,b,c``; prunes partitions on ``year``."""
    return df.where(F.col(column).isin(parse_years(years)))


def parse_years(years: str, strict: bool = True) -> list[int]:
    """The year list of ``a-b`` or ``a,b,c``; ``strict`` rejects a reversed range."""
    text = years.strip()
    if "-" not in text:
        return [int(part) for part in text.split(",") if part.strip()]
    first, last = (int(part) for part in text.split("-", 1))
    if strict and last < first:
        raise ValueError(f"year range runs backwards: {years}")
    return list(range(first, last + 1))


def between(df: DataFrame, column: str, start: Column, end: Column) -> DataFrame:
    return df.where((F.col(column) >= start) & (F.col(column) < end))


def year_to_date(df: DataFrame, column: str, as_of: datetime | str, ahead_hours: int = 0, zone: str = LOCAL_ZONE) -> DataFrame:
    """From local 1 January of the local year of ``as_of`` (UTC) to ``as_of`` plus some hours."""
    now = naive(as_of)
    start = utc_from_local(F.trunc(local_from_utc(now, zone).cast("date"), "year").cast("timestamp_ntz"), zone)
    return between(df, column, start, now + interval(hours=ahead_hours))


def last_days(df: DataFrame, column: str, as_of: datetime | str, days: int = 8) -> DataFrame:
    now = naive(as_of)
    return between(df, column, now - interval(days=days), now)


def past_and_future_days(df: DataFrame, column: str, as_of: datetime | str, past: int = 7, future: int = 7) -> DataFrame:
    """Whole days around the day of ``as_of``: ``past`` before it, ``future`` from it on."""
    today = day_floor(naive(as_of))
    return between(df, column, today - interval(days=past), today + interval(days=future))
