from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadweave.functions import timeutil as T


def ntz(spark, stamps):
    rows = [(s if isinstance(s, str) else s.isoformat(sep=" "),) for s in stamps]
    return spark.createDataFrame(rows, "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))


@pytest.fixture(params=["UTC", "Europe/Paris", "America/New_York"])
def any_zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_local_to_utc_around_both_clock_changes(spark, any_zone):
    stamps = [datetime(2024, m, d) + timedelta(minutes=30 * k) for m, d in ((3, 30), (10, 26)) for k in range(144)]
    wanted = (
        pd.Series(stamps).dt.tz_localize("Europe/Paris", ambiguous="NaT", nonexistent="shift_forward").dt.tz_convert("UTC").dt.tz_localize(None)
    )
    got = {r["t"]: r["u"] for r in ntz(spark, stamps).select("t", T.utc_from_local("t").alias("u")).collect()}
    for stamp, utc in zip(stamps, wanted):
        assert got[stamp] == (None if pd.isna(utc) else utc.to_pydatetime()), stamp


def first_valid(stamp, zone):
    """UTC of a local time by the standard library: None if it occurs twice, the clock change if it does not exist."""
    utc = lambda t, fold: t.replace(tzinfo=zone, fold=fold).astimezone(timezone.utc).replace(tzinfo=None)
    wall = lambda t: t.replace(tzinfo=timezone.utc).astimezone(zone).replace(tzinfo=None)
    early, late = sorted({utc(stamp, 0), utc(stamp, 1)})[0], sorted({utc(stamp, 0), utc(stamp, 1)})[-1]
    if wall(early) == wall(late) == stamp:
        return None if early != late else early
    if early == late or stamp in (wall(early), wall(late)):
        return next(t for t in (early, late) if wall(t) == stamp)
    shift = wall(late) - late
    low, high = int((early - datetime(1900, 1, 1)).total_seconds()), int((late - datetime(1900, 1, 1)).total_seconds())
    at = lambda s: datetime(1900, 1, 1) + timedelta(seconds=s)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if wall(at(middle)) - at(middle) == shift else (middle, high)
    return at(high)


@pytest.mark.parametrize(
    "zone,start",
    [
        ("Australia/Lord_Howe", datetime(2024, 4, 6)),
        ("Australia/Lord_Howe", datetime(2024, 10, 5)),
        ("Asia/Kathmandu", datetime(1985, 12, 31)),
        ("Europe/Paris", datetime(1976, 3, 27)),
        ("Europe/Paris", datetime(1976, 9, 25)),
        ("Europe/Paris", datetime(1995, 9, 23)),
        ("America/St_Johns", datetime(2006, 4, 1)),
        ("Africa/Monrovia", datetime(1972, 1, 6)),
        ("Pacific/Apia", datetime(2011, 12, 28)),
        ("UTC", datetime(2024, 3, 30)),
    ],
)
def test_local_to_utc_in_any_zone(spark, zone, start):
    info = ZoneInfo(zone)
    stamps = [start + timedelta(minutes=7 * k, seconds=k % 60, microseconds=250000 * (k % 4)) for k in range(650)]
    got = {r["t"]: r["u"] for r in ntz(spark, stamps).select("t", T.utc_from_local("t", zone).alias("u")).collect()}
    assert [(s, got[s]) for s in stamps if got[s] != first_valid(s, info)] == []


def test_floors_do_not_depend_on_the_session_zone(spark, any_zone):
    row = ntz(spark, ["2024-03-31 02:47:11.5"]).select(
        T.hour_floor("t").alias("h"), T.day_floor("t").alias("d"), T.step_floor("t", 30).alias("s"), T.epoch_seconds("t").alias("e")
    ).first()
    assert row["h"] == datetime(2024, 3, 31, 2)
    assert row["d"] == datetime(2024, 3, 31)
    assert row["s"] == datetime(2024, 3, 31, 2, 30)
    assert row["e"] == 1711853231


@pytest.mark.parametrize(
    "text,utc",
    [
        ("2024-03-31T00:30:00+01:00", "2024-03-30 23:30:00"),
        ("2024-03-31T03:30:00+02:00", "2024-03-31 01:30:00"),
        ("2024-03-31 02:30:00+0100", "2024-03-31 01:30:00"),
        ("2024-03-31T02:30:00Z", "2024-03-31 02:30:00"),
        ("2024-03-31T02:30Z", "2024-03-31 02:30:00"),
        ("2024-03-31 02:30", "2024-03-31 02:30:00"),
        ("2024-03-31", "2024-03-31 00:00:00"),
        (" 2024-03-31 02:30:00.25 ", "2024-03-31 02:30:00.250000"),
        ("31/03/2024", None),
        ("12:30:00", None),
        ("never", None),
        ("", None),
        (None, None),
    ],
)
def test_iso_text_to_utc(spark, any_zone, text, utc):
    got = spark.createDataFrame([(text,)], "s string").select(T.utc_from_iso("s")).first()[0]
    assert got == (datetime.fromisoformat(utc) if utc else None)


def test_days_of_report_text(spark):
    texts = ["31/12/2024", "1/2/2024", "31/02/2024", "2024-01-01", "", "01/13/2024"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(T.parse_day("s")).collect()]
    assert got == [datetime(2024, 12, 31), datetime(2024, 2, 1), None, None, None, None]


def test_year_lists():
    assert T.parse_years("2018-2020") == [2018, 2019, 2020]
    assert T.parse_years(" 2020, 2022,") == [2020, 2022]
    assert T.parse_years("2020-2018", strict=False) == []
    with pytest.raises(ValueError):
        T.parse_years("2020-2018")


def test_time_ranges(spark):
    df = ntz(spark, ["2023-12-31 22:59:59", "2023-12-31 23:00:00", "2024-05-01 12:00:00", "2024-05-01 12:59:00", "2024-05-01 13:00:00"])
    assert T.year_to_date(df, "t", "2024-05-01 12:00:00").count() == 1
    assert T.year_to_date(df, "t", "2024-05-01 12:00:00", ahead_hours=1).count() == 3
    # Late on 31 December in UTC it is already the next year in Paris.
    assert T.year_to_date(df, "t", "2023-12-31 23:30:00").count() == 1
    assert T.last_days(df, "t", "2024-05-01 12:30:00", days=1).count() == 1
    assert T.past_and_future_days(df, "t", "2024-05-02 08:00:00", past=1, future=1).count() == 3


def test_slot_times(spark):
    df = spark.sql("select date'2024-01-01' d, 47 s")
    assert df.select(T.slot_timestamp("d", "s")).first()[0] == datetime(2024, 1, 1, 23, 30)
    assert df.select(T.slot_timestamp("d", "s", 15)).first()[0] == datetime(2024, 1, 1, 11, 45)


def test_range_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    ntz(spark, ["2024-01-01 00:00:00"]).write.parquet(path)
    plan = T.last_days(spark.read.parquet(path), "t", "2024-01-02 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t" in plan and "LessThan(t" in plan


def test_given_formats_are_tried_after_iso_text(spark, any_zone):
    texts = ["2024-03-31T02:30:00+02:00", "2024/3/31 2:30", "31.03.2024 02:30", "2024-3-1 0:30", "bad", None, "2024/13/01 00:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", T.utc_from_text("s", ["yyyy/M/d H:mm", "d.M.yyyy H:mm", "yyyy-M-d H:mm"]).alias("t")).collect()}
    local = datetime(2024, 3, 31, 2, 30)
    assert got == {0: datetime(2024, 3, 31, 0, 30), 1: local, 2: local, 3: datetime(2024, 3, 1, 0, 30), 4: None, 5: None, 6: None}
