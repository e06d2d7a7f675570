import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loadweave.functions.timeutil import utc_from_local
from loadweave.operators.report import assign_blocks, report_to_long
from loadweave.operators.reshape import wide_to_long, wide_years_to_long


def frame(spark, texts, file="f"):
    rows = [(f, i, line.split(";")) for f, lines in ({file: texts} if isinstance(texts, list) else texts).items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "file string, line long, cells array<string>")


def blocks_of(lines):
    """What belongs to which block, found line by line."""
    date = re.compile(r"(?:r.al|donn).*?(\d\d/\d\d/\d{4})", re.I)
    marks = []
    for line in lines:
        hit = date.search(line.replace(";", " "))
        day = None
        if hit:
            try:
                day = datetime.strptime(hit[1], "%d/%m/%Y")
            except ValueError:
                pass
        marks.append((bool(hit), day, any(w in line.lower() for w in ("heures", "biomasse", "filière", "nucléaire"))))
    out, at = {}, 0
    while at < len(lines):
        day = marks[at][1]
        header = next((k for k in range(at + 1, min(at + 10, len(lines))) if marks[k][2]), None) if day else None
        if header is None:
            at += 1
            continue
        at = header + 1
        while at < len(lines) and not marks[at][0]:
            out[at] = (day, header)
            at += 1
    return out


@pytest.mark.parametrize("chunk", [9, 17, 50_000])
def test_blocks_equal_a_line_by_line_reading(spark, chunk):
    rng = random.Random(11)
    kinds = ["Données du 01/02/2020", "Réalisation 17/05/2021", "Données 31/02/2020", "Heures;Gaz", "x;Nucléaire", "01:00-02:00;5", "01:00-02:00;5", "01:00-02:00;5", "Total;8", "note"]
    texts = {f"file{k}": [f"{rng.choice(kinds)}" for _ in range(rng.randint(1, 70))] for k in range(60)}
    found = assign_blocks(frame(spark, texts), chunk).collect()
    got = {}
    for r in found:
        got.setdefault(r["file"], {})[r["line"]] = (r["day"], tuple(r["header"]))
    for file, lines in texts.items():
        wanted = {k: (day, tuple(lines[h].split(";"))) for k, (day, h) in blocks_of(lines).items()}
        assert got.get(file, {}) == wanted, (file, lines)


REPORT = [
    "Titre",
    "Réalisation du 30/02/2021",
    "Données de réalisation du 28/03/2021",
    "",
    "Heures;Gaz; Gaz ;;Éolien",
    "00:00-01:00;1,5;-;9;2 000",
    "note;;;;",
    "02:00–03:00;n.c.;3",
    "x;03:00-04:00;5",
    "24:00-25:00;1;1;1;1",
    "Total;10;10",
]


def test_report_rows(spark):
    local = report_to_long(frame(spark, [t for t in REPORT if t]), 2021, tz="local").collect()
    at = lambda h: datetime(2021, 3, 28, h)
    rows = sorted((r["datetime"] or datetime(2099, 1, 1), r["technology"], r["value_mw"], r["hour_interval"]) for r in local if r["technology"] != "Gaz" or r["value_mw"] is not None)
    assert rows == [
        (at(0), "Gaz", 1.5, "00:00-01:00"), (at(0), "Gaz__2", 0.0, "00:00-01:00"), (at(0), "Éolien", 2000.0, "00:00-01:00"),
        (at(2), "Gaz__2", 3.0, "02:00–03:00"), (at(2), "Éolien", 0.0, "02:00–03:00"),
        (at(3), "Gaz__2", 5.0, "03:00-04:00"), (at(3), "Éolien", 0.0, "03:00-04:00"),
        (datetime(2099, 1, 1), "Gaz", 1.0, "24:00-25:00"), (datetime(2099, 1, 1), "Gaz__2", 1.0, "24:00-25:00"), (datetime(2099, 1, 1), "Éolien", 1.0, "24:00-25:00"),
    ]
    utc = report_to_long(frame(spark, [t for t in REPORT if t]), 2021).collect()
    # 02:00 does not exist on that day and moves to 01:00 UTC, where 03:00 local is as well.
    assert sorted({(r["datetime"], r["hour_interval"]) for r in utc}) == [
        (datetime(2021, 3, 27, 23), "00:00-01:00"), (datetime(2021, 3, 28, 1), "02:00–03:00"), (datetime(2021, 3, 28, 1), "03:00-04:00"),
    ]
    assert {r["date"] for r in utc} == {datetime(2021, 3, 27, 23)}


def test_ambiguous_report_hour_is_dropped_and_repeats_are_averaged(spark):
    lines = ["Données du 31/10/2021", "Heures;Gaz", "02:00-03:00;1", "03:00-04:00;1", "Données du 31/10/2021", "Heures;Gaz", "03:00-04:00;3"]
    assert [(r["datetime"], r["value_mw"]) for r in report_to_long(frame(spark, lines), 2021).collect()] == [(datetime(2021, 10, 31, 2), 2.0)]


def wide(spark, days, slots=12, status="D"):
    rows = [(i, d, status, *[float(100 * i + k) for k in range(slots)]) for i, d in enumerate(days)]
    schema = "_row long, date string, statut string, " + ", ".join(f"h{k} double" for k in range(slots))
    return spark.createDataFrame(rows, schema)


def test_slots_follow_numeric_position(spark):
    rows = wide_to_long(wide(spark, ["01/07/2020"]), 2020, 120, tz="local").orderBy("slot_index").collect()
    assert [r["load_mw"] for r in rows] == [float(k) for k in range(12)]
    assert [r["datetime"] for r in rows] == [datetime(2020, 7, 1) + timedelta(hours=2 * k) for k in range(12)]


def test_empty_columns_and_missing_status(spark):
    df = wide(spark, ["01/07/2020", "title"], 3).withColumn("h1", F.when(F.col("date") == "title", 5.0)).withColumn("statut", F.lit(None).cast("string"))
    rows = wide_to_long(df, 2020, 720).orderBy("slot_index").collect()
    assert [(r["slot_index"], r["load_mw"], r["statut"]) for r in rows] == [(0, 0.0, None), (1, 2.0, None)]


def test_repeated_dates_share_their_slots(spark):
    rows = wide_to_long(wide(spark, ["01/07/2020", "02/07/2020", "01/07/2020"], 2), 2020, 60, tz="local").collect()
    first = sorted((r["slot_index"], r["load_mw"]) for r in rows if r["date"] == datetime(2020, 7, 1))
    assert first == [(0, 0.0), (1, 200.0), (2, 1.0), (3, 201.0)]


def test_clock_changes_in_wide_files(spark):
    rows = wide_to_long(wide(spark, ["31/03/2024", "27/10/2024"], 48), 2024).collect()
    spring = [r for r in rows if r["datetime"] < datetime(2024, 6, 1)]
    autumn = [r for r in rows if r["datetime"] > datetime(2024, 6, 1)]
    assert len(spring) == 48 and sum(r["datetime"] == datetime(2024, 3, 31, 1) for r in spring) == 3
    assert len(autumn) == 46 and {r["date"] for r in autumn} == {datetime(2024, 10, 26, 22)}


def test_unpivot_keeps_nulls_and_reads_text(spark):
    df = spark.createDataFrame([("01/07/2020", "D", "1.5", None), ("02/07/2020", "D", "x", "2")], "d string, s string, a string, b string")
    rows = wide_to_long(df, 2020, 720, tz="local").orderBy("datetime").collect()
    assert [r["load_mw"] for r in rows] == [1.5, None, None, 2.0]


def test_no_slots_is_an_error(spark):
    with pytest.raises(ValueError, match="time-step"):
        wide_to_long(spark.createDataFrame([("01/07/2020", "D")], "d string, s string"), 2020)


def test_years_of_unlike_width_share_a_plan(spark):
    old = wide(spark, ["01/07/2020", "01/07/2020"], 2).withColumnsRenamed({"h0": "x", "h1": "date2"})
    new = wide(spark, ["01/07/2021", "x"], 5).withColumn("h3", F.when(F.col("date") == "x", 1.0)).withColumn("h4", F.lit("n/a"))
    rows = wide_years_to_long({2020: old, 2021: new}, 60, tz="local").orderBy("datetime").collect()
    assert [(r["year"], r["datetime"].hour, r["slot_index"], r["load_mw"]) for r in rows] == [
        (2020, 0, 0, 0.0), (2020, 1, 1, 100.0), (2020, 2, 2, 1.0), (2020, 3, 3, 101.0),
        (2021, 0, 0, 0.0), (2021, 1, 1, 1.0), (2021, 2, 2, 2.0), (2021, 3, 3, None),
    ]


def test_columns_of_equal_names_count_by_position(spark):
    df = spark.createDataFrame([("01/07/2020", "D", 1.0, 2.0)], "date string, statut string, a double, b double").toDF("date", "date", "h", "h")
    rows = wide_to_long(df, 2020, 720, tz="local").orderBy("slot_index").collect()
    assert [(r["statut"], r["load_mw"]) for r in rows] == [("D", 1.0), ("D", 2.0)]


def test_pivot_of_unpivot_is_identity(spark):
    days = [f"{d:02d}/07/2020" for d in range(1, 20)]
    source = wide(spark, days)
    long = wide_to_long(source, 2020, 120, tz="local")
    back = long.groupBy("date").pivot("slot_index", list(range(12))).agg(F.first("load_mw")).orderBy("date").drop("date")
    assert [tuple(r) for r in back.collect()] == [tuple(r)[3:] for r in source.orderBy("_row").collect()]


def test_null_time_stays_null(spark):
    assert spark.sql("select cast(null as timestamp_ntz) t").select(utc_from_local("t")).first()[0] is None
