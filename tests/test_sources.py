import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loadweave.plans.datasets import (
    build_hourly_dataset,
    build_load_dataset,
    build_weather_dataset,
    normalise_load_years,
    normalise_reports,
)
from loadweave.sources import files, payloads, tables
from loadweave.sources.report_text import read_report_lines


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding) if isinstance(text, str) else text)
    return str(path)


@pytest.fixture
def load_files(tmp_path):
    """Three files: aliases, padded and repeated names, bad times, repeats within and across files."""
    folder = tmp_path / "load files"
    write(folder, "load_2001_long.csv", " Datetime ,statut,slot_index,LOAD_MW,datetime\n"
          "2001-01-01 00:30:00,D,1,11,x\n2001-01-01 00:00:00,D,0,10,x\n2001-01-01 00:30:00,D,1,99,x\nbad,D,2,5,x\n,D,3,6,x\n"
          "2001-01-01 01:30:00,D,3,13,x\n")
    write(folder, "load_2002_long.csv", "datetime,valeur\n2001-01-01 01:30:00+00:00,77\n2001-01-01T03:00:00+01:00,20\n2001-01-01 02:30:00,nan\n")
    write(folder, "load_2003_long.csv", "datetime,date,year,statut,slot_index,load_mw\n")
    return str(folder / "load_*_long.csv")


def test_load_dataset(spark, load_files, tmp_path):
    dataset, report = build_load_dataset(spark, load_files, str(tmp_path / "deep" / "out"))
    hour = lambda h, m: datetime(2001, 1, 1, h, m)
    assert dataset.dtypes == [("datetime", "timestamp_ntz"), ("load_mw", "double")]
    assert sorted(map(tuple, dataset.collect()), key=lambda r: r[0]) == [
        (hour(0, 0), 10.0), (hour(0, 30), 11.0), (hour(1, 30), 13.0), (hour(2, 0), 20.0), (hour(2, 30), None),
    ]
    assert [tuple(r) for r in report.drop("path").collect()] == [
        ("load_2001_long.csv", 3, hour(0, 0), hour(1, 30), 1, 6, 2, 0, 1),
        ("load_2002_long.csv", 3, hour(1, 30), hour(2, 30), 0, 3, 0, 1, 0),
        ("load_2003_long.csv", 0, None, None, 0, 0, 0, 0, 0),
    ]


def test_blank_first_lines_and_files_of_one_name(spark, tmp_path):
    write(tmp_path, "a/x_long.csv", "\n  \r\n\ufeffdatetime,load_mw\n2001-01-01 00:00:00,1\n2001-01-01 00:30:00,2\n")
    write(tmp_path, "b/x_long.csv", "datetime,load_mw,path,file\n2001-01-01 00:30:00,9,p,f\n\n2001-01-01 02:00:00,3,p,f\nnone,4,p,f\n")
    write(tmp_path, "b/y_long.csv", "\n\n")
    dataset, report = build_load_dataset(spark, str(tmp_path / "*" / "*_long.csv"), str(tmp_path / "out"))
    hour = lambda h, m: datetime(2001, 1, 1, h, m)
    assert sorted(map(tuple, dataset.collect())) == [(hour(0, 0), 1.0), (hour(0, 30), 2.0), (hour(2, 0), 3.0)]
    assert [(r.path.rsplit("/", 2)[1], *tuple(r.asDict()[c] for c in ("file", "rows", "min_dt", "n_bad_steps", "rows_read", "no_time", "duplicates"))) for r in report.collect()] == [
        ("a", "x_long.csv", 2, hour(0, 0), 0, 2, 0, 0),
        ("b", "x_long.csv", 2, hour(0, 30), 1, 3, 1, 0),
        ("b", "y_long.csv", 0, None, 0, 0, 0, 0),
    ]
    write(tmp_path, "w/w.csv", "\ncity,datetime,temperature_2m,path\nParis,2020-01-01 00:00:00,4,here\n")
    weather = files.read_weather(spark, str(tmp_path / "w"))
    assert weather.select("city", "temperature_2m").collect() == [("Paris", 4.0)]


def test_columns_in_another_order_lose_no_row(spark, tmp_path):
    write(tmp_path, "l2001.csv", "datetime,load_mw\n2001-01-01 00:00:00,1\n")
    write(tmp_path, "l2002.csv", "load_mw,datetime\n2,2002-01-01 00:00:00\n")
    rows = files.read_load_long(spark, str(tmp_path / "l*.csv")).select("datetime", "load_mw", "file").collect()
    assert sorted(map(tuple, rows)) == [(datetime(2001, 1, 1), 1.0, "l2001.csv"), (datetime(2002, 1, 1), 2.0, "l2002.csv")]


def test_only_empty_files_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no file with a header"):
        files.read_load_long(spark, write(tmp_path, "empty.csv", ""))


def test_missing_files_and_columns(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_load_long(spark, str(tmp_path / "none_*.csv"))
    with pytest.raises(ValueError, match="datetime"):
        files.read_load_long(spark, write(tmp_path, "x.csv", "time,load_mw\n1,2\n"))


def test_weather_dataset(spark, tmp_path):
    write(tmp_path, "w1.csv", "date,temperature_2m,cloud_cover,city\n2020-01-01 00:00:00+00:00,1,50,Paris \n"
          "2020-01-01 00:00:00+00:00,9,90, Paris\n2020-01-01 01:00:00+00:00,,70,Paris\n2020-01-01 00:00:00+00:00,3,10,Lyon\n")
    write(tmp_path, "w2.csv", "datetime,City,temperature_2m\n2020-01-01 03:00:00,Paris,5\n2020-01-01 03:00:00,,5\nbad,Paris,5\n")
    national, report = build_weather_dataset(spark, str(tmp_path / "w*.csv"), str(tmp_path / "out"))
    at = lambda h: datetime(2020, 1, 1, h)
    assert sorted(map(tuple, national.select("datetime", "temperature_2m", "cloud_cover").collect())) == [
        (at(0), 2.0, 30.0), (at(1), None, 70.0), (at(3), 5.0, None),
    ]
    assert [tuple(r) for r in report.collect()] == [("Paris", 3, at(0), at(3), 1), ("Lyon", 1, at(0), at(0), 0)]


def test_hourly_dataset_keeps_empty_hours(spark, tmp_path):
    spark.sql("select timestamp_ntz'2020-01-01 00:10:00' datetime, 1d load_mw union all select timestamp_ntz'2020-01-01 00:50:00', 3d"
              " union all select timestamp_ntz'2020-01-01 02:00:00', 5d union all select timestamp_ntz'2020-01-01 03:00:00', 6d").write.parquet(str(tmp_path / "l"))
    spark.sql("select explode(sequence(0, 2)) h").select(
        (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), "h")).alias("datetime"), F.col("h").cast("double").alias("temperature_2m")
    ).write.parquet(str(tmp_path / "w"))
    final = build_hourly_dataset(spark, str(tmp_path / "l"), str(tmp_path / "w"), str(tmp_path / "o"))
    assert [r["load_mw"] for r in final.orderBy("datetime").collect()] == [2.0, None, 5.0]


def test_choice_of_wide_files(spark, tmp_path):
    day = "date;statut;a;b\n01/01/{y};D;1,5;2\n"
    write(tmp_path, "2001/zz.csv", "d,s,a\n")
    write(tmp_path, "2001/" + files.WIDE_STEM.format(year=2001) + ".csv", day.format(y=2001))
    write(tmp_path, "2001/" + files.WIDE_STEM.format(year=2001) + ".xls", b"\xd0\xcf")
    write(tmp_path, "2002/b.csv", "date,statut,a\n01/01/2002,D,7\n")
    write(tmp_path, "2002/a.xlsx", b"PK")
    write(tmp_path, "2003/c.txt", "nothing")
    spark.range(1).write.parquet(str(tmp_path / "2004" / "any.parquet"))
    chosen = files.choose_wide_files(spark, str(tmp_path), "2001-2005")
    assert {y: p.rsplit("/", 1)[1] for y, p in chosen.items()} == {
        2001: files.WIDE_STEM.format(year=2001) + ".csv", 2002: "b.csv", 2004: "any.parquet",
    }
    wide = files.read_load_wide(spark, str(tmp_path), "2001,2002")
    assert wide[2001].columns == ["date", "statut", "a", "b", "_row"] and wide[2002].first()["a"] == "7"
    with pytest.raises(NotImplementedError):
        files.read_wide_file(spark, str(tmp_path / "2002/a.xlsx"))


def test_wide_years_to_csv(spark, tmp_path):
    write(tmp_path, "raw/2001/a.csv", "date,statut,h0,h1\nTitle,,,\n01/07/2001,D,10,11\n02/07/2001,,12,\n")
    assert normalise_load_years(spark, str(tmp_path / "raw"), "2000-2002", str(tmp_path / "out"), step_minutes=720) == [2001]
    back = tables.read_years(spark, str(tmp_path / "out"), "datetime timestamp_ntz, date timestamp_ntz, statut string, slot_index int, load_mw double, year int")
    assert sorted((r["datetime"], r["statut"], r["load_mw"]) for r in back.collect()) == [
        (datetime(2001, 6, 30, 22), "D", 10.0), (datetime(2001, 7, 1, 10), "D", 11.0), (datetime(2001, 7, 1, 22), None, 12.0), (datetime(2001, 7, 2, 10), None, None),
    ]


def test_wide_years_take_as_many_jobs_as_one(spark, tmp_path):
    def jobs(years, name):
        for year in years:
            slots = range(2 + year % 3)
            head = ";".join(["date", "statut", *[f"h{k}" for k in slots]])
            write(tmp_path, f"{name}/{year}/a.csv", f"\n{head}\n" + "".join(f"{d:02d}/07/{year};D;{';'.join(str(year + k) for k in slots)}\n" for d in (1, 2)))
        spark.sparkContext.setJobGroup(name, name)
        found = normalise_load_years(spark, str(tmp_path / name), "2000-2010", str(tmp_path / f"out-{name}"), step_minutes=60, tz="local")
        count = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert found == years
        return count

    assert jobs([2001], "one") == jobs([2001, 2002, 2003, 2004, 2005], "many")
    back = tables.read_years(spark, str(tmp_path / "out-many"), "datetime timestamp_ntz, date timestamp_ntz, statut string, slot_index int, load_mw double, year int")
    assert sorted((r["datetime"], r["load_mw"]) for r in back.collect()) == [
        (datetime(year, 7, d, k), float(year + k)) for year in range(2001, 2006) for d in (1, 2) for k in range(2 + year % 3)
    ]


def test_wide_csv_without_header_is_an_error(spark, tmp_path):
    write(tmp_path, "2001/a.csv", "date,statut,h0\n01/07/2001,D,1\n")
    write(tmp_path, "2002/a.csv", "\n\n")
    with pytest.raises(ValueError, match="2002/a.csv"):
        files.read_load_wide(spark, str(tmp_path), "2001-2002")


def test_cities_and_capacity(spark, tmp_path):
    path = write(tmp_path, "c.csv", 'Agglomération,Population,Formule,Latitude,Longitude\nParis,100,"0,25",48.8,2.3\n"Lyon, Est",300,"0,75",45.7,-4.8\n')
    assert sorted(map(tuple, files.read_cities(spark, path).collect())) == [("Lyon, Est", 300, 0.75, 45.7, -4.8), ("Paris", 100, 0.25, 48.8, 2.3)]
    for year in (2015, 2021):
        write(tmp_path, f"cap_{year}.csv", f"﻿Capacité installée.\n\nType;{year}\nGaz;12.5\nÉolien;7\nMarin;\n\nSans garantie, aucune; vraiment aucune.")
    got = files.read_capacity_year(spark, str(tmp_path / "cap_*.csv"))
    assert sorted(map(tuple, got.collect())) == [(2015, "Gaz", 12.5), (2015, "Éolien", 7.0), (2021, "Gaz", 12.5), (2021, "Éolien", 7.0)]


REPORT = "Données de réalisation du 05/01/2021\nHeures{s}Nucléaire{s}Œuvre\n\n00:00–01:00{s}\"1 000,5\"{s}-\n01:00-02:00{s}7\n"


@pytest.mark.parametrize(
    "name,encoding,separator",
    [("u.txt", "utf-8", "\t"), ("w.txt", "cp1252", ";"), ("c.txt", "utf-8", ",")],
)
def test_report_charsets_and_separators(spark, tmp_path, name, encoding, separator):
    text = REPORT.format(s=separator)
    if separator == ",":
        text = text.replace("1 000,5", "1000.5")
    got = read_report_lines(spark, write(tmp_path, name, text, encoding), pad=True).orderBy("line").collect()
    assert [r["line"] for r in got] == [0, 1, 2, 3]
    assert got[1]["cells"] == ["Heures", "Nucléaire", "Œuvre"]
    assert got[2]["cells"] == ["00:00–01:00", "1000.5" if separator == "," else "1 000,5", "-"]
    assert got[3]["cells"] == ["01:00-02:00", "7", ""]


def test_report_with_open_bytes_stays_latin(spark, tmp_path):
    raw = "Données".encode("latin-1") + b"\t\x81\x96\n"
    assert read_report_lines(spark, write(tmp_path, "l.txt", raw)).first()["cells"] == ["Données", "\x81\x96"]


def test_separator_line_is_the_hundred_and_first(spark, tmp_path):
    lines = ["a;b"] * 100 + ["a\tb\tc;d"] + ["a;b"] * 5
    text = "\n\n".join(lines)
    got = read_report_lines(spark, write(tmp_path, "s.txt", text)).orderBy("line").collect()
    assert len(got) == 106 and got[0]["cells"] == ["a;b"] and got[100]["cells"] == ["a", "b", "c;d"]


def test_files_read_in_many_splits_keep_line_numbers(spark, tmp_path):
    lines = [f"{i};x\x0b{i};y" for i in range(3000)]
    path = write(tmp_path, "big.txt", "\n \n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = read_report_lines(spark, path).orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["line"] for r in got] == list(range(6000))
    assert [r["cells"] for r in got] == [[str(i // 2), "xy"[i % 2]] for i in range(6000)]


def test_report_job(spark, tmp_path):
    write(tmp_path, "in/report_2021.txt", REPORT.format(s="\t"), "cp1252")
    normalise_reports(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    back = tables.read_years(spark, str(tmp_path / "out"), "datetime timestamp_ntz, date timestamp_ntz, hour_interval string, technology string, value_mw double, year int", [2021])
    assert sorted((r["datetime"], r["technology"], r["value_mw"]) for r in back.collect()) == [
        (datetime(2021, 1, 4, 23), "Nucléaire", 1000.5), (datetime(2021, 1, 4, 23), "Œuvre", 0.0),
        (datetime(2021, 1, 5, 0), "Nucléaire", 7.0), (datetime(2021, 1, 5, 0), "Œuvre", 0.0),
    ]
    write(tmp_path, "in/deaf_2021.txt", "nothing here\n")
    with pytest.warns(UserWarning, match="no rows extracted from .*/deaf_2021.txt$"):
        normalise_reports(spark, str(tmp_path / "in"), str(tmp_path / "out3"))
    write(tmp_path, "none/r_2021.txt", "nothing here\n")
    with pytest.raises(ValueError, match="no rows"):
        normalise_reports(spark, str(tmp_path / "none"), str(tmp_path / "out2"))


def parsed(spark, schema, *documents):
    return spark.createDataFrame([(json.dumps(d),) for d in documents], "j string").select(F.from_json("j", schema).alias("p")).select("p.*")


def value(start, v, updated="2024-01-02T00:00:00+01:00", **more):
    return {"start_date": start, "end_date": "2024-06-01T01:00:00+02:00", "updated_date": updated, "value": v, **more}


def test_load_payload(spark):
    df = parsed(
        spark, payloads.LOAD_PAYLOAD,
        {"short_term": [
            {"type": "REALISED", "values": [value("2024-06-01T00:00:00+02:00", 1), value("2024-06-01T00:00:00+02:00", 2, "2024-01-03T00:00:00+01:00")]},
            {"type": "ID", "values": [value("2024-06-01T00:00:00+02:00", 9)]},
            {"type": "REALISED", "values": []},
            {"type": "REALISED"},
        ]},
        {"short_term": None}, {},
    )
    assert payloads.flatten_load(df).count() == 2 and payloads.flatten_load(df, None).count() == 3
    rows = payloads.load_table(df).collect()
    assert [(r["start_date"], r["consumption_mw"]) for r in rows] == [(datetime(2024, 5, 31, 22), 2.0)]


def test_damaged_payloads_lose_only_themselves(spark):
    whole = json.dumps({"short_term": [{"type": "REALISED", "values": [value("2024-06-01T00:00:00+02:00", 1)], "more": 1}], "extra": {}})
    texts = {0: whole, 1: whole[:-3], 2: None, 3: " ", 4: "[1]", 5: '{"short_term": 7}', 6: '{"short_term": null}', 7: "{}"}
    df = spark.createDataFrame(list(texts.items()), "id int, j string")
    good, rejected = payloads.parse_payloads(df, "j", payloads.LOAD_PAYLOAD)
    assert good.count() == 3 and [r["consumption_mw"] for r in payloads.flatten_load(good).collect()] == [1.0]
    assert {r["id"]: r["fault"] for r in rejected.collect()} == {1: "malformed", 2: "empty", 3: "empty", 4: "no object", 5: "shape"}


def test_mix_and_capacity_payloads(spark):
    mix = parsed(spark, payloads.MIX_PAYLOAD, {"generation_mix_15min_time_scale": [
        {"production_type": "WIND", "production_subtype": None, "values": [value("2024-01-01T00:00:00+01:00", 1), value("2024-01-01T00:00:00+01:00", 4, "2024-02-01T00:00:00+01:00")]},
        {"production_type": "NUCLEAR", "production_subtype": "TOTAL", "values": [value("2024-01-01T00:00:00+01:00", 2)]},
        {"production_type": "SOLAR", "values": None}, {"production_type": "SOLAR"},
    ]})
    assert payloads.flatten_mix(mix).count() == 3
    assert [(r["production_type"], r["production_subtype"], r["value_mw"]) for r in payloads.mix_table(mix).collect()] == [("WIND", None, 4.0)]
    capacity = parsed(spark, payloads.CAPACITY_PAYLOAD, {"capacities_per_production_type": [
        {"start_date": "x", "values": [value("2024-01-01T00:00:00+01:00", 5, type="GAS"), value("2024-01-01T00:00:00+01:00", 6, "2025-01-01T00:00:00+01:00", type="GAS")]}, {"values": None}]})
    assert [(r["production_type"], r["installed_capacity_mw"]) for r in payloads.capacity_table(capacity).collect()] == [("GAS", 6.0)]


@pytest.mark.parametrize("step,count", [(3600, 2), (900, 8)])
def test_hourly_payload(spark, step, count):
    values = [float(i) for i in range(count)]
    doc = {"city": "Paris", "time": 1711846800, "time_end": 1711846800 + 7200, "interval": step, **{v: values for v in payloads.WEATHER}}
    empty = {"city": "Void", "time": 10, "time_end": 10, "interval": step, **{v: [] for v in payloads.WEATHER}}
    rows = payloads.expand_hourly(parsed(spark, payloads.HOURLY_PAYLOAD, doc, empty)).orderBy("datetime").collect()
    assert [r["cloud_cover"] for r in rows] == values and {r["city"] for r in rows} == {"Paris"}
    assert rows[0]["datetime"] == datetime(2024, 3, 31, 1)
    assert (rows[1]["datetime"] - rows[0]["datetime"]).total_seconds() == step


def test_of_equal_updates_the_last_read_counts(spark):
    value = lambda v, update="2024-01-02T00:00:00Z": {"start_date": "2024-01-01T00:00:00Z", "end_date": "2024-01-01T01:00:00Z", "updated_date": update, "value": v}
    pages = [{"short_term": [{"type": "REALISED", "values": [value(9.0), value(5.0)]}, {"type": "REALISED", "values": [value(7.0), value(3.0), value(99.0, "2024-01-01T00:00:00Z")]}]}]
    df = spark.createDataFrame([(json.dumps(p),) for p in pages], "j string").select(F.from_json("j", payloads.LOAD_PAYLOAD).alias("p")).select("p.*")
    assert [r["consumption_mw"] for r in payloads.load_table(df).collect()] == [3.0]


def test_other_time_formats_and_dropped_rows(spark, tmp_path):
    write(tmp_path, "l1.csv", "datetime,load_mw\n2024/1/1 0:30,1\n2024-01-01 01:00:00,2\nx,3\n,4\n")
    path = str(tmp_path / "l*.csv")
    rows = files.read_load_long(spark, path, formats=["yyyy/M/d H:mm"]).select("datetime", "load_mw").collect()
    assert sorted(map(tuple, rows)) == [(datetime(2024, 1, 1, 0, 30), 1.0), (datetime(2024, 1, 1, 1), 2.0)]
    lost = lambda formats: files.rejected_rows(files.read_load_long(spark, path, formats, keep_untimed=True)).drop("path").collect()
    assert lost(()) == [("l1.csv", 4, 3, 0)]
    assert lost(["yyyy/M/d H:mm"]) == [("l1.csv", 4, 2, 0)]
