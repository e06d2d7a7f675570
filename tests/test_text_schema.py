import warnings

import pytest
from pyspark.sql import functions as F

from loadweave.functions import schema as S
from loadweave.functions import text as X
from loadweave.functions.calendar import holiday_table


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression).first()[0]


@pytest.mark.parametrize(
    "text,value",
    [("1 234,5", 1234.5), ("1 000", 1000.0), ("-", 0.0), ("", 0.0), (None, 0.0), ("n.c.", None), ("-12,25", -12.25), ("1d", None), ("nan", None), ("1e3", 1000.0)],
)
def test_report_numbers(spark, text, value):
    assert one(spark, X.report_number("v"), text) == value


def test_labels_become_unique(spark):
    labels = ["Heures", "Gaz", " Gaz ", "", "nan", "Gaz", None and ""]
    got = one(spark, X.unique_labels("v"), [x for x in labels if x is not None], "array<string>")
    assert got == ["Heures", "Gaz", "Gaz__2", "Unnamed", "Unnamed__2", "Gaz__3"]


def test_hours(spark):
    cells = ["x", " 9:00 – 10:00", "11:00-12:00"]
    assert one(spark, X.hour_interval("v", 2), cells, "array<string>") == "11:00-12:00"
    assert one(spark, X.hour_interval("v", 0), cells, "array<string>") == " 9:00 – 10:00"
    assert one(spark, X.hour_interval("v", 7), ["x"], "array<string>") is None
    for blank in "\u00a0\u202f\u2009\x1c":
        cell = f"{blank}9:00{blank}-{blank}10:00{blank}"
        assert one(spark, X.hour_interval("v", 0), [cell], "array<string>") == cell
        assert one(spark, X.interval_start_minutes("v"), cell) == 540
    assert one(spark, X.interval_start_minutes("v"), "9:30-10:00") == 570
    assert one(spark, X.interval_start_minutes("v"), "24:00-25:00") is None


def test_strip_takes_every_blank(spark):
    assert one(spark, X.strip("v"), " \t x y  \x1c") == "x y"
    assert one(spark, X.unquote("v"), ' ""a "b" c" ') == 'a "b" c'


def test_date_and_header_lines(spark):
    assert one(spark, X.date_text("v"), "DONNÉES du 01/02/2024 au 03/02/2024") == "01/02/2024"
    assert one(spark, X.date_text("v"), "Total 01/02/2024") is None
    assert one(spark, X.is_header_line("v"), "x;NUCLÉAIRE") is True
    assert one(spark, X.hour_position("v"), ["a", "Heures", "heures"], "array<string>") == 1
    assert one(spark, X.hour_position("v"), ["a"], "array<string>") == 0


def test_name_repair(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF(" Datetime ", "X", "DATETIME")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        fixed = S.first_of_each_name(S.normalise_names(df))
    assert fixed.columns == ["datetime", "x"] and fixed.first() == (1, 2)
    assert any("duplicate" in str(w.message) for w in seen)


@pytest.mark.parametrize(
    "columns,source",
    [
        (["datetime", "valeur", "load_mw"], "load_mw"),
        (["datetime", "x", "valeur", "conso_mw"], "valeur"),
        (["datetime", "x", "y"], "x"),
    ],
)
def test_load_alias(spark, columns, source):
    df = spark.createDataFrame([tuple(float(i) for i in range(len(columns)))], ", ".join(f"{c} double" for c in columns))
    aliased = S.alias_load(df)
    assert aliased.select("load_mw").first()[0] == float(columns.index(source))


def test_load_alias_skips_text_and_fails_without_numbers(spark):
    df = spark.createDataFrame([("a", "1.5"), ("b", None)], "label string, reading string")
    assert [r["load_mw"] for r in S.alias_load(df).orderBy("label").collect()] == [1.5, None]
    with pytest.raises(ValueError, match="numeric"):
        S.alias_load(spark.createDataFrame([("a",)], "label string"))


def test_required_optional_and_empty_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    with pytest.raises(ValueError, match="city"):
        S.require_columns(df, "city")
    assert S.require_columns(df, ("x", "a")) is df
    assert S.drop_empty_columns(df).columns == ["a"]
    assert S.drop_empty_columns(df, keep=("b",)).columns == ["a", "b"]
    assert S.optional_column(df, "statut").first()["statut"] is None
    assert S.optional_column(df, "s", "string", "a").first()["s"] == "1"


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),)], "x double")
    assert df.agg(F.avg(X.finite("x"))).first()[0] == 1.0


def test_known_holidays(spark):
    days = {str(r["day"]): r["holiday"] for r in holiday_table(spark, 2023, 2024).collect()}
    assert len(days) == 22
    for day in ("2023-04-10", "2023-05-18", "2023-05-29", "2024-04-01", "2024-05-09", "2024-05-20", "2024-07-14"):
        assert day in days
    # Ascension 2008 fell on 1 May.
    assert holiday_table(spark, 2008, 2008).count() == 10
