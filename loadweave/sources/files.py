"""CSV, Parquet and text files of load, weather, cities and capacity.

Text-based files are read as text columns and typed by explicit rules. Rows
carry the name and the path of their file and, under ``_block`` and ``_id``, their
place in it: the start of the file split and a counter within the scan. Sorting by
path and place gives file order, then row order, however the scan was split. Files
are told apart by path: two folders may hold files of one name.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.functions.schema import (
    alias_load,
    cast_numeric_texts,
    drop_if_present,
    drop_null_keys,
    first_of_each_name,
    normalise_names,
    require_columns,
)
from loadweave.functions.text import decimal_comma, number, strip
from loadweave.functions.timeutil import parse_years, utc_from_text
from loadweave.operators.align import union_all
from loadweave.session import stage

FILE_ORDER = ("path", "_block", "_id")
PLACE = ("file", *FILE_ORDER)
# Canonical stem of the yearly load files and the order of preference.
WIDE_STEM = "Historique_consommation_INST_{year}"
WIDE_SUFFIXES = ("parquet", "csv", "xlsx", "xls")
WIDE_PATH = r"^(.*?/(\d{4})/([^/]+\.(parquet|csv|xlsx|xls)))(/.*)?$"  # entry, year, name, suffix
CAPACITY_HEADER = r"^Type;(\d{4})$"


def raw_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every line of the files and its place, scanned once: value, path, file, _block, _id."""
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    return stage(lines, "lines")


def listed_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, path of every file, from the listing alone."""
    listed = spark.read.format("binaryFile").load(paths)
    return listed.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path")).distinct()


def read_csv_by_header(spark: SparkSession, paths: str | list[str]) -> list[DataFrame]:
    """One DataFrame of text columns per distinct header, names repaired; an error if no file has a header.

    The header of a file is its first line that is not blank. The text is scanned
    once; headers are found on the stored lines and joined back by path, and only the
    distinct ones reach the driver. The stored lines are read once per distinct header.
    """
    lines = raw_lines(spark, paths)
    body = lines.where(F.trim(F.replace("value", F.lit("\ufeff"))) != "")
    place = F.struct("_block", "_id")
    first = body.groupBy("path").agg(F.min_by("value", place).alias("head"), F.min_by("_id", place).alias("_first"))
    first = stage(first, "headers")
    heads = sorted((r["path"], r["head"]) for r in first.groupBy("head").agg(F.min("path").alias("path")).collect())
    if not heads:
        raise ValueError(f"no file with a header in {paths}")
    frames = []
    for _, head in heads:
        names = next(csv.reader([head.lstrip("\ufeff")]))
        own = body.join(first.where(F.col("head") == head).select("path", "_first"), "path").where("_id <> _first")
        schema = ", ".join(f"_c{i} string" for i in range(len(names)))
        placed = own.select(F.from_csv("value", schema).alias("r"), *PLACE).select("r.*", *[F.col(c).alias(f"_p_{c}") for c in PLACE])
        # The place is named apart: a header may have a column `path` or `file` of its own.
        frames.append(first_of_each_name(normalise_names(placed.toDF(*names, *[f"_p_{c}" for c in PLACE]))))
    return frames


def _placed(df: DataFrame) -> DataFrame:
    """The place of the rows under its own names; columns of the file that are named so go."""
    own = [c for c in PLACE if f"_p_{c}" in df.columns]
    return df.drop(*own).withColumnsRenamed({f"_p_{c}": c for c in own})


def clean_load(df: DataFrame, formats: Sequence[str] = (), keep_untimed: bool = False) -> DataFrame:
    """datetime, load_mw and the place of the row; rows without a valid time drop out unless they are to be counted."""
    require_columns(df, "datetime")
    timed = df.withColumn("datetime", utc_from_text("datetime", formats))
    timed = timed if keep_untimed else drop_null_keys(timed, "datetime")
    bare = PLACE if not any(c.startswith("_p_") for c in df.columns) else ()
    value = alias_load(drop_if_present(timed, "statut", "slot_index", "date", "year").withColumnsRenamed({c: f"_p_{c}" for c in bare}))
    return _placed(value.select("datetime", "load_mw", *[f"_p_{c}" for c in PLACE if f"_p_{c}" in value.columns]))


def rejected_rows(load: DataFrame) -> DataFrame:
    """file, path, rows_read, no_time, no_number of rows read with ``keep_untimed``.

    no_number: rows with a time whose value is no number, or none at all.
    """
    untimed, valueless = F.col("datetime").isNull(), F.col("datetime").isNotNull() & F.col("load_mw").isNull()
    return load.groupBy("file", "path").agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(untimed).alias("no_time"), F.count_if(valueless).alias("no_number"))


def read_load_long(spark: SparkSession, paths: str | list[str], formats: Sequence[str] = (), keep_untimed: bool = False) -> DataFrame:
    """Long load files in UTC: datetime, load_mw, file, path, _block, _id. Raises if there is no file.

    formats: of times that are not ISO text, tried in order. keep_untimed: rows
    without a valid time stay, with a null one.
    """
    return union_all(*[clean_load(frame, formats, keep_untimed) for frame in read_csv_by_header(spark, paths)])


def clean_weather(df: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """Named, timed and trimmed city weather; rows without city or time drop out."""
    named = require_columns(normalise_names(_placed(df)), "city", ("datetime", "date"))
    source = "datetime" if "datetime" in named.columns else "date"
    kind = dict(named.dtypes)[source]
    time = utc_from_text(source, formats) if kind == "string" else F.col(source).cast("timestamp_ntz")
    timed = drop_if_present(named.withColumn("datetime", time), "date")
    return drop_null_keys(timed, "city", "datetime").withColumn("city", strip("city"))


def read_weather(spark: SparkSession, paths: str | list[str], formats: Sequence[str] = ()) -> DataFrame:
    """City weather files, united by column name; numeric text becomes double.

    The time column is found file by file, so files that call it ``date`` and
    files that call it ``datetime`` can be read together.
    """
    frames = [clean_weather(frame, formats) for frame in read_csv_by_header(spark, paths)]
    return cast_numeric_texts(union_all(*frames), exclude=("city", "file", "path"))


def choose_wide_files(spark: SparkSession, root: str, years: str) -> dict[int, str]:
    """The file to read for each year below ``root/<year>/``.

    The canonical name comes first, then Parquet, CSV and other formats. A
    directory written by Spark under such a name counts as a file.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    groups = {"entry": 1, "year": 2, "name": 3, "suffix": 4}
    parts = listed.select(*[F.regexp_extract("path", WIDE_PATH, i).alias(n) for n, i in groups.items()])
    wanted = parts.where(F.col("year").isin([str(y) for y in parse_years(years)])).distinct()
    stem = F.replace(F.lit(WIDE_STEM), F.lit("{year}"), F.col("year"))
    canonical = F.col("name") == F.concat(stem, F.lit("."), F.col("suffix"))
    rank = F.array_position(F.array(*[F.lit(s) for s in WIDE_SUFFIXES]), F.col("suffix"))
    best = wanted.groupBy("year").agg(F.min_by("entry", F.struct(~canonical, rank, F.col("name"))).alias("entry"))
    return {int(r["year"]): unquote(r["entry"]) for r in best.collect()}  # one row per year


def read_wide_file(spark: SparkSession, path: str) -> DataFrame:
    """One wide Parquet file with its row order under ``_row``."""
    if not path.endswith(".parquet"):
        raise NotImplementedError(f"spreadsheets are not read, convert to CSV or Parquet: {path}")
    return spark.read.parquet(path).withColumn("_row", F.monotonically_increasing_id())


def read_wide_texts(spark: SparkSession, paths: list[str]) -> dict[int, DataFrame]:
    """Wide CSV files by the year in their path: text columns, their row order under ``_row``.

    All files are scanned once and their headers dropped in one join; one row per year
    reaches the driver. The frame of a year is a filter on the stored lines. The
    separator is the more frequent one of ; and , in the header, the first line that is
    not blank. Of equal names the later ones get their position appended.
    """
    lines = raw_lines(spark, paths).withColumn("year", F.regexp_extract("path", WIDE_PATH, 2).cast("int"))
    body = lines.where(F.trim(F.replace("value", F.lit("\ufeff"))) != "")
    place = F.struct("_block", "_id")
    first = body.groupBy("year", "path").agg(F.min_by("value", place).alias("head"), F.min_by("_id", place).alias("_first"))
    first = stage(first, "wide-headers")
    rows = stage(body.join(first.select("path", "_first"), "path").where("_id <> _first").select("year", "value", "_id"), "wide-lines")
    frames = {}
    for r in sorted(first.groupBy("year").agg(F.min_by("head", "path").alias("head")).collect()):
        head = r["head"].lstrip("\ufeff")
        sep = ";" if head.count(";") > head.count(",") else ","
        cells = next(csv.reader([head], delimiter=sep))
        names = [f"{name}{i}" if name in cells[:i] else name or f"_c{i}" for i, name in enumerate(cells)]
        schema = ", ".join(f"_c{i} string" for i in range(len(names)))
        parsed = rows.where(F.col("year") == r["year"]).select(F.from_csv("value", schema, {"sep": sep}).alias("r"), F.col("_id").alias("_row"))
        frames[r["year"]] = parsed.select("r.*", "_row").toDF(*names, "_row")
    return frames


def read_load_wide(spark: SparkSession, root: str, years: str) -> dict[int, DataFrame]:
    """Wide yearly load files by year; years without a file are absent. Raises if a CSV file has no header."""
    chosen = choose_wide_files(spark, root, years)
    texts = {year: path for year, path in chosen.items() if path.endswith(".csv")}
    frames = {year: read_wide_file(spark, path) for year, path in chosen.items() if year not in texts}
    if texts:
        frames |= read_wide_texts(spark, list(texts.values()))
    missing = [path for year, path in chosen.items() if year not in frames]
    if missing:
        raise ValueError(f"no header in {', '.join(missing)}")
    return dict(sorted(frames.items()))


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """City reference: city, population, weight (decimal comma), latitude, longitude."""
    schema = "city string, population string, weight string, latitude string, longitude string"
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return raw.select(
        strip("city").alias("city"),
        number(F.trim("population")).cast("long").alias("population"),
        decimal_comma("weight").alias("weight"),
        number(F.trim("latitude")).alias("latitude"),
        number(F.trim("longitude")).alias("longitude"),
    )


def read_capacity_year(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Annual capacity files: year (from the header), production_type, installed_capacity_mw.

    Title, blank lines and the legal footer do not have the shape of a row.
    """
    lines = spark.read.text(paths).select(strip("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    years = (
        lines.where(F.col("line").rlike(CAPACITY_HEADER))
        .groupBy("path")
        .agg(F.max(F.regexp_extract("line", CAPACITY_HEADER, 1).cast("int")).alias("year"))
    )
    cells = lines.withColumn("cells", F.split("line", ";")).where(F.size("cells") == 2)
    rows = cells.select("path", strip(F.get("cells", F.lit(0))).alias("production_type"), decimal_comma(F.get("cells", F.lit(1))).alias("installed_capacity_mw"))
    valued = rows.where((F.col("production_type") != "Type") & F.col("installed_capacity_mw").isNotNull())
    return valued.join(years, "path").select("year", "production_type", "installed_capacity_mw")
