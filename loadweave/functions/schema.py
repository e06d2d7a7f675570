"""Schema repair: names, aliases, optional and empty columns, required columns."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.functions.text import finite, number

# Names under which the load column is accepted.
LOAD_NAME = "load_mw"
LOAD_ALIASES = ("consumption_mw", "conso_mw", "valeur")


def normalise_names(df: DataFrame) -> DataFrame:
    """Column names trimmed and in lower case, by position."""
    return df.toDF(*[name.strip().lower() for name in df.columns])


def first_of_each_name(df: DataFrame) -> DataFrame:
    """Of columns with equal names the first stays; the others are reported and dropped."""
    names = df.columns
    keep = [i for i, name in enumerate(names) if name not in names[:i]]
    if len(keep) == len(names):
        return df
    warnings.warn(f"duplicate columns dropped: {sorted({n for n in names if names.count(n) > 1})}", stacklevel=2)
    by_position = df.toDF(*[f"_{i}" for i in range(len(names))])
    return by_position.select(*[F.col(f"_{i}").alias(names[i]) for i in keep])


def require_columns(df: DataFrame, *groups: str | tuple[str, ...]) -> DataFrame:
    """Each group names one column, or alternatives of which one must exist."""
    for group in groups:
        wanted = (group,) if isinstance(group, str) else group
        if not any(name in df.columns for name in wanted):
            raise ValueError(f"missing column {' or '.join(wanted)}; present: {df.columns}")
    return df


def drop_null_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.na.drop(subset=list(keys))


def drop_if_present(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def drop_empty_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop columns without a single value: one counting pass, then a projection."""
    names = [name for name in df.columns if name not in keep]
    if not names:
        return df
    counts = df.agg(*[F.count(name).alias(name) for name in names]).first()
    filled = {name for name in names if counts[name]}
    return df.select(*[name for name in df.columns if name in keep or name in filled])


def optional_column(df: DataFrame, name: str, kind: str = "string", source: str | None = None) -> DataFrame:
    """``name`` from ``source`` if that column exists, else null."""
    source = source or name
    value = F.col(source) if source in df.columns else F.lit(None)
    return df.withColumn(name, value.cast(kind))


def tag(df: DataFrame, name: str, value: Column | str | int) -> DataFrame:
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def numeric_texts(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Text columns in which every value parses as a number; one aggregation."""
    texts = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in exclude and not f.name.startswith("_")
    ]
    if not texts:
        return []
    bad = [F.count(F.when(F.col(c).isNotNull() & number(F.trim(F.col(c))).isNull(), 1)).alias(c) for c in texts]
    counts = df.agg(*bad).first()
    return [c for c in texts if counts[c] == 0]


def cast_numeric_texts(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Columns read as text become doubles where all their values are numbers."""
    return df.withColumns({c: number(F.trim(F.col(c))) for c in numeric_texts(df, exclude)})


def load_column(df: DataFrame) -> str:
    """Name of the load column: its own name, an alias, else the first numeric column.

    Columns read as text count as numeric if no value in them fails to parse;
    that check is one aggregation and runs only when no name matches.
    """
    if LOAD_NAME in df.columns:
        return LOAD_NAME
    for name in df.columns:
        if name in LOAD_ALIASES:
            return name
    numeric = set(numeric_columns(df, ("datetime",))) | set(numeric_texts(df, ("datetime",)))
    for name in df.columns:
        if name in numeric and not name.startswith("_"):
            return name
    raise ValueError(f"no numeric load column; present: {df.columns}")


def alias_load(df: DataFrame) -> DataFrame:
    """The load column under its own name, as a double without NaN."""
    found = load_column(df)
    value = F.col(found)
    if isinstance(df.schema[found].dataType, T.StringType):
        value = number(F.trim(value))
    return df.withColumn(found, finite(value)).withColumnRenamed(found, LOAD_NAME)
