"""One row per key: first, last or mean.

All three are aggregations, not windows: rows combine before the shuffle, so a
key that holds a large part of the data sends one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns that identify a row in each kind of table.
LOAD_FILE_KEY = ("datetime", "date", "year", "statut", "slot_index")
REPORT_KEY = ("datetime", "date", "year", "hour_interval", "technology")
MIX_KEY = ("production_type", "production_subtype", "start_date", "end_date")
CAPACITY_KEY = ("production_type", "start_date", "end_date")
INTERVAL_KEY = ("start_date", "end_date")

_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order, nulls first; null keys are equal."""
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key in the given order, nulls before all values; null keys are equal."""
    return _keep(df, keys, order, F.max_by)


def _keep(df, keys, order, pick):
    rest = [name for name in df.columns if name not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    ordering = [F.col(o) if isinstance(o, str) else o for o in order]
    if len(ordering) == 1 and isinstance(order[0], str) and not df.schema[order[0]].nullable and all(_fixed(df, name) for name in [*rest, order[0]]):
        # Fixed-width buffers: a hash aggregation without any sort. It would pass over rows
        # with a null order, so it serves only where there can be none; structs order them.
        chosen = df.groupBy(*keys).agg(*[pick(name, order[0]).alias(name) for name in rest])
        return chosen.select(*df.columns)
    best = pick(F.struct(*rest), F.struct(*ordering)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def _fixed(df: DataFrame, name: str) -> bool:
    kind = df.schema[name].dataType
    return isinstance(kind, _FIXED) and not isinstance(kind, T.DecimalType)


def mean_per_key(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean of the value per full key; nulls are skipped, null keys stay."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))
