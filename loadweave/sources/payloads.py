"""Nested JSON payloads to flat rows.

Every function takes a DataFrame whose columns follow the schema constant next
to it, as ``spark.read.schema(...).json`` or ``from_json`` gives it. Arrays
that are null or absent give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.functions.timeutil import interval, utc_from_iso
from loadweave.operators.dedup import CAPACITY_KEY, INTERVAL_KEY, MIX_KEY, keep_last
from loadweave.operators.features import WEATHER

# Field names of the payloads and the block type of measured load.
LOAD_PAYLOAD = (
    "short_term array<struct<type: string, values: array<struct<"
    "start_date: string, end_date: string, updated_date: string, value: double>>>>"
)
MIX_PAYLOAD = (
    "generation_mix_15min_time_scale array<struct<production_type: string, production_subtype: string,"
    " values: array<struct<start_date: string, end_date: string, updated_date: string, value: double>>>>"
)
CAPACITY_PAYLOAD = (
    "capacities_per_production_type array<struct<start_date: string, end_date: string, values: array<struct<"
    "start_date: string, end_date: string, type: string, value: double, updated_date: string>>>>"
)
HOURLY_PAYLOAD = "city string, time bigint, time_end bigint, interval int, " + ", ".join(f"{v} array<double>" for v in WEATHER)
REALISED = "REALISED"
RENEWABLE_TYPES = ("SOLAR", "WIND")
DATES = ("start_date", "end_date", "updated_date")


PLACE = ("_row", "_block", "_value")


def parse_payloads(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON texts as (payloads, rejected): a damaged document loses only itself and is listed.

    payloads: the columns of the schema, fields that it does not name left out.
    rejected: the rows as they came with ``fault``: ``empty`` (null or blank),
    ``malformed`` (no JSON), ``no object``, or ``shape`` (a field of the schema holds
    something that is not of its type).
    """
    kind = T.StructType.fromDDL(schema)
    document = F.try_parse_json(F.col(column))
    parsed = df.withColumns({"_v": document, "_p": F.try_variant_get(document, "$", kind.simpleString())})

    def misshapen(name: str):
        held = F.try_variant_get("_v", f"$.{name}", "variant")
        return held.isNotNull() & ~F.is_variant_null(held) & F.col("_p").getField(name).isNull()

    shape = F.col("_p").isNull()
    for name in kind.names:
        shape = shape | misshapen(name)
    blank = F.coalesce(F.trim(column), F.lit("")) == ""
    fault = (
        F.when(blank, "empty").when(F.col("_v").isNull(), "malformed")
        .when(~F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), "no object").when(shape, "shape")
    )
    judged = parsed.withColumn("_fault", fault)
    good = judged.where(F.col("_fault").isNull()).select("_p.*")
    return good, judged.where(F.col("_fault").isNotNull()).select(*df.columns, F.col("_fault").alias("fault"))


def _values(df: DataFrame, blocks: str, *of_block: str) -> DataFrame:
    """Every value of every block as ``v`` with fields of its block, and its place in scan order."""
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.posexplode(blocks).alias("_block", "b"))
    return rows.select("_row", "_block", "b.*").select("_row", "_block", *of_block, F.posexplode("values").alias("_value", "v"))


def _flat_load(df: DataFrame, only_type: str | None) -> DataFrame:
    values = _values(df, "short_term", "type")
    if only_type:
        values = values.where(F.col("type") == only_type)
    return values.select(*[F.col(f"v.{d}").alias(d) for d in DATES], F.col("v.value").alias("consumption_mw"), *PLACE)


def _flat_mix(df: DataFrame) -> DataFrame:
    values = _values(df, "generation_mix_15min_time_scale", "production_type", "production_subtype")
    return values.select("production_type", "production_subtype", *[F.col(f"v.{d}").alias(d) for d in DATES], F.col("v.value").alias("value_mw"), *PLACE)


def _flat_capacity(df: DataFrame) -> DataFrame:
    values = _values(df, "capacities_per_production_type")
    dates = [F.col(f"v.{d}").alias(d) for d in DATES]
    return values.select(F.col("v.type").alias("production_type"), *dates, F.col("v.value").alias("installed_capacity_mw"), *PLACE)


def flatten_load(df: DataFrame, only_type: str | None = REALISED) -> DataFrame:
    """start_date, end_date, updated_date, consumption_mw; only measured blocks unless told otherwise."""
    return _flat_load(df, only_type).drop(*PLACE)


def flatten_mix(df: DataFrame) -> DataFrame:
    """Type and subtype of the block on every value of it."""
    return _flat_mix(df).drop(*PLACE)


def flatten_capacity(df: DataFrame) -> DataFrame:
    return _flat_capacity(df).drop(*PLACE)


def expand_hourly(df: DataFrame, variables: tuple[str, ...] = WEATHER, entity: str = "city") -> DataFrame:
    """Parallel arrays with start, end (exclusive) and step in seconds to one row per time."""
    valid = df.where((F.col("time_end") > F.col("time")) & (F.col("interval") > 0))
    axis = F.sequence(F.col("time"), F.col("time_end") - 1, F.col("interval").cast("bigint"))
    zipped = F.arrays_zip(axis.alias("second"), *[F.col(v) for v in variables])
    rows = valid.select(entity, F.explode(zipped).alias("r")).where(F.col("r.second").isNotNull())
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    when = start + interval(days=F.floor(F.col("r.second") / 86400).cast("int"), seconds=(F.pmod("r.second", F.lit(86400))).cast("decimal(18,6)"))
    return rows.select(when.alias("datetime"), *[F.col(f"r.{v}").alias(v) for v in variables], entity)


def to_utc(df: DataFrame, *columns: str) -> DataFrame:
    """Offset text to naive UTC in each column."""
    return df.withColumns({c: utc_from_iso(c) for c in columns or DATES})


def _latest(flat: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The latest update of each key; of equal updates the one that was read last."""
    return keep_last(to_utc(flat), key, ["updated_date", *PLACE]).drop(*PLACE)


def load_table(payloads: DataFrame) -> DataFrame:
    """Measured load in UTC, one row per interval, the latest update of it."""
    return _latest(_flat_load(payloads, REALISED), INTERVAL_KEY)


def mix_table(payloads: DataFrame, types: tuple[str, ...] | None = RENEWABLE_TYPES) -> DataFrame:
    """Generation in UTC of the given types, the latest update per type and interval."""
    flat = _flat_mix(payloads)
    kept = flat if types is None else flat.where(F.col("production_type").isin(*types))
    return _latest(kept, MIX_KEY)


def capacity_table(payloads: DataFrame) -> DataFrame:
    return _latest(_flat_capacity(payloads), CAPACITY_KEY)
