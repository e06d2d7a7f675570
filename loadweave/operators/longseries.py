"""Ordered computation over series of any length, without one task per series.

A window partitioned by series gives a long series to a single task. Here a
series is cut into pieces of its order column at sampled split points. Pieces
are computed in parallel and linked by a small summary table (one row per
series and piece). The sample only balances the pieces; results do not depend
on where the cuts fall. Rows of one series should differ in the order column,
which the deduplication operators ensure.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.functions.text import finite
from loadweave.functions.timeutil import epoch_seconds
from loadweave.session import stage

ROWS_PER_PIECE = 1_000_000
SAMPLE_PER_PIECE = 50
PIECE = "_piece"
KEY = "_series_piece"


def order_number(df: DataFrame, order: str) -> Column:
    """A double that never decreases along the order column."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.TimestampNTZType):
        return epoch_seconds(order).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(order).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(order).cast("double")
    return F.col(order).cast("double")


def default_pieces(rows: int, shuffles: int) -> int:
    return max(2, 2 * shuffles, -(-rows // ROWS_PER_PIECE))


def split_points(df: DataFrame, order: str, pieces: int | None = None) -> list[float]:
    """Ascending cuts that divide the rows about evenly.

    The number of pieces follows the rows, and is twice the number of shuffle
    partitions at least. One second is not cut: rows of the same second are in
    one piece, however many they are.
    """
    keys = df.select(order_number(df, order).alias("k"))
    rows = keys.count()
    pieces = pieces or default_pieces(rows, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = SAMPLE_PER_PIECE * pieces / max(rows, 1)
    if share < 1.0:
        keys = keys.sample(fraction=share, seed=42)
    shares = [i / pieces for i in range(1, pieces)]
    cuts = keys.agg(F.percentile_approx("k", shares, 10 * pieces)).first()[0]
    return sorted({cut for cut in cuts or [] if math.isfinite(cut)})


def with_pieces(df: DataFrame, order: str, pieces: int | None = None, cuts: list[float] | None = None) -> DataFrame:
    """Adds the piece number of each row; pieces ascend with the order column, nulls first."""
    cuts = split_points(df, order, pieces) if cuts is None else cuts
    if not cuts:
        return df.withColumn(PIECE, F.lit(0))
    binner = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_k", outputCol="_bin", handleInvalid="keep")
    binned = binner.transform(df.withColumn("_k", order_number(df, order)))
    return binned.withColumn(PIECE, F.coalesce(F.col("_bin").cast("int"), F.lit(-1))).drop("_k", "_bin")


def with_key(df: DataFrame, series: Sequence[str], piece: str = PIECE) -> DataFrame:
    """Adds the key of series and piece.

    With series it is a struct: structs are equal where their fields are equal
    or both null, so a plain join on it keeps null series, and the join, the
    aggregation and the windows on it all share one hash partitioning.
    """
    return df.withColumn(KEY, F.struct(*series, F.col(piece).alias(PIECE)) if series else F.col(piece))


def over_pieces(series: Sequence[str], backwards: bool = False):
    """Window over the summary rows of a series in piece order (one row per piece)."""
    piece = F.col(f"{KEY}.{PIECE}") if series else F.col(KEY)
    order = piece.desc() if backwards else piece.asc()
    return Window.partitionBy(*[F.col(f"{KEY}.{name}") for name in series]).orderBy(order)


def earlier_total(sizes: DataFrame, series: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier pieces of the series (summary rows only)."""
    earlier = over_pieces(series).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def number_rows(
    df: DataFrame,
    order: str | Column,
    series: Sequence[str] = (),
    name: str = "row",
    pieces: int | None = None,
    piece: str | None = None,
) -> DataFrame:
    """Adds the exact 0-based position of each row in its series.

    ``piece`` names a column that already cuts the series in order; else pieces
    are cut here at sampled values of ``order``.
    """
    tagged = with_key(df if piece else with_pieces(df, order, pieces), series, piece or PIECE)
    sizes = tagged.groupBy(KEY).agg(F.count(F.lit(1)).alias("_size"))
    offsets = earlier_total(sizes, series, "_size", "_offset").drop("_size")
    within = Window.partitionBy(KEY).orderBy(order)
    numbered = tagged.join(offsets, KEY).withColumn(name, F.row_number().over(within) - 1 + F.col("_offset"))
    return numbered.drop("_offset", KEY, PIECE)


def with_halo(df: DataFrame, row: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Cuts a numbered series into chunks and copies edge rows to the neighbours.

    Adds ``_chunk`` and ``_halo``; a window over a chunk then sees ``before``
    rows ahead of it and ``after`` rows behind it. Halo rows are dropped after.
    """
    if size < max(before, after):
        raise ValueError("a chunk must be at least as long as its halo")
    chunk = F.floor(F.col(row) / size)
    place = F.col(row) % size
    spots = [F.struct(chunk.alias("_chunk"), F.lit(False).alias("_halo"))]
    if before:
        spots.append(F.when(place >= size - before, F.struct((chunk + 1).alias("_chunk"), F.lit(True).alias("_halo"))))
    if after:
        spots.append(F.when(place < after, F.struct((chunk - 1).alias("_chunk"), F.lit(True).alias("_halo"))))
    copies = F.filter(F.array(*spots), lambda spot: spot.isNotNull())
    return df.withColumn("_spot", F.explode(copies)).select(*df.columns, "_spot._chunk", "_spot._halo")


def carried(
    df: DataFrame,
    order: str,
    last: dict[str, Column] | None = None,
    first: dict[str, Column] | None = None,
    series: Sequence[str] = (),
    piece: str = PIECE,
    inclusive: bool = True,
) -> DataFrame:
    """Adds the last value known up to each row, and the first one known from it on.

    ``last`` and ``first`` map output names to expressions; nulls are passed
    over. Within a piece this is a window; across pieces it is the value of the
    nearest piece that has one, found on the summary table.
    """
    last, first = last or {}, first or {}
    values = {**last, **first}
    prepared = with_key(df.withColumns({f"_v_{name}": value for name, value in values.items()}), series, piece)

    def edge(name: str) -> Column:
        known = F.when(F.col(f"_v_{name}").isNotNull(), F.col(order))
        return (F.max_by if name in last else F.min_by)(F.col(f"_v_{name}"), known).alias(f"_e_{name}")

    ends = prepared.groupBy(KEY).agg(*[edge(name) for name in values])
    # What follows is what comes before in descending order: such frames grow
    # by one row, while a frame that shrinks is evaluated anew for each row.
    start, step = Window.unboundedPreceding, 0 if inclusive else 1

    def nearest(prefix: str, name: str, by_piece: bool) -> Column:
        backwards = name not in last
        if by_piece:
            frame = over_pieces(series, backwards).rowsBetween(start, -1)
        else:
            frame = Window.partitionBy(KEY).orderBy(F.desc(order) if backwards else F.asc(order)).rowsBetween(start, -step)
        return F.last(f"{prefix}{name}", ignorenulls=True).over(frame)

    summary = ends.select(KEY, *[nearest("_e_", n, True).alias(f"_c_{n}") for n in values])
    filled = prepared.join(summary, KEY).withColumns(
        {n: F.coalesce(nearest("_v_", n, False), F.col(f"_c_{n}")) for n in values}
    )
    return filled.drop(KEY, *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Linearly interpolated quantiles, exact at any size and with any ties.

    Values are counted first, so a frequent value is one row. The piece that
    holds a wanted rank is found on the summary and only there values are ranked.
    """
    values = df.select(finite(column).alias("v")).where(F.col("v").isNotNull())
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    tagged = with_pieces(stage(counts, "value-counts"), "v")
    sizes = tagged.groupBy(PIECE).agg(F.sum("n").alias("_size"))
    table = [(r[PIECE], r["_size"]) for r in sizes.orderBy(PIECE).collect()]  # one row per piece
    total = sum(size for _, size in table)
    if not total:
        return [None for _ in shares]
    ranks = sorted({int(s * (total - 1)) for s in shares} | {min(int(s * (total - 1)) + 1, total - 1) for s in shares})
    starts, seen = {}, 0
    for piece, size in table:
        if any(seen <= rank < seen + size for rank in ranks):
            starts[piece] = seen
        seen += size
    wanted = tagged.where(F.col(PIECE).isin(list(starts)))
    base = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])
    upto = Window.partitionBy(PIECE).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = wanted.withColumn("end", F.sum("n").over(upto) + base[F.col(PIECE)]).withColumn("start", F.col("end") - F.col("n"))
    hit = F.lit(False)
    for rank in ranks:
        hit = hit | ((F.col("start") <= rank) & (F.col("end") > rank))
    found = [(r["start"], r["end"], r["v"]) for r in ranked.where(hit).collect()]  # one row per wanted rank

    def at(rank: int) -> float:
        return next(v for start, end, v in found if start <= rank < end)

    result = []
    for share in shares:
        place = share * (total - 1)
        low = int(place)
        below, above = at(low), at(min(low + 1, total - 1))
        result.append(below + (above - below) * (place - low))
    return result
