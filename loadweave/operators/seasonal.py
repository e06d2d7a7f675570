"""An additive model of a load series, and gap filling by it.

The value is a constant, a trend that may bend at given knots, waves over the
day, the week and the year, and a step on holidays. Spark sums the products of
all terms in one aggregation with partial sums per task; the driver solves as
many equations as there are terms, whatever the length of the series.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from datetime import datetime
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.functions.calendar import with_holiday_flag
from loadweave.functions.text import finite
from loadweave.functions.timeutil import epoch_seconds, naive
from loadweave.operators.stress import fill_gaps
from loadweave.session import stage

#: Days of each period and the number of waves in it.
WAVES = {"day": (1.0, 2), "week": (7.0, 2), "year": (365.25, 1)}


def seasonal_terms(
    time: str, origin: datetime | str, waves: Mapping[str, tuple[float, int]] = WAVES, knots: Sequence[datetime | str] = (), holiday: str | None = None
) -> dict[str, Column]:
    """The terms of the model by name. Trends count in units of 100 days from ``origin``."""

    def days_since(start) -> Column:
        return (epoch_seconds(time) - epoch_seconds(naive(start))) / F.lit(86400.0)

    days = days_since(origin)
    terms = {"level": F.lit(1.0), "trend": days / 100}
    terms |= {f"trend_{i}": F.greatest(days_since(knot), F.lit(0.0)) / 100 for i, knot in enumerate(knots, 1)}
    for name, (period, count) in waves.items():
        for k in range(1, count + 1):
            angle = days * F.lit(2 * math.pi * k / period)
            terms |= {f"{name}_sin_{k}": F.sin(angle), f"{name}_cos_{k}": F.cos(angle)}
    if holiday:
        terms["holiday"] = F.col(holiday).cast("double")
    return terms


def design_means(df: DataFrame, terms: Mapping[str, Column], value: str) -> DataFrame:
    """(left, right, mean): the mean product of each two terms, and of each term and the value, over rows with a finite value."""
    columns = {**terms, "value": finite(value)}
    rows = df.select(*[c.alias(n) for n, c in columns.items()]).where(F.col("value").isNotNull())
    pairs = [(a, b) for a, b in combinations_with_replacement(columns, 2) if a != "value"]
    means = rows.agg(*[F.avg(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs])
    listed = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{a}*{b}").alias("mean")) for a, b in pairs])
    return means.select(F.inline(listed))


def fit_seasonal(df: DataFrame, terms: Mapping[str, Column], value: str) -> dict[str, float]:
    """Weight of each term by least squares; all 0 without a value.

    Of terms that the rows cannot tell apart (a year's wave over a month, say)
    the solution of least length is taken.
    """
    names = list(terms)
    at = {name: i for i, name in enumerate(names)}
    products, sides = np.zeros((len(names), len(names))), np.zeros(len(names))
    for left, right, mean in design_means(df, terms, value).collect():  # one row per pair of terms
        if right == "value":
            sides[at[left]] = mean or 0.0
        else:
            products[at[left], at[right]] = products[at[right], at[left]] = mean or 0.0
    solved = np.linalg.lstsq(products, sides, rcond=1e-11)[0]
    return dict(zip(names, solved.tolist()))


def predicted(terms: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    for name, term in terms.items():
        total = total + term * F.lit(weights[name])
    return total


def fill_gaps_by_season(
    df: DataFrame,
    time: str = "datetime",
    value: str = "load_mw",
    minutes: int = 60,
    origin: datetime | str = "2024-01-01 00:00:00",
    waves: Mapping[str, tuple[float, int]] = WAVES,
    knots: Sequence[datetime | str] = (),
    holidays: DataFrame | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """A regular series whose holes are filled; adds ``filled_from`` (observed, last_week or season).

    As ``fill_gaps``, but where last week's value is missing too the model
    answers instead of a straight line, at the ends of the series as well. The
    model is fitted on the observed steps. A series without any value stays null.
    """
    filled = stage(fill_gaps(df, time, value, minutes, pieces=pieces), "filled")
    if holidays is not None:
        filled = with_holiday_flag(filled, time, holidays)
    terms = seasonal_terms(time, origin, waves, knots, "is_holiday" if holidays is not None else None)
    observed = filled.where(F.col("filled_from") == "observed")
    weights = fit_seasonal(observed, terms, value)
    known = F.col("filled_from").isin("observed", "last_week")
    some = F.lit(any(weights.values()))
    return filled.select(
        time,
        F.when(known, F.col(value)).when(some, predicted(terms, weights)).alias(value),
        F.when(known, F.col("filled_from")).when(some, F.lit("season")).alias("filled_from"),
    )
