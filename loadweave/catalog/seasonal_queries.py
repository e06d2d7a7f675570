"""The seasonal model of the load, and gaps filled by it."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from loadweave.catalog.registry import HALF_HOUR_LOAD, SCALES, half_hour_load, query, readings, rounded
from loadweave.operators.seasonal import WAVES, design_means, fill_gaps_by_season, seasonal_terms

ORIGIN = "2024-01-01 00:00:00"
KNOT = "2024-01-15 00:00:00"


def _terms_sql(time: str) -> dict[str, str]:
    since = "(epoch({}) - epoch(TIMESTAMP '{}')) / 86400.0"
    days = since.format(time, ORIGIN)
    terms = {"level": "1.0", "trend": f"{days} / 100", "trend_1": f"greatest({since.format(time, KNOT)}, 0) / 100"}
    for name, (period, count) in WAVES.items():
        for k in range(1, count + 1):
            angle = f"{days} * CAST({2 * math.pi * k / period!r} AS DOUBLE)"
            terms |= {f"{name}_sin_{k}": f"sin({angle})", f"{name}_cos_{k}": f"cos({angle})"}
    return terms | {"value": "load_mw"}


def _design_sql() -> str:
    columns = _terms_sql("datetime")
    pairs = [(a, b) for a, b in combinations_with_replacement(columns, 2) if a != "value"]
    listed = " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(avg({a} * {b}), 6) AS mean FROM t" for a, b in pairs)
    return f"WITH t AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {n}' for n, c in columns.items())} FROM {HALF_HOUR_LOAD} WHERE load_mw IS NOT NULL) {listed}"


@query("seasonal_design", _design_sql())
def seasonal_design(spark, folder):
    """The sums behind the normal equations, as means over all half hours."""
    return rounded(design_means(half_hour_load(spark, folder), seasonal_terms("datetime", ORIGIN, knots=[KNOT]), "load_mw"), "mean")


@query(
    "seasonal_gap_fill",
    f"""WITH m AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS datetime, avg(value * CAST({SCALES[0]} AS DOUBLE)) AS load_mw FROM events GROUP BY 1),
        g AS (SELECT unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 MINUTE)) AS datetime FROM m)
        SELECT g.datetime, round(coalesce(m.load_mw, w.load_mw), 6) AS known_mw, true AS filled,
               CASE WHEN m.load_mw IS NOT NULL THEN 'observed' WHEN w.load_mw IS NOT NULL THEN 'last_week' ELSE 'season' END AS filled_from
        FROM g LEFT JOIN m ON m.datetime = g.datetime LEFT JOIN m w ON w.datetime = g.datetime - INTERVAL 7 DAY""",
)
def seasonal_gap_fill(spark, folder):
    """Load by the minute, holes filled. Values of the model are told by ``filled`` alone; unit tests compare them."""
    load = readings(spark, folder).select("datetime", (F.col("load_mw") * SCALES[0]).alias("load_mw"))
    result = fill_gaps_by_season(load, minutes=1, origin=ORIGIN, knots=[KNOT])
    known = F.when(F.col("filled_from") != "season", F.round("load_mw", 6))
    return result.select("datetime", known.alias("known_mw"), F.col("load_mw").isNotNull().alias("filled"), "filled_from")
