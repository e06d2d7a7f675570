"""Text expressions for report lines: labels, dates, hours and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadweave.functions.timeutil import col

# Report patterns and header words that results depend on.
DATE_LINE = r"(?i)(?:r.al|donn).*?(\d{2}/\d{2}/\d{4})"
# White space as in BLANKS below: exports use no-break spaces.
BLANK = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"
HOUR_INTERVAL = rf"^{BLANK}(\d{{1,2}}:\d{{2}}){BLANK}[-–]{BLANK}(\d{{1,2}}:\d{{2}}){BLANK}$"
HEADER_WORDS = ("heures", "biomasse", "filière", "nucléaire")
HOUR_WORD = "heures"
NO_LABEL = "Unnamed"

# Every character the Unicode standard counts as white space, plus the four
# information separators.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(text: Column | str) -> Column:
    """Trim white space of any kind from both ends."""
    return F.btrim(col(text), F.lit(BLANKS))


def unquote(text: Column | str) -> Column:
    return strip(F.btrim(strip(text), F.lit('"')))


def unique_labels(labels: Column | str) -> Column:
    """Header labels made unique: blank becomes a placeholder, repeats are numbered."""

    def named(label: Column) -> Column:
        return F.when((label == "") | (F.lower(label) == "nan"), F.lit(NO_LABEL)).otherwise(label)

    def numbered(all_labels: Column):
        def one(label: Column, position: Column) -> Column:
            seen = F.size(F.filter(F.slice(all_labels, F.lit(1), position + 1), lambda other: other == label))
            return F.when(seen == 1, label).otherwise(F.concat(label, F.lit("__"), seen.cast("string")))

        return one

    # The outer transform binds the cleaned labels to a variable, so they are computed once.
    names = F.transform(F.transform(col(labels), strip), named)
    return F.get(F.transform(F.array(names), lambda every: F.transform(every, numbered(every))), F.lit(0))


def is_date_line(text: Column | str) -> Column:
    return col(text).rlike(DATE_LINE)


def date_text(text: Column | str) -> Column:
    """The dd/MM/yyyy of a date line; null if the line has none."""
    return F.nullif(F.regexp_extract(col(text), DATE_LINE, 1), F.lit(""))


def is_header_line(text: Column | str) -> Column:
    line = F.lower(col(text))
    found = F.lit(False)
    for word in HEADER_WORDS:
        found = found | line.contains(word)
    return found


def hour_position(header: Column | str) -> Column:
    """0-based position of the first hour label; 0 if there is none."""
    flags = F.transform(col(header), lambda label: F.lower(label).contains(HOUR_WORD))
    return F.greatest(F.array_position(flags, F.lit(True)) - 1, F.lit(0)).cast("int")


def hour_interval(cells: Column | str, position: Column | str | int) -> Column:
    """The ``HH:MM-HH:MM`` cell: the expected one first, then any; null if none."""
    where = F.lit(position) if isinstance(position, int) else col(position)
    expected = F.get(col(cells), where)
    anywhere = F.get(F.filter(col(cells), lambda cell: cell.rlike(HOUR_INTERVAL)), F.lit(0))
    return F.when(expected.rlike(HOUR_INTERVAL), expected).otherwise(anywhere)


def interval_start_minutes(hours: Column | str) -> Column:
    """Minutes after midnight at which an interval starts; null for 24:00 and beyond."""
    start = F.regexp_extract(col(hours), HOUR_INTERVAL, 1)
    hour = F.split_part(start, F.lit(":"), F.lit(1)).try_cast("int")
    minute = F.split_part(start, F.lit(":"), F.lit(2)).try_cast("int")
    return F.when((hour < 24) & (minute < 60), hour * 60 + minute)


def number(text: Column | str) -> Column:
    """Plain number text to double, anything else to null."""
    return F.when(col(text).rlike(NUMBER), col(text)).try_cast("double")


def report_number(text: Column | str) -> Column:
    """Report cell to double: decimal comma, spaces dropped, dash or blank is 0."""
    cleaned = F.translate(F.coalesce(col(text), F.lit("")), ",\u00a0 ", ".")
    return F.when(cleaned.isin("-", ""), F.lit(0.0)).otherwise(number(cleaned))


def decimal_comma(text: Column | str) -> Column:
    return number(F.translate(F.trim(col(text)), ",", "."))


def finite(value: Column | str) -> Column:
    """NaN and infinities to null, as aggregates should skip them."""
    x = col(value).cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)
