"""Report text files to numbered lines of cells.

Files are scanned as splittable text, not as one value per file, so a large
file is read by many tasks. Facts about a whole file (charset, separator,
width) are aggregated per file and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.functions.text import strip, unquote
from loadweave.operators.longseries import number_rows
from loadweave.session import stage

# The 27 characters that windows-1252 assigns in 0x80-0x9F, the
# code points ISO-8859-1 has there, and the five bytes windows-1252 leaves open.
CP1252_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_OPEN = r"[\x81\x8D\x8F\x90\x9D]"
# Line ends beyond those the text scan splits at.
OTHER_LINE_ENDS = r"[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SEPARATOR_LINE = 100


def read_report_lines(spark: SparkSession, paths: str | list[str], pad: bool = False) -> DataFrame:
    """file, line (non-blank lines from 0), cells (trimmed and unquoted).

    The charset of a file is UTF-8 if all of it is valid, else windows-1252, or
    ISO-8859-1 if it has bytes that windows-1252 leaves open. The separator is a
    tab unless line 100 (or the last) has more semicolons, or else commas, than
    tabs. ``pad=True`` fills short rows with empty cells to the widest of the file.
    """
    scanned = spark.read.text(paths).select(
        F.col("value").cast("binary").alias("bytes"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    # The raw text is scanned once; facts about whole files come from the stored lines.
    decoded = stage(decode_lines(stage(scanned, "report")), "report-text")
    return split_lines(number_lines(decoded), pad)


def decode_lines(scanned: DataFrame) -> DataFrame:
    """Adds ``text``, decoded by the charset of the whole file; drops blank lines."""
    valid = F.is_valid_utf8(F.col("bytes").cast("string"))
    latin = F.decode("bytes", "ISO-8859-1")
    charsets = scanned.groupBy("file").agg(F.min(valid).alias("_utf8"), F.max(latin.rlike(CP1252_OPEN)).alias("_open"))
    western = F.when(F.col("_open"), latin).otherwise(F.translate(latin, CP1252_BYTES, CP1252_CHARS))
    text: Column = F.when(F.col("_utf8"), F.col("bytes").cast("string")).otherwise(western)
    decoded = scanned.join(charsets, "file").select("file", "_block", "_id", text.alias("text"))
    parts = decoded.select("file", "_block", "_id", F.posexplode(F.split("text", OTHER_LINE_ENDS)).alias("_part", "text"))
    return parts.where(strip("text") != "")


def number_lines(lines: DataFrame) -> DataFrame:
    """file, line, text: consecutive numbers within the file.

    The splits of the scan serve as pieces: lines are ranked within a split,
    and the line counts of earlier splits are added.
    """
    place = F.struct("_id", "_part")
    return number_rows(lines, place, ["file"], "line", piece="_block").select("file", "line", "text")


def split_lines(lines: DataFrame, pad: bool = False) -> DataFrame:
    sample = lines.where(F.col("line") <= SEPARATOR_LINE).groupBy("file").agg(F.max_by("text", "line").alias("_sample"))
    tabs, semicolons, commas = (F.length("_sample") - F.length(F.replace("_sample", F.lit(c))) for c in ("\t", ";", ","))
    separator = F.when(semicolons > tabs, ";").when(commas > tabs, ",").otherwise("\t")
    separators = sample.select("file", separator.alias("_sep"))
    cells = F.transform(F.split(F.col("text"), F.col("_sep")), unquote)
    split = lines.join(separators, "file").select("file", "line", cells.alias("cells"))
    if not pad:
        return split
    widths = split.groupBy("file").agg(F.max(F.size("cells")).alias("_width"))
    filler = F.array_repeat(F.lit(""), F.col("_width") - F.size("cells"))
    return split.join(widths, "file").select("file", "line", F.concat("cells", filler).alias("cells"))
