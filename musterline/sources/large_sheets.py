"""CSV files of any size, read by several tasks each.

Spark's text scan deals a file out by byte ranges, as lines.  Which lines begin a row is known from the
quotes in front of them: an odd number means the line goes on inside a quoted cell.  Quotes are counted per
range, ranges are summed in file order, and rows that span lines (or ranges) are put together; all
others are rows as they are.  Every file keeps its own header.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from musterline import constants as K
from musterline.functions import normal_header
from musterline.sources.storage import parked

_CELLS = {"quote": '"', "escape": '"', "sep": ",", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    scan = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    placed = scan.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
    )
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
    return placed.withColumn("quotes", quotes.cast("long")).withColumn("valid", F.is_valid_utf8("line"))


def _in_file_order(measure: str) -> Column:
    """Sum over the earlier ranges of a file: a row per range, never per line."""
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(measure).over(earlier), F.lit(0))


def _rows(lines: DataFrame) -> DataFrame:
    """``(path, number, line)``: the rows of each file from 1, its header first."""
    ranges = lines.groupBy("path", "block").agg(F.sum("quotes").alias("quotes"))
    opened = ranges.select("path", "block", _in_file_order("quotes").alias("before"))
    # Lines of one range are one task's at most as many as a scan task reads.
    inside = Window.partitionBy("path", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    quoted = F.col("before") + F.coalesce(F.sum("quotes").over(inside), F.lit(0))
    marked = lines.join(opened, ["path", "block"]).withColumn("begins", quoted % 2 == 0)
    marked = parked(marked.where(~(F.col("begins") & (F.col("line") == ""))).select("path", "block", "place", "line", "quotes", "begins"), "csv-lines")
    counted = marked.groupBy("path", "block").agg(F.count_if("begins").alias("begun"))
    first = counted.select("path", "block", _in_file_order("begun").alias("earlier"))
    upto = Window.partitionBy("path", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.join(first, ["path", "block"]).withColumn("number", F.col("earlier") + F.sum(F.col("begins").cast("long")).over(upto))
    whole = F.col("begins") & (F.col("quotes") % 2 == 0)
    pieces = numbered.where(~whole).groupBy("path", "number").agg(F.array_sort(F.collect_list(F.struct("block", "place", "line"))).alias("p"))
    spanning = pieces.select("path", "number", F.array_join("p.line", "\n").alias("line"))
    return numbered.where(whole).select("path", "number", "line").unionByName(spanning)


def _cells(line: str, width: int) -> Column:
    """The cells of a row as an array of ``width``, null where blank or absent."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    parsed = F.from_csv(line, schema, _CELLS)
    return F.array(*[F.nullif(parsed[f"c{i}"], F.lit("")) for i in range(width)])


def read_large_sheets(spark: SparkSession, path: str, extra: dict[str, str] | None = None, pattern: str = "*.csv") -> DataFrame:
    """Rows of the CSV files below ``path`` whose names match ``pattern``: path, row_no, the canonical columns, problem.

    As :func:`sheets.parse_sheets`, without its limit on file size.  Lines inside a quoted cell are joined by
    a line feed.  Blank lines are no rows.  A quote inside an unquoted cell must have its second in the same
    line.  A file with an open quote (``OPEN_QUOTE``), without an ID column or with bytes that are no UTF-8 has one row that says so.
    """
    lines = _lines(spark, path, pattern)
    odd = lines.groupBy("path").agg(F.sum("quotes").alias("quotes"), F.bool_and("valid").alias("valid"))
    spoilt = F.when(~F.col("valid"), "NOT_TEXT").when(F.col("quotes") % 2 == 1, "OPEN_QUOTE")
    files = parked(odd.select("path", spoilt.alias("problem")), "csv-files")
    sound = files.where(F.col("problem").isNull()).select("path")
    rows = parked(_rows(lines.join(sound, "path", "left_semi").drop("valid")), "csv-rows")

    heads = rows.where(F.col("number") == 1).select("path", F.regexp_replace("line", "^﻿", "").alias("head"))
    commas = F.length("head") - F.length(F.replace("head", F.lit(",")))
    width = (heads.agg(F.max(commas)).first()[0] or 0) + 1
    known = F.create_map(*[F.lit(x) for pair in (K.HEADER_SYNONYMS | (extra or {})).items() for x in pair])
    names = F.transform(_cells("head", width), lambda h: F.coalesce(F.try_element_at(known, normal_header(h)), F.lit("")))
    heads = heads.select("path", names.alias("names"))
    with_id = F.array_contains("names", "employee_id")

    def cell(name: str) -> Column:
        at = F.array_position("names", name)
        return F.when(at > 0, F.element_at("cells", F.greatest(at, F.lit(1)).cast("int"))).alias(name)

    body = rows.where(F.col("number") > 1).join(heads.where(with_id), "path").withColumn("cells", _cells("line", width))
    found = body.select("path", (F.col("number") - 1).alias("row_no"), *[cell(c) for c in K.SHEET_COLUMNS], F.lit(None).cast("string").alias("problem"))
    nameless = sound.join(heads.where(with_id), "path", "left_anti").withColumn("problem", F.lit("NO_ID_COLUMN"))
    turned_away = files.where(F.col("problem").isNotNull()).unionByName(nameless).withColumn("row_no", F.lit(0).cast("long"))
    return found.unionByName(turned_away, allowMissingColumns=True)
