"""CSV sheets, read as text so that IDs such as ``007`` keep their zeros."""

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from musterline import constants as K
from musterline.functions import extension
from musterline.sources.inventory import oversized_files, owner_in_path, read_files

# A quoted cell may be as long as the file it is in.
csv.field_size_limit(K.MAX_UPLOAD_BYTES)


def canonical_names(headers: list[str], extra: dict[str, str] | None = None) -> dict[str, str]:
    """Header -> canonical name, for known headers; the first header for a name wins."""
    synonyms = K.HEADER_SYNONYMS | (extra or {})
    found: dict[str, str] = {}
    for header in headers:
        name = synonyms.get(header.strip().lower())
        if name is not None and name not in found.values():
            found[header] = name
    return found


def read_csv(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    """CSV files that share one header row; every column is text.

    The first file's header becomes the declared schema, and a file whose header differs
    makes the scan fail instead of filling the wrong columns.  A ``sheet_file`` column
    names the file each row came from.
    """
    options = {"header": True, "multiLine": multi_line}
    columns = spark.read.options(**options).csv(path).schema
    scan = spark.read.options(**options, enforceSchema=False).schema(columns).csv(path)
    return scan.select("*", F.col("_metadata.file_path").alias("sheet_file"))


def parse_sheets(
    files: DataFrame, keep: list[str], extra: dict[str, str] | None = None
) -> DataFrame:
    """Rows of CSV files held as ``content``, each file under its own header.

    Output: the ``keep`` columns, ``row_no`` (file order, from 1) and the canonical sheet
    columns as text, null where a file lacks them.  A file is at most the admission limit
    in size and is parsed in one task.  A file without an ID column, or one that is not
    text, gives a single row with ``problem`` filled; otherwise ``problem`` is null.
    """
    kept = files.select(*keep, "content").schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept if f.name != "content")
    columns = list(K.SHEET_COLUMNS)
    schema = f"{fields}, row_no long, {', '.join(c + ' string' for c in columns)}, problem string"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for record in batch.to_dict("records"):
                content = record.pop("content")
                for chunk in _sheet_chunks(bytes(content), columns, extra):
                    for name in keep:
                        chunk[name] = record[name]
                    yield chunk[[*keep, "row_no", *columns, "problem"]]

    return files.select(*keep, "content").mapInPandas(parse, schema)


def _sheet_chunks(
    content: bytes, columns: list[str], extra: dict[str, str] | None, rows: int = 20_000
) -> Iterator[pd.DataFrame]:
    def failed(reason: str) -> pd.DataFrame:
        return pd.DataFrame([{"row_no": 0, **dict.fromkeys(columns), "problem": reason}])

    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        yield failed("NOT_TEXT")
        return
    reader = csv.reader(io.StringIO(text, newline=""))
    header = next(reader, [])
    names = canonical_names(header, extra)
    at = {names[h]: i for i, h in reversed(list(enumerate(header))) if h in names}
    if "employee_id" not in at:
        yield failed("NO_ID_COLUMN")
        return
    picked = [at.get(c) for c in columns]
    block: list[list] = []
    number = 0
    for row in reader:
        if not row:
            continue
        number += 1
        block.append([number, *[row[i] if i is not None and i < len(row) and row[i] != "" else None for i in picked], None])
        if len(block) == rows:
            yield pd.DataFrame(block, columns=["row_no", *columns, "problem"], dtype=object)
            block = []
    if block:
        yield pd.DataFrame(block, columns=["row_no", *columns, "problem"], dtype=object)


def read_sheets(
    spark: SparkSession, folder: str, extra: dict[str, str] | None = None, max_bytes: int = K.MAX_UPLOAD_BYTES
) -> DataFrame:
    """All sheets below ``<folder>/manager_id=<id>/``, each under its own header.

    Rows as from :func:`parse_sheets`, with ``path`` and ``manager_id``; look at ``problem``
    before using them.  A file that is no CSV or too large gives one row that says so.
    """
    files = read_files(spark, folder, max_bytes).withColumn("manager_id", owner_in_path())
    is_csv = extension("filename") == ".csv"
    rows = parse_sheets(files.where(is_csv), ["path", "manager_id"], extra)
    turned_away = files.where(~is_csv).select("path", "manager_id", F.lit("UNREADABLE").alias("problem")).unionByName(
        oversized_files(spark, folder, max_bytes).select("path", owner_in_path().alias("manager_id"), F.lit("TOO_LARGE").alias("problem"))
    ).withColumn("row_no", F.lit(0).cast("long"))
    return rows.unionByName(turned_away, allowMissingColumns=True)


def preview(rows: DataFrame, sheet: str, order: str, k: int = K.PREVIEW_ROWS) -> DataFrame:
    """The first ``k`` rows of every sheet; tasks hand on at most ``k`` rows per sheet."""
    from musterline.operators.ranking import top_per_group

    return top_per_group(rows, [sheet], [F.col(order).asc()], k, rank="position")
