"""Bringing files and roster rows in: admission, duplicates, import."""

from pyspark.sql import Column, DataFrame, functions as F

from musterline import constants as K
from musterline.functions import clean_id, content_hash, extension, file_type, reader_for, sanitized
from musterline.operators.ranking import first_per_key


def admission_verdict(
    filename: Column, content_type: Column, size_bytes: Column, max_bytes: int = K.MAX_UPLOAD_BYTES
) -> Column:
    """``ACCEPTED`` or the first rule that fails: extension, content type, size."""
    return (
        F.when(~extension(filename).isin(*K.ALLOWED_EXTENSIONS), "BAD_EXTENSION")
        .when(~F.coalesce(content_type.isin(*K.ALLOWED_CONTENT_TYPES), F.lit(False)), "BAD_CONTENT_TYPE")
        .when(size_bytes > max_bytes, "TOO_LARGE")
        .otherwise("ACCEPTED")
    )


def admit(files: DataFrame, max_bytes: int = K.MAX_UPLOAD_BYTES) -> DataFrame:
    """The inventory with a ``verdict`` column; filter it into accepted and quarantined."""
    return files.withColumn(
        "verdict",
        admission_verdict(F.col("filename"), F.col("content_type"), F.col("size_bytes"), max_bytes),
    )


def typed_files(files: DataFrame) -> DataFrame:
    """File type and reader by extension, matched without regard to case."""
    with_extension = files.withColumn("extension", extension("filename"))
    ext = F.col("extension")
    return with_extension.withColumn("file_type", file_type(ext)).withColumn("reader", reader_for(ext))


def hashed_files(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", content_hash("content"))


def stored_names(files: DataFrame) -> DataFrame:
    return files.withColumn("stored_name", sanitized("filename"))


def first_by_hash(hashed: DataFrame, history: DataFrame, order: str) -> DataFrame:
    """Per content hash the first file and whether the history already holds the content.

    Grouping first means that a third of all files being copies of one file costs one
    partial row per task; only then are the distinct hashes matched with the history, which
    is first cut to them (without a shuffle where they are few).  Null is no content.
    """
    firsts = hashed.where(F.col("file_hash").isNotNull()).groupBy("file_hash").agg(F.min(order).alias(order))
    known = (
        history.join(firsts.select("file_hash"), "file_hash", "left_semi")
        .select("file_hash").distinct().withColumn("known", F.lit(True))
    )
    return firsts.join(known, "file_hash", "left").select(
        order, "file_hash", F.coalesce("known", F.lit(False)).alias("in_history")
    )


def duplicate_verdicts(hashed: DataFrame, history: DataFrame, order: str, keep: list[str]) -> DataFrame:
    """Every incoming file as ``NEW``, ``IN_HISTORY``, ``REPEATED_IN_BATCH`` or ``NO_HASH``.

    ``order`` must be unique per file: verdicts come back by that key rather than by hash,
    so the join stays even when many files share a hash.  A later copy in the batch is
    ``REPEATED_IN_BATCH`` whether or not the history knows it too.
    """
    firsts = first_by_hash(hashed, history, order).select(order, "in_history")
    listed = hashed.select(*keep, F.col("file_hash").isNull().alias("_no_hash"))
    return listed.join(firsts, order, "left").select(
        *keep,
        F.when(F.col("_no_hash"), "NO_HASH")
        .when(F.col("in_history"), "IN_HISTORY")
        .when(~F.col("in_history"), "NEW")
        .otherwise("REPEATED_IN_BATCH")
        .alias("verdict"),
    )


def new_files(hashed: DataFrame, history: DataFrame, order: str) -> DataFrame:
    """The files to take in: first of their content, and not seen before."""
    accepted = first_by_hash(hashed, history, order).where(~F.col("in_history")).select(order)
    return hashed.join(accepted, order, "left_semi")


def take_in(
    hashed: DataFrame, history: DataFrame, keep: list[str] | None = None, max_bytes: int = K.MAX_UPLOAD_BYTES
) -> DataFrame:
    """The inventory of a batch of hashed files with a ``verdict``; only ``NEW`` is processed.

    Other verdicts: ``NO_MANAGER``, a failed admission rule, ``UNREADABLE`` (a spreadsheet
    codec we do not have), ``IN_HISTORY``, ``REPEATED_IN_BATCH``.
    """
    typed = F.col("content_type") if "content_type" in hashed.columns else F.lit(K.ALLOWED_CONTENT_TYPES[0])
    admitted = admission_verdict(F.col("filename"), typed, F.col("size_bytes"), max_bytes)
    rule = (
        F.when(F.coalesce("manager_id", F.lit("")) == "", "NO_MANAGER")
        .when(admitted != "ACCEPTED", admitted)
        .when(reader_for(extension("filename")) != "CSV", "UNREADABLE")
        .otherwise("ACCEPTED")
    )
    columns = ["path", "filename", "stored_name", "manager_id", "size_bytes", "created_at", "file_hash", *(keep or [])]
    listed = stored_names(hashed).select(*columns, rule.alias("rule"))
    accepted = listed.where(F.col("rule") == "ACCEPTED")
    firsts = first_by_hash(accepted, history, "path").select("path", "in_history")
    return listed.join(firsts, "path", "left").select(
        *columns,
        F.when(F.col("rule") != "ACCEPTED", F.col("rule"))
        .when(F.col("in_history"), "IN_HISTORY")
        .when(~F.col("in_history"), "NEW")
        .otherwise("REPEATED_IN_BATCH")
        .alias("verdict"),
    )


def parsed_new_files(
    hashed: DataFrame, fresh: DataFrame, extra_headers: dict[str, str] | None = None
) -> DataFrame:
    """Parsed rows of the files listed in ``fresh``.

    Content never takes part in a join: CSV files are parsed where they were read, and the
    rows of files not listed are dropped.
    """
    from musterline.sources.sheets import parse_sheets

    csv_files = hashed.where((reader_for(extension("filename")) == "CSV") & F.col("content").isNotNull())
    rows = parse_sheets(csv_files, ["path", "file_hash"], extra_headers)
    return rows.join(fresh.select("path"), "path", "left_semi")


def import_new_rows(batch: DataFrame, roster: DataFrame, order: str = "row_no") -> DataFrame:
    """Batch rows whose ID is on nobody's roster; the first row per ID wins.

    Copies inside the batch are cut down in front of the shuffle, and the anti join then
    works on the same partitioning.  Rows with a blank ID are not imported.
    """
    cleaned = batch.withColumn("employee_id", clean_id("employee_id")).where(
        F.col("employee_id").isNotNull()
    )
    firsts = first_per_key(cleaned, ["employee_id"], [F.col(order).asc()])
    # The roster is cut to the batch's IDs first, without a shuffle where these are few.
    known = _known_ids(roster).join(firsts.select("employee_id"), "employee_id", "left_semi")
    return firsts.join(known, "employee_id", "left_anti")


def _known_ids(roster: DataFrame) -> DataFrame:
    return roster.select(clean_id("employee_id").alias("employee_id")).where(F.col("employee_id").isNotNull())


def import_counts(batch: DataFrame, roster: DataFrame, order: str = "row_no") -> DataFrame:
    """Inserted, skipped and blank-ID rows per manager."""
    inserted = import_new_rows(batch, roster, order).select(
        "manager_id", F.lit(1).alias("inserted"), F.lit(0).alias("rows"), F.lit(0).alias("blank")
    )
    arrived = batch.select(
        "manager_id",
        F.lit(0).alias("inserted"),
        F.lit(1).alias("rows"),
        clean_id("employee_id").isNull().cast("int").alias("blank"),
    )
    total = inserted.unionByName(arrived).groupBy("manager_id").agg(
        F.sum("inserted").alias("inserted"), F.sum("rows").alias("rows"), F.sum("blank").alias("blank_ids")
    )
    return total.select(
        "manager_id",
        "inserted",
        (F.col("rows") - F.col("inserted") - F.col("blank_ids")).alias("skipped"),
        "blank_ids",
    )


def header_mapping(headers: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """``canonical`` column name per header, null where no synonym is known."""
    return headers.withColumn("canonical", canonical_header("header", extra))


def canonical_header(header, extra: dict[str, str] | None = None) -> Column:
    from musterline.functions import normal_header

    synonyms = K.HEADER_SYNONYMS | (extra or {})
    table = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    return F.try_element_at(table, normal_header(header))


def rename_headers(df: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Apply the synonyms to a frame's own columns; the first column for a name wins."""
    from musterline.sources.sheets import canonical_names

    mapping = canonical_names(df.columns, extra)
    quoted = [c.replace("`", "``") for c in df.columns]
    return df.select(*[F.col(f"`{q}`").alias(mapping.get(c, c)) for q, c in zip(quoted, df.columns)])


def dataset_profile(df: DataFrame, name: str) -> DataFrame:
    """One row: the column list, how many columns, how many rows."""
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(name).alias("dataset"),
        F.lit(",".join(df.columns)).alias("columns"),
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        "row_count",
    )
