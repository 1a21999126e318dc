"""Entity tables from Parquet or a database."""

from pyspark.sql import DataFrame, SparkSession

from musterline.schemas import TABLES


def read_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A Parquet table; ``name`` picks a declared schema, which also skips footer inference."""
    reader = spark.read
    if name is not None:
        reader = reader.schema(TABLES[name])
    return reader.parquet(path)


def read_database_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    slices: list[str] | None = None,
) -> DataFrame:
    """A database table over JDBC; filters and columns are pushed to the database.

    ``slices`` are disjoint ``WHERE`` conditions that together cover the table, one per
    task.  Without them a single task reads everything, which suits small tables only.
    """
    if slices:
        return spark.read.jdbc(url, table, predicates=slices, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def text_slices(column: str, bounds: list[str]) -> list[str]:
    """Slices for a text key from sorted ``bounds``; nulls go with the first slice."""
    if sorted(set(bounds)) != list(bounds):
        raise ValueError("bounds must be sorted and distinct")
    quoted = ["'" + b.replace("'", "''") + "'" for b in bounds]
    if not quoted:
        return ["1 = 1"]
    first = f"({column} < {quoted[0]} OR {column} IS NULL)"
    middle = [f"({column} >= {a} AND {column} < {b})" for a, b in zip(quoted, quoted[1:])]
    return [first, *middle, f"({column} >= {quoted[-1]})"]
