"""COPY: text files into a table and rows out to text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from .hypertable import Hypertable


def copy_from(table: Hypertable, path: str, where: Column | str | None = None, header: bool = False, delimiter: str = ",", null: str = "", columns: list[str] | None = None) -> int:
    """Load CSV rows for which where is true; columns not in the file are null. A malformed row is an error. Returns rows loaded."""
    names = columns or table.schema.names
    schema = table.schema.__class__([table.schema[c] for c in names])
    before = table.approximate_row_count()
    rows = table.spark.read.schema(schema).options(header=header, sep=delimiter, nullValue=null, mode="FAILFAST").csv(path)
    rows = rows.select(*[rows[c] if c in names else _null(table, c) for c in table.schema.names])
    table.append(rows if where is None else rows.where(where))
    return table.approximate_row_count() - before


def _null(table: Hypertable, column: str) -> Column:
    from pyspark.sql import functions as F

    return F.lit(None).cast(table.schema[column].dataType).alias(column)


def copy_to(df: DataFrame, path: str, header: bool = False, delimiter: str = ",", null: str = "") -> None:
    """Write rows as CSV files, each by its own task; timestamps keep microseconds."""
    df.write.options(header=header, sep=delimiter, nullValue=null, timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSSXXX").csv(path)
