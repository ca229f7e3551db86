"""Write results: CSV, JSON rows, snapshots and co-located tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

BOM = "\ufeff"


def iso_text(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, as results are handed out."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, NULL fields included, dates in ISO form."""
    packed = F.to_json(F.struct(*df.columns), {
        "dateFormat": "yyyy-MM-dd",
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss",
        "ignoreNullFields": "false",
    })
    return df.select(packed.alias("row"))


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """Semicolons, a header, UTF-8, NULL as empty, blanks at the ends of values kept. All rows
    are written, by all tasks.

    With ``bom`` every part file starts with a byte order mark, so each opens by itself; a
    page for a person is ``shaping.page`` of an ordered listing.
    """
    out = df.withColumnRenamed(df.columns[0], BOM + df.columns[0]) if bom else df
    (
        out.write.mode("overwrite")
        .option("sep", ";").option("header", True).option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("nullValue", "").option("emptyValue", "").option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )


def write_snapshot(df: DataFrame, path: str) -> None:
    """A new snapshot in a folder of its own; existing data is never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """A table hashed and sorted by ``key``.

    Newest versions per ``key`` are then picked without moving the table, and
    ``matching.lookup_on_layout`` joins them where they lie; ``lookup`` adds a slot to its keys
    and moves both sides. ``path`` puts the files elsewhere than in the warehouse.
    """
    writer = df.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
