"""Writers. Nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

STAMPS = "yyyy-MM-dd HH:mm:ss"
# Quotes are doubled and blanks kept, as other CSV readers expect; Spark's defaults do neither.
CSV = {
    "header": True, "quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "timestampFormat": STAMPS, "timestampNTZFormat": STAMPS,
}


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header, in parallel part files. Text comes back as it was, also to other readers.

    Null is written as an unquoted empty field, an empty string as a quoted one.
    ``one_file`` is for sorted or limited results of known small size: it joins
    the parts of the last stage in their order.

    In a frame of one column a null would be a blank line, which no reader takes for a row: it is refused
    with an error, and all values are quoted there.
    """
    if one_file:
        df = df.coalesce(1)
    alone = len(df.columns) == 1
    if alone:
        field = df.schema[0]
        refused = F.raise_error(F.lit("a null in a CSV of one column would be lost")).cast(field.dataType)
        df = df.select(F.coalesce(F.col(f"`{field.name}`"), refused).alias(field.name))
    df.write.mode("overwrite").options(quoteAll=alone, **CSV).csv(path)


def write_csv_counted(df: DataFrame, path: str, one_file: bool = False, **metrics: Column) -> dict[str, object]:
    """Write CSV and give aggregates over the rows written, from the same pass; no second job.

    The metrics are observed where the rows are written, behind every shuffle, so a task that is run again is counted once.
    """
    seen = Observation()
    watched = (df.coalesce(1) if one_file else df).observe(seen, *[c.alias(name) for name, c in metrics.items()])
    write_csv(watched, path)
    return seen.get


def write_report(report: DataFrame, path: str) -> None:
    """The lines of a report (``line_no``, ``line``) as one text file, in order."""
    (
        report.repartition(1).sortWithinPartitions("line_no").select("line")
        .write.mode("overwrite").text(path)
    )
