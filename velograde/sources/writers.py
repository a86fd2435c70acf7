"""Writers of reports: CSV with fixed decimals, canonical JSON, all-or-nothing publishing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fixed(df: DataFrame, columns: list[str], decimals: int = 9) -> DataFrame:
    """The columns as text with a fixed number of decimals, without separators of thousands; null stays null."""
    return df.select(*[F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals}f", c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def title_booleans(df: DataFrame) -> DataFrame:
    """Booleans as True and False."""
    return df.select(*[F.when(F.col(c), "True").when(~F.col(c), "False").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes])


def csv(df: DataFrame, path: str, crlf: bool = False, single: bool = True, partition_by: tuple[str, ...] = ()) -> None:
    """A report with header; null is empty, quotes are doubled. ``single``: reports are small; tables by partition keep their files."""
    rows = title_booleans(df)
    rows = rows.coalesce(1) if single and not partition_by else rows
    writer = rows.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", "\"")
    if crlf:
        writer = writer.option("lineSep", "\r\n")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def canonical_json(value) -> bytes:
    """Keys sorted, no blanks, ASCII, one line feed at the end: for values of the driver's size."""
    return (json.dumps(value, sort_keys=True, separators=(",", ":")) + "\n").encode()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, target: str, write) -> None:
    """Call ``write(folder)`` on a folder beside the target and move it there; on any error nothing is published."""
    staged = f"{target.rstrip('/')}.staged-{uuid.uuid4().hex[:8]}"
    try:
        write(staged)
        source, fs = _fs(spark, staged)
        goal, _ = _fs(spark, target)
        old, _ = _fs(spark, staged + ".old")
        had = fs.exists(goal)
        if had:
            fs.rename(goal, old)
        if not fs.rename(source, goal):
            if had:
                fs.rename(old, goal)
            raise OSError(f"{staged} could not be moved to {target}")
        if had:
            fs.delete(old, True)
    except BaseException:
        path, fs = _fs(spark, staged)
        fs.delete(path, True)
        raise


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a report, byte by byte."""
    a, fs = _fs(spark, source)
    b, other = _fs(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, other, b, False, spark._jsc.hadoopConfiguration())


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small report as a Markdown table; more than ``most`` rows are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    head = f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)
