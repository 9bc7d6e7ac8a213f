"""Tables in dated folders: what days there are, dropping old ones, replacing days, and dates that stand in file names.

Only names are listed on the driver, one a folder or file; rows never are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Ways in which a folder or file name writes a day.
DAY_FORMATS = ("%Y-%m-%d", "%Y%m%d")


def day_of(name: str) -> date | None:
    """The day that a name is, or None."""
    for form in DAY_FORMATS:
        try:
            return datetime.strptime(name, form).date()
        except ValueError:
            continue
    return None


def _listed(spark: SparkSession, path: str):
    """The file system and the entries of a folder; none if it does not exist."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, (list(files.listStatus(at)) if files.exists(at) else [])


def day_folders(spark: SparkSession, path: str, column: str = "date") -> Iterator[tuple[str, date]]:
    """(folder, day) of each partition ``column=<day>`` below ``path``, at whatever depth; other names of that column are no days."""
    _, entries = _listed(spark, path)
    for entry in entries:
        name = entry.getPath().getName()
        if not entry.isDirectory() or "=" not in name:
            continue
        key, value = name.split("=", 1)
        day = day_of(value) if key == column else None
        if day is not None:
            yield entry.getPath().toString(), day
        elif key != column:
            yield from day_folders(spark, entry.getPath().toString(), column)


def days(spark: SparkSession, path: str, column: str = "date") -> list[date]:
    """The days of a table, in order."""
    return sorted({day for _, day in day_folders(spark, path, column)})


def drop_before(spark: SparkSession, path: str, before: date, column: str = "date") -> list[date]:
    """Delete the partitions before a day, with all below them, and give their days. Others, and folders that are no days, stay untouched."""
    gone = [(folder, day) for folder, day in day_folders(spark, path, column) if day < before]
    for folder, day in gone:
        files, _ = _listed(spark, folder)
        if not files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True):
            raise OSError(f"{folder} could not be deleted")
    if gone:
        spark.catalog.refreshByPath(path)
    return sorted({day for _, day in gone})


def save_days(df: DataFrame, path: str, column: str = "date", files_per_day: int = 8) -> None:
    """Write the days of ``df``, replacing each of them whole; days that ``df`` does not have stay. Each day is several files."""
    spread = df.repartition(F.col(column), F.pmod(F.xxhash64(*df.columns), F.lit(files_per_day)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def read_days(spark: SparkSession, path: str, start: str, end: str, column: str = "date") -> DataFrame:
    """The rows of a closed range of days; other days are not read."""
    return spark.read.parquet(path).filter(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def read_named_days(spark: SparkSession, path: str, schema: str, last: int | None = None, column: str = "date") -> DataFrame:
    """Rows of the CSV files ``<day>.csv`` in a folder, with the day of the file's name; with ``last``, of the latest files only.

    Files whose name is no day are left out. A folder without such files gives no rows.
    """
    _, entries = _listed(spark, path)
    found = sorted((day_of(m[1]), e.getPath().toString()) for e in entries if (m := re.fullmatch(r"(.+)\.csv", e.getPath().getName())) and day_of(m[1]))
    if last is not None:
        found = found[len(found) - min(last, len(found)) :]
    if not found:
        return spark.createDataFrame([], schema).withColumn(column, F.lit(None).cast("date"))
    named = spark.read.schema(schema).option("header", True).csv([f for _, f in found])
    stem = F.regexp_replace(F.regexp_extract("_metadata.file_name", r"^(.+)\.csv$", 1), "-", "")
    return named.withColumn(column, F.to_date(stem, "yyyyMMdd"))
