"""Folders of partitioned tables: what they hold by their names alone, and their removal.

Listings go through the file system that Spark itself uses, so any store will do. No data file is opened.
"""

from __future__ import annotations

from datetime import date
from hashlib import sha256

from pyspark.sql import SparkSession

DAY = "activity_date="


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(conf), folder


def _has_data(system, folder) -> bool:
    """Whether the folder, or one in it, holds a file that Spark would read: looks at names until the first."""
    entries = system.listStatusIterator(folder)
    while entries.hasNext():
        entry = entries.next()
        if not entry.getPath().getName().startswith(("_", ".")) and (
            entry.getLen() > 0 if entry.isFile() else _has_data(system, entry.getPath())
        ):
            return True
    return False


def staged_days(spark: SparkSession, path: str) -> list[date]:
    """Days of a table partitioned by day, in order, from its listing; none where there is no table.

    One value per day reaches the driver. Staging removes the folder of a day that it empties, so every folder
    with a file has rows; a folder that a failed write has left without files doesn't count.
    """
    system, root = file_system(spark, path)
    if not system.exists(root):
        return []
    named = {s.getPath().getName(): s.getPath() for s in system.listStatus(root) if s.isDirectory()}
    return sorted(date.fromisoformat(n[len(DAY) :]) for n, at in named.items() if n.startswith(DAY) and _has_data(system, at))


def day_signatures(spark: SparkSession, path: str) -> dict[date, str]:
    """What the listing says of each day's files (names, sizes, times): another text where a day was written again."""
    system, root = file_system(spark, path)
    found = {}
    for each in staged_days(spark, path):
        files = system.listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"{DAY}{each.isoformat()}"))
        shown = [f for f in files if not f.getPath().getName().startswith(("_", "."))]
        seen = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in shown)
        found[each] = sha256(repr(seen).encode()).hexdigest()
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all that it holds; one that isn't there is no fault."""
    system, folder = file_system(spark, path)
    system.delete(folder, True)
