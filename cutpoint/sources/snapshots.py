"""Tables by day whose content is named by one small file: a load is seen whole or not at all.

A load writes its days into a folder of its own and then commits a manifest (day → load), by one rename to the
next number. Readers resolve the manifest with the highest number; a load that dies before the rename has
changed nothing that they see. Two loads that started from the same manifest can't both commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cutpoint.sources.folders import DAY, file_system, remove, staged_days


class Conflict(Exception):
    """Another load has committed since the manifest that this one started from."""


@dataclass(frozen=True)
class Manifest:
    """Which load holds each day, and what else was true at the commit. Version 0 is the table before any load."""

    version: int = 0
    days: Mapping[date, str] = field(default_factory=dict)
    notes: Mapping[str, object] = field(default_factory=dict)


class Snapshots:
    """A table partitioned by ``activity_date`` under ``path``.

    The rename of a manifest is atomic where the file system's is (HDFS and local ones; object stores need a
    committer that gives as much).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self, version: int) -> str:
        return f"{self.path}/_manifests/{version:010d}.json"

    def versions(self) -> list[int]:
        """Numbers of the manifests that are there, in order."""
        system, folder = file_system(self.spark, f"{self.path}/_manifests")
        if not system.exists(folder):
            return []
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def current(self) -> Manifest:
        versions = self.versions()
        return self.at(versions[-1]) if versions else Manifest()

    def at(self, version: int) -> Manifest:
        """The manifest of a version. It is small: a line per day."""
        if not version:
            return Manifest()
        system, file = file_system(self.spark, self._manifest(version))
        stream = system.open(file)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        return Manifest(version, {date.fromisoformat(d): load for d, load in held["days"].items()}, held["notes"])

    def read(self, schema: T.StructType, at: Manifest | None = None, days: Iterable[date] | None = None) -> DataFrame:
        """The rows of a manifest (the current one when omitted), of some days or all."""
        at = at or self.current()
        wanted = at.days if days is None else sorted(set(days) & set(at.days))
        folders = [f"{self.path}/data/load={at.days[d]}/{DAY}{d.isoformat()}" for d in wanted]
        if not folders:
            return self.spark.createDataFrame([], schema)
        typed = T.StructType([*schema.fields, T.StructField("load", T.StringType())])
        found = self.spark.read.schema(typed).option("basePath", f"{self.path}/data").parquet(*folders)
        return found.select(*schema.names)

    def write(self, rows: DataFrame, sort_by: Iterable[str] = ()) -> dict[date, str]:
        """Write rows as a load of its own and name its days. Nobody sees them before they are committed.

        Rebalancing lets adaptive execution split a large day over many tasks and files.
        """
        load = uuid.uuid4().hex
        folder = f"{self.path}/data/load={load}"
        (
            rows.hint("rebalance", "activity_date")
            .sortWithinPartitions("activity_date", *sort_by)
            .write.partitionBy("activity_date")
            .parquet(folder)
        )
        return dict.fromkeys(staged_days(self.spark, folder), load)

    def commit(self, before: Manifest, days: Mapping[date, str], notes: Mapping[str, object] | None = None) -> Manifest:
        """Make ``days`` the table, unless another load has committed since ``before``."""
        after = Manifest(before.version + 1, dict(sorted(days.items())), dict(notes or {}))
        text = json.dumps({"days": {d.isoformat(): load for d, load in after.days.items()}, "notes": after.notes})
        system, target = file_system(self.spark, self._manifest(after.version))
        _, draft = file_system(self.spark, f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        stream = system.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context, jvm = self.spark.sparkContext, self.spark.sparkContext._jvm
        # A rename through the file context never replaces what is there.
        names = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            system.makeQualified(target).toUri(), context._jsc.hadoopConfiguration()
        )
        no_options = context._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            names.rename(system.makeQualified(draft), system.makeQualified(target), no_options)
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            system.delete(draft, False)
            raise Conflict(f"version {after.version} of {self.path} was committed by another load") from e
        return after

    def expire(self, keep: int = 2) -> None:
        """Remove all but the latest ``keep`` manifests, and the loads that none of these name.

        Not while a load is being written: its folder is named by no manifest yet.
        """
        versions = self.versions()
        used = {load for v in versions[-keep:] for load in self.at(v).days.values()}
        for version in versions[:-keep]:
            remove(self.spark, self._manifest(version))
        system, folder = file_system(self.spark, f"{self.path}/data")
        for entry in system.listStatus(folder) if system.exists(folder) else []:
            if entry.getPath().getName().removeprefix("load=") not in used:
                system.delete(entry.getPath(), True)
