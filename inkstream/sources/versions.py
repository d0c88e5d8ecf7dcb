"""Versioned tables: immutable data folders, and a log of commit records that alone says which one is current.

    root/data/<group>/<version>/    Parquet, written once
    root/log/<number>.json          {"group", "version", "state"}, each created once and never changed

States: draft (waits for a review), staged (reviewed, the group's own record is being updated), current, discarded. A
record is one small file that either exists or doesn't, so every crash leaves a state that recover() can finish or undo:
data without a record is not seen by anyone; a staged version becomes current or discarded; readers never see it before.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRAFT, STAGED, CURRENT, DISCARDED = "draft", "staged", "current", "discarded"
RECORD = "seq bigint, group string, version string, state string"


class Versions:
    def __init__(self, spark: SparkSession, root: str, after: Callable[[str], None] = lambda step: None) -> None:
        """after: called with the name of each step once it is done; what it raises stands for a crash there."""
        self.spark, self.root, self.after = spark, root.rstrip("/"), after
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self.path(folder)
        names = [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []
        return sorted(n for n in names if n[0] not in "._")

    def records(self) -> DataFrame:
        """All records: seq, group, version, state."""
        if not self._names(f"{self.root}/log"):
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).json(f"{self.root}/log")

    def states(self) -> DataFrame:
        """The last state of every version: group, version, state, seq."""
        return self.records().groupBy("group", "version").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))

    def state_of(self, group: str, version: str) -> str | None:
        row = self.states().where((F.col("group") == group) & (F.col("version") == version)).first()
        return row["state"] if row else None

    def _record(self, group: str, version: str, state: str) -> None:
        """Add a record; of two writers of one number the second fails and takes the next."""
        seq = len(self._names(f"{self.root}/log"))
        while True:
            path = self.path(f"{self.root}/log/{seq:012d}.json")
            if not self.fs.exists(path):
                break
            seq += 1
        # Written under a name that readers skip; the rename makes it appear whole, and fails if the number is taken.
        hidden = self.path(f"{self.root}/log/.{seq:012d}.{group}.{version}")
        out = self.fs.create(hidden, True)
        out.write(bytearray(json.dumps({"seq": seq, "group": group, "version": version, "state": state}).encode()))
        out.close()
        if not self.fs.rename(hidden, path):
            self.fs.delete(hidden, False)
            self._record(group, version, state)

    def folder(self, group: str, version: str) -> str:
        return f"{self.root}/data/{group}/{version}"

    def write(self, df: DataFrame, group: str, version: str, state: str) -> None:
        """Data first, then the record (draft or staged) that makes it known. An unrecorded folder is written anew."""
        if self.state_of(group, version) is not None:
            raise ValueError(f"version {version} of {group} exists")
        df.write.mode("overwrite").parquet(self.folder(group, version))
        self.after("data")
        self._record(group, version, state)
        self.after(state)

    def _move(self, group: str, version: str, before: str, state: str) -> None:
        if (found := self.state_of(group, version)) != before:
            raise ValueError(f"version {version} of {group} is {found}, not {before}")
        self._record(group, version, state)
        self.after(state)

    def approve(self, group: str, version: str) -> None:
        """A reviewed draft is staged."""
        self._move(group, version, DRAFT, STAGED)

    def reject(self, group: str, version: str) -> None:
        self._move(group, version, DRAFT, DISCARDED)

    def commit(self, group: str, version: str) -> None:
        """The staged version is what readers see from now on."""
        self._move(group, version, STAGED, CURRENT)

    def current_version(self, group: str) -> str | None:
        row = self.states().where((F.col("group") == group) & (F.col("state") == CURRENT)).orderBy(F.col("seq").desc()).first()
        return row["version"] if row else None

    def read(self, group: str, version: str | None = None) -> DataFrame | None:
        """The given version, or the current one; None if there is none."""
        version = version or self.current_version(group)
        return None if version is None else self.spark.read.parquet(self.folder(group, version))

    def recover(self, group: str, committed: str | None) -> dict[str, str]:
        """What a crash left of a group: version -> current, discarded or removed.

        committed: the version that the group's own record names, the source of truth. Its staged version is made current,
        other staged ones are discarded, data without a record is removed. Drafts wait for their review as before.
        Safe to repeat, also after a crash in itself.
        """
        known = {r["version"]: r["state"] for r in self.states().where(F.col("group") == group).collect()}
        done: dict[str, str] = {}
        for version, state in sorted(known.items()):
            if state == STAGED:
                done[version] = CURRENT if version == committed else DISCARDED
                self._move(group, version, STAGED, done[version])
        for version in self._names(f"{self.root}/data/{group}"):
            if version not in known:
                self.fs.delete(self.path(self.folder(group, version)), True)
                done[version] = "removed"
        return done


def bootstrap(versions: Versions, tags: DataFrame, group: str, version: str, *, min_tags: int, review: bool, update_group: Callable[[str], None]) -> str:
    """rejected, draft or frozen. tags: the curated tags of the group, with their ids.

    Fewer than min_tags tags are rejected and leave nothing. With a review the tags are a draft until `publish` is
    called; without one they are staged, the group's record is updated, and the version becomes current.
    """
    if tags.limit(min_tags).count() < min_tags:
        return "rejected"
    if review:
        versions.write(tags, group, version, DRAFT)
        return "draft"
    versions.write(tags, group, version, STAGED)
    update_group(version)
    versions.after("group")
    versions.commit(group, version)
    return "frozen"


def publish(versions: Versions, group: str, version: str, *, update_group: Callable[[str], None]) -> str:
    """Freeze a draft that was reviewed."""
    versions.approve(group, version)
    update_group(version)
    versions.after("group")
    versions.commit(group, version)
    return "frozen"
