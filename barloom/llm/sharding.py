"""Size-tiered compaction of immutable shards under versioned manifests.

A store is a folder with data files and ``manifests/<version>.json``.  Every change writes new files first
and then commits the next manifest by renaming a finished temporary file to a name that must not exist
yet; a reader uses the highest version, so it sees either the old set of shards or the new one.  A manifest
holds what its version adds and removes, and every SNAPSHOT versions all shards, so a commit's size follows the
change and not the store.  Files that no manifest names are leftovers of lost tasks or belong to a writer that has
not committed yet; they are ignored, and ``vacuum`` deletes them once they are old.

``append`` writes an arrival as it lies, one small shard a task.  ``compact`` puts shards into tiers by
size (powers of ``fanout`` below the target) and merges neighbours of one tier: runs that fill a target, and what
is left of a tier once it has ``fanout`` shards.  Shards of other tiers are not touched, so each is rewritten once a
tier.  A run is one task that reads and writes at most about the target size.  No step shuffles rows.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MERGES_A_JOB = 48
SNAPSHOT = 16  # versions from one whole manifest to the next
GRACE = 86_400.0  # seconds for which vacuum spares folders that no kept version names


@dataclass(frozen=True)
class Shard:
    """One immutable file: its path below the store, bytes, and the version that added it."""

    file: str
    bytes: int
    version: int


def joined(held: StructType, more: StructType) -> StructType:
    """held's columns, then those that only more has; names differ by more than case, as in Spark's default."""
    known, out = {x.name.lower(): x for x in held}, list(held)
    for x in more:
        old = known.setdefault(x.name.lower(), x)
        if old is x:
            out.append(x)
        elif old.dataType.simpleString() != x.dataType.simpleString():
            raise ValueError(f"column {x.name} is {x.dataType.simpleString()}, in the store {old.dataType.simpleString()}")
    return StructType(out)


class Store:
    """A shard store in any folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("manifests"))

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def versions(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """(version, shards) of the latest or of a given version; version 0 is the empty store."""
        held = self._held(version)
        changes, at = [], held
        while "shards" not in at:
            changes.append(at)
            at = self._held(at["version"] - 1)
        shards = {x["file"]: Shard(**x) for x in at["shards"]}
        for change in reversed(changes):
            for file in change["removed"]:
                del shards[file]
            shards |= {x["file"]: Shard(**x) for x in change["added"]}
        return held["version"], list(shards.values())

    def _held(self, version: int | None = None) -> dict:
        if version is None:
            known = self.versions()
            version = known[-1] if known else 0
        if not version:
            return {"version": 0, "shards": []}
        stream = self._fs.open(self._path(f"manifests/{version:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def commit(self, base: int, shards: list[Shard], what: str, schema: StructType | None = None) -> int:
        """Make version base + 1 of these shards; fails if another writer has made it first.  Without a schema that of base stays."""
        version = base + 1
        schema = self.schema(base) if schema is None else schema
        entry = {"version": version, "what": what, "schema": schema.jsonValue()}
        if version % SNAPSHOT == 1:
            entry["shards"] = [asdict(x) for x in shards]
        else:
            old, new = {x.file for x in self.manifest(base)[1]}, {x.file for x in shards}
            entry |= {"added": [asdict(x) for x in shards if x.file not in old], "removed": sorted(old - new)}
        text = json.dumps(entry)
        draft, final = self._path(f"manifests/.draft-{uuid.uuid4().hex}"), self._path(f"manifests/{version:08d}.json")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # without the overwrite option a rename to a name that exists fails
            context.rename(context.makeQualified(draft), context.makeQualified(final), plain)
        except Exception as error:
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} is taken or cannot be written") from error
        return version

    def _written(self, folder: str, version: int) -> list[Shard]:
        found = [(x.getPath().getName(), x.getLen()) for x in self._fs.listStatus(self._path(folder))]
        return [Shard(f"{folder}/{name}", size, version) for name, size in sorted(found) if name.endswith(".parquet")]

    def append(self, rows: DataFrame) -> int:
        """Write an arrival as small shards and commit them; an empty arrival commits what it wrote, if anything.

        Further columns join the store's, and rows without them have nulls there; a column of another type than
        the store's is refused before anything is written.
        """
        base, shards = self.manifest()
        schema = joined(self.schema(base), rows.schema)
        folder = f"data/{base + 1:08d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.root}/{folder}")
        return self.commit(base, shards + self._written(folder, base + 1), "append", schema)

    def tier(self, shard: Shard) -> int:
        """0 for files of the target's size or more (over half of it), then 1, 2, ... for each factor of fanout below."""
        if 2 * shard.bytes > self.target:
            return 0
        return 1 + max(0, math.ceil(math.log(self.target / 2 / max(1, shard.bytes), self.fanout)) - 1)

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs of neighbours (by version and name) of one tier to merge.

        A run that the next shard would carry over the target is merged; what is left of the tier is merged if it has
        ``fanout`` shards or more and waits otherwise, at most fanout - 1 shards a tier.
        """
        tiers: dict[int, list[Shard]] = {}
        for x in shards:
            if level := self.tier(x):
                tiers.setdefault(level, []).append(x)
        runs = []
        for level in sorted(tiers, reverse=True):
            run, size = [], 0
            for x in sorted(tiers[level], key=lambda x: (x.version, x.file)):
                if run and size + x.bytes > self.target:
                    runs.append(run)
                    run, size = [], 0
                run.append(x)
                size += x.bytes
            if len(run) >= self.fanout:
                runs.append(run)
        return [x for x in runs if len(x) > 1]

    def compact(self) -> int:
        """Merge every planned run and commit once; returns the version (unchanged if nothing is to merge)."""
        base, shards = self.manifest()
        runs = self.plan(shards)
        if not runs:
            return base
        folders, schema = [], self.schema(base)
        for lo in range(0, len(runs), MERGES_A_JOB):
            merged = None
            for run in runs[lo : lo + MERGES_A_JOB]:
                part = self._read(run, schema).coalesce(1)
                merged = part if merged is None else merged.union(part)
            folders.append(f"data/{base + 1:08d}-{uuid.uuid4().hex[:8]}")
            merged.write.parquet(f"{self.root}/{folders[-1]}")
        gone = {x.file for run in runs for x in run}
        new = [x for folder in folders for x in self._written(folder, base + 1)]
        return self.commit(base, [x for x in shards if x.file not in gone] + new, "compact", schema)

    def _read(self, shards: list[Shard], schema: StructType) -> DataFrame:
        paths = [f"{self.root}/{x.file}" for x in shards]
        return self.spark.read.schema(schema).parquet(*paths)

    def schema(self, version: int | None = None) -> StructType:
        """All columns of a version."""
        held = self._held(version)
        return StructType.fromJson(held["schema"]) if held["version"] else StructType()

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """The rows of a version; with ``shard`` the path of the shard that each lies in, in a column of that name.

        ValueError for a name that the store's rows have already.
        """
        version, shards = self.manifest(version)
        if not shards:
            raise ValueError("the store is empty")
        schema = self.schema(version)
        if shard is not None and shard.lower() in {x.lower() for x in schema.names}:
            raise ValueError(f"the store has a column {shard}")
        rows = self._read(shards, schema)
        return rows if shard is None else rows.withColumn(shard, F.element_at(F.split(F.col("_metadata.file_path"), f"{self.root.rsplit('/', 1)[-1]}/"), -1))

    def vacuum(self, keep: int = 10, grace: float = GRACE) -> int:
        """Delete data folders that none of the last ``keep`` versions names and that are older than ``grace`` seconds.

        Older versions cannot be read any more.  A writer has ``grace`` seconds from its first file to its commit.
        Returns how many folders went.
        """
        used = {x.file.split("/")[1] for version in self.versions()[-max(1, keep) :] for x in self.manifest(version)[1]}
        gone, data = 0, self._path("data")
        for x in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if x.getPath().getName() not in used and x.getModificationTime() / 1000 <= time.time() - grace:
                self._fs.delete(x.getPath(), True)
                gone += 1
        return gone


def ingest(rows: DataFrame, arrivals: list, root: str, target_bytes: int, fanout: int = 4) -> Store:
    """Append rows in arrivals (conditions that split them), then compact; nothing is deleted.

    Rows go with the first arrival whose condition holds, and those that no condition holds for, or only null ones, come
    in an arrival of their own at the end, if there are any conditions: no row is left out or stored twice.  Nulls, empty
    and very long texts, repeated rows and any further columns are stored as they are; empty arrivals and tables make
    versions without rows.  Only columns that Parquet cannot hold fail, as in Spark.
    """
    store = Store(rows.sparkSession, root, target_bytes, fanout)
    taken = F.lit(False)
    for condition in arrivals:
        store.append(rows.where(~taken & condition))
        taken = taken | F.coalesce(condition, F.lit(False))
    store.append(rows.where(~taken))
    store.compact()
    return store
