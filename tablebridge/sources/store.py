"""Versioned tables under one folder; a manifest file per version is the only commit point."""

from __future__ import annotations

import json
import math
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

#: Names of a bucket's column, and of a change's version and whether its row lives, beside a table's own columns.
BUCKET, VERSION, LIVE = "_bucket", "_version", "_live"
#: Bytes that a bucket should hold, most buckets of a table, and what makes a bucket be written anew: changed rows against its own, folders to merge.
BUCKET_BYTES, MOST_BUCKETS = 256_000_000, 10_000
CHANGED_SHARE, MOST_FOLDERS = 0.25, 8


class Conflict(RuntimeError):
    """Another writer made the version first, or the state is not what the caller expected."""


@dataclass
class Bucketed:
    """A table by hash of its key (of the whole row, if it has none): what the manifest says of it.

    ``parts`` has, by bucket, the folders of its rows and of later changes, and how many there are. ``schemas`` lists the schemas it has had, each
    with the transaction since which it holds; rows of earlier ones have nulls in columns that came later.
    """

    keys: list[str]
    buckets: int
    schema: StructType
    parts: dict[str, dict] = field(default_factory=dict)
    schemas: list[dict] = field(default_factory=list)

    def to_json(self) -> dict:
        return {"keys": self.keys, "buckets": self.buckets, "schema": self.schema.jsonValue(), "parts": self.parts, "schemas": self.schemas}

    @classmethod
    def of(cls, entry: dict) -> Bucketed:
        return cls(entry["keys"], entry["buckets"], StructType.fromJson(entry["schema"]), json.loads(json.dumps(entry["parts"])), list(entry["schemas"]))

    def bucket(self, row_key: Column | None = None) -> Column:
        of = row_key if row_key is not None else F.xxhash64(*self.keys)
        return F.pmod(of, F.lit(self.buckets)).cast("int")

    def folders(self) -> set[str]:
        return {f for p in self.parts.values() for f in [*p["base"], *p["changes"]]}


class TableStore:
    """Tables as Parquet folders, and ``_manifest/NNN.json`` with their paths, the applied position and job state.

    Data is written to fresh folders first; a version becomes visible by the rename of its manifest, to which the creation of its claim
    gives the right. A failure before that leaves the version before untouched. Two writers are told apart where the file system creates a file
    only once (HDFS, local, object stores with conditional writes); after a crash between the two steps abandon() gives the version back.

    A table is one folder (stage), or bucketed (stage_buckets): then a change of some rows writes those rows, as changes that a read merges, and a bucket
    is written anew only when its changes are many. A version names folders of any age, so a table or bucket that didn't change is shared between
    versions. Readers of an older version pin it; collect() deletes what no kept or pinned version names.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Versions

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/_manifest/{version:012d}.json"

    def _claim_path(self, version: int):
        return self._path(f"{self.root}/_manifest/{version:012d}.claim")

    def abandon(self, version: int) -> None:
        """Drop the claim of a version whose writer died before it published."""
        if self.fs.exists(self._path(self._manifest_path(version))):
            raise Conflict(f"version {version} exists")
        self.fs.delete(self._claim_path(version), False)

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("_manifest") if n.endswith(".json") and not n.startswith(".")]

    def _load(self, path: str) -> dict:
        stream = self.fs.open(self._path(path))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _save(self, path: str, content: dict) -> None:
        out = self.fs.create(self._path(path), False)
        out.write(json.dumps(content, sort_keys=True).encode())
        out.close()

    def at(self, version: int) -> dict:
        """The manifest of a version that is still kept."""
        if version == 0:
            return {"version": 0, "tables": {}, "position": -1, "state": {}}
        if not self.fs.exists(self._path(self._manifest_path(version))):
            raise Conflict(f"version {version} is not kept")
        return self._load(self._manifest_path(version))

    def latest(self) -> dict:
        return self.at(max(self.versions(), default=0))

    def commit(self, before: dict, tables: dict[str, object], position: int, **state: object) -> dict:
        """Publish a version after ``before``; Conflict if it exists already."""
        named = {t: e.to_json() if isinstance(e, Bucketed) else e for t, e in tables.items()}
        new = {"version": before["version"] + 1, "tables": before["tables"] | named, "position": position, "state": before["state"] | state}
        target, temp = self._path(self._manifest_path(new["version"])), f"{self.root}/_manifest/.{uuid.uuid4().hex}"
        self._save(temp, new)
        try:
            self.fs.create(self._claim_path(new["version"]), False).close()
        except Exception as e:
            raise Conflict(f"version {new['version']} is another writer's") from e
        if self.fs.exists(target) or not self.fs.rename(self._path(temp), target):
            raise Conflict(f"version {new['version']} exists")
        return new

    # Reading

    def read(self, table: str, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of a version (the latest without one); of a bucketed table, some buckets alone."""
        entry = (manifest or self.latest())["tables"][table]
        return self.spark.read.parquet(entry) if isinstance(entry, str) else self.merged(Bucketed.of(entry), buckets)

    def entry(self, table: str, manifest: dict | None = None) -> Bucketed | str:
        entry = (manifest or self.latest())["tables"][table]
        return entry if isinstance(entry, str) else Bucketed.of(entry)

    def _rows(self, schema: StructType, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merged(self, t: Bucketed, buckets: list[int] | None = None) -> DataFrame:
        """Buckets without changes are read as they are; in the others the last change of a key decides."""
        chosen = {b: p for b, p in t.parts.items() if buckets is None or int(b) in set(buckets)}
        paths = lambda kind, only: [f"{f}/{BUCKET}={b}" for b, p in sorted(chosen.items(), key=lambda x: int(x[0])) if bool(p["changes"]) in only for f in p[kind]]
        clean = self._rows(t.schema, paths("base", {False} if t.keys else {False, True}))
        if not t.keys or not any(p["changes"] for p in chosen.values()):
            return clean
        change = StructType([*[StructField(f.name, f.dataType, True) for f in t.schema], StructField(LIVE, BooleanType()), StructField(VERSION, LongType())])
        changes = self._rows(change, paths("changes", {True}))
        cols = t.schema.names
        last = changes.groupBy(*t.keys).agg(F.max_by(F.struct(LIVE, *cols), VERSION).alias("last")).select("last.*")
        kept = self._rows(t.schema, paths("base", {True})).join(last.select(*t.keys), t.keys, "left_anti").select(cols)
        return clean.unionByName(kept).unionByName(last.where(LIVE).select(cols))

    # Writing

    def stage(self, table: str, df: DataFrame) -> str:
        path = f"{self.root}/{table}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _write(self, table: str, df: DataFrame) -> tuple[str, dict[str, int]]:
        """Rows with their bucket in a fresh folder, a subfolder for each bucket; the folder, and rows by bucket.

        Small buckets share a task and large ones are split, by the sizes that adaptive execution measures.
        """
        path = f"{self.root}/{table}/{uuid.uuid4().hex}"
        df.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(path)
        counts = self.spark.read.schema(StructType([*df.schema.fields[:0], StructField(BUCKET, IntegerType())])).parquet(path).groupBy(BUCKET).count()
        return path, {str(r[0]): r[1] for r in counts.collect()}

    def stage_buckets(self, table: str, df: DataFrame, keys: list[str], buckets: int | None = None) -> Bucketed:
        """A whole table in buckets by hash; their number, if not given, by its estimated size."""
        if buckets is None:
            size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().doubleValue())
            buckets = min(MOST_BUCKETS, max(1, math.ceil(size / BUCKET_BYTES)))
        plain = StructType([StructField(f.name, f.dataType, True) for f in df.schema])
        t = Bucketed(keys, buckets, plain, schemas=[{"since": -1, "schema": plain.jsonValue()}])
        path, counts = self._write(table, df.withColumn(BUCKET, self._bucket_of(t, df)))
        t.parts = {b: {"base": [path], "changes": [], "rows": n, "changed": 0} for b, n in counts.items()}
        return t

    def _bucket_of(self, t: Bucketed, df: DataFrame) -> Column:
        from ..operators.cdc import row_key

        return t.bucket() if t.keys else t.bucket(F.xxhash64(row_key(t.schema.names)))

    def stage_changes(self, table: str, t: Bucketed, last: DataFrame, version: int) -> Bucketed:
        """The table with the last change of each key: ``live`` and the columns of the table (of a dead row its key alone).

        Only the changes are written, into the buckets they belong to; a bucket whose changes are over CHANGED_SHARE of its rows, or lie in more than
        MOST_FOLDERS folders, is merged and written anew, with all such buckets in one job.
        """
        t = Bucketed.of(t.to_json())
        rows = last.select(*t.schema.names, F.col("live").alias(LIVE), F.lit(version).cast("long").alias(VERSION), t.bucket().alias(BUCKET))
        path, counts = self._write(table, rows)
        for b, n in counts.items():
            p = t.parts.setdefault(b, {"base": [], "changes": [], "rows": 0, "changed": 0})
            p["changes"].append(path)
            p["changed"] += n
        anew = [int(b) for b in counts if t.parts[b]["changed"] > CHANGED_SHARE * t.parts[b]["rows"] or len(t.parts[b]["changes"]) > MOST_FOLDERS]
        return self._compacted(table, t, anew) if anew else t

    def _compacted(self, table: str, t: Bucketed, buckets: list[int], rows: DataFrame | None = None) -> Bucketed:
        rows = self.merged(t, buckets) if rows is None else rows
        path, counts = self._write(table, rows.withColumn(BUCKET, self._bucket_of(t, rows)))
        for b in map(str, buckets):
            t.parts.pop(b, None)
            if b in counts:
                t.parts[b] = {"base": [path], "changes": [], "rows": counts[b], "changed": 0}
        return t

    def compact(self, table: str, manifest: dict | None = None) -> dict:
        """Write every bucket anew that has changes or several folders, and publish."""
        now = manifest or self.latest()
        t = Bucketed.of(now["tables"][table])
        anew = [int(b) for b, p in t.parts.items() if p["changes"] or len(p["base"]) > 1]
        return self.commit(now, {table: self._compacted(table, t, anew)}, now["position"]) if anew else now

    def stage_bag(self, table: str, t: Bucketed, net: DataFrame) -> Bucketed:
        """A keyless table after ``net`` (rk, d, row): rows that come are appended; a bucket that rows leave, or with many folders, is written anew."""
        from ..operators.cdc import apply_net, repeated

        t = Bucketed.of(t.to_json())
        placed = net.withColumn(BUCKET, t.bucket(F.xxhash64("rk")))
        leave = {r[0] for r in placed.where("d < 0").select(BUCKET).distinct().collect()}
        often = {int(b) for b, p in t.parts.items() if len(p["base"]) > MOST_FOLDERS}
        anew = sorted(leave | often)
        inside = F.col(BUCKET).isin(anew) if anew else F.lit(False)
        come = repeated(placed.where(~inside), t.schema.names, BUCKET)
        path, counts = self._write(table, come)
        for b, n in counts.items():
            p = t.parts.setdefault(b, {"base": [], "changes": [], "rows": 0, "changed": 0})
            p["base"].append(path)
            p["rows"] += n
        if anew:
            self._compacted(table, t, anew, apply_net(self.merged(t, anew), placed.where(inside).drop(BUCKET)))
        return t

    # Schema

    def acknowledge(self, txn_seq: int, schemas: dict[str, StructType] | None = None) -> dict:
        """A statement that changed the source's schema was carried out here as well: publish that, and the tables' schemas from there on.

        Rows written before stay as they are: a column that came has nulls in them, one that went is no longer read. A changed type is not read
        from old files, so it needs the table staged anew.
        """
        now, tables = self.latest(), {}
        for name, schema in (schemas or {}).items():
            t = Bucketed.of(now["tables"][name])
            kinds = {f.name: f.dataType for f in t.schema}
            if changed := [f.name for f in schema if f.name in kinds and kinds[f.name] != f.dataType]:
                raise ValueError(f"type of {changed} changes: stage {name} anew")
            if gone := [k for k in t.keys if k not in schema.names]:
                raise ValueError(f"key {gone} of {name} is gone: stage it anew")
            if not t.keys:
                raise ValueError(f"{name} has no key, its buckets depend on all columns: stage it anew")
            t.schema = StructType([StructField(f.name, f.dataType, True) for f in schema])
            t.schemas.append({"since": txn_seq, "schema": t.schema.jsonValue()})
            tables[name] = t
        return self.commit(now, tables, now["position"], acknowledged=txn_seq)

    # Leases and collection

    @contextmanager
    def pin(self, version: int | None = None, seconds: float = 3600.0):
        """The manifest of a version, which is kept until the end of the block, or so long if the reader dies."""
        manifest = self.latest() if version is None else self.at(version)
        path = f"{self.root}/_leases/{uuid.uuid4().hex}.json"
        self._save(path, {"version": manifest["version"], "until": time.time() + seconds})
        try:
            if manifest["version"]:
                self.at(manifest["version"])  # it may have gone before the lease was there
            yield manifest
        finally:
            self.fs.delete(self._path(path), False)

    def leased(self) -> set[int]:
        """Versions that readers hold; leases that have run out are deleted."""
        out = set()
        for name in self._names("_leases"):
            path = f"{self.root}/_leases/{name}"
            lease = self._load(path)
            if lease["until"] < time.time():
                self.fs.delete(self._path(path), False)
            else:
                out.add(lease["version"])
        return out

    def named(self, manifest: dict) -> set[str]:
        """All folders that a version reads."""
        out = set()
        for entry in manifest["tables"].values():
            out |= {entry} if isinstance(entry, str) else Bucketed.of(entry).folders()
        return out | {p["path"] for p in manifest["state"].get("pending", [])}

    def collect(self, keep: int = 1, grace: float = 3600.0) -> list[str]:
        """Delete versions but the last ``keep`` and those pinned, and the folders that no other version names; returns these.

        A folder younger than ``grace`` seconds stays, as its writer may not have published it yet. Manifests go first, so that none names a
        folder that is gone.
        """
        versions = self.versions()
        kept = set(versions[-max(1, keep):]) | self.leased()
        names = {n for v in versions if v in kept for n in self.named(self.at(v))}
        kept_names = {n.removeprefix(self.root + "/") for n in names}
        for v in versions:
            if v not in kept:
                self.fs.delete(self._path(self._manifest_path(v)), False)
                self.fs.delete(self._claim_path(v), False)
        gone, young = [], (time.time() - grace) * 1000
        for table in self._names(""):
            if table in ("_manifest", "_leases"):
                continue
            for status in self.fs.listStatus(self._path(f"{self.root}/{table}")):
                path = f"{table}/{status.getPath().getName()}"
                if path not in kept_names and status.getModificationTime() <= young and self.fs.delete(status.getPath(), True):
                    gone.append(path)
        return gone

    def size_of(self, folders: set[str]) -> int:
        """Bytes of these folders."""
        return sum(self.fs.getContentSummary(self._path(f)).getLength() for f in folders if self.fs.exists(self._path(f)))
