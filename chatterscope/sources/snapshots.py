"""Versions of the stored tables: incremental merges, published whole.

A table's rows lie in buckets by a hash of their key. A version is a manifest that names, for each table and
bucket, the files that hold it. A load stages its rows once, rewrites the buckets that they fall into as new
files, and names the files of all other buckets as they are: those are neither read nor written. The manifest
is written last, under a name that must not exist, so that a reader sees all tables of a version or none of
it, a load that dies leaves only files that no manifest names, and of two loads that start from one version
the second fails.

Data is written by Spark's tasks; the driver lists touched buckets and writes a manifest, whose size follows
the number of buckets and files, never rows.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterscope import schemas
from chatterscope.operators.checks import counted, require_unique
from chatterscope.operators.keyed import latest

_BUCKET, _SHARE, _STORED = "_bucket", "_share", "_stored"
_DIGITS = 12
#: A merge cuts its buckets into shares of about so many bytes of files, each a task's.
SHARE_BYTES = 32 << 20


class _Folder:
    """What a driver does with a folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def names(self, at: str) -> list[str]:
        path = self._path(f"{self.root}/{at}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, at: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{at}"))
        try:
            return bytearray(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def size(self, at: Iterable[str]) -> int:
        """Bytes of files, or of all files in folders."""
        return sum(self._fs.getContentSummary(self._path(f"{self.root}/{a}")).getLength() for a in at)

    def create(self, at: str, text: str) -> None:
        """Write a new file; it must not exist."""
        stream = self._fs.create(self._path(f"{self.root}/{at}"), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, at: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{at}"), True)


@dataclass(frozen=True)
class Updates:
    """Rows to upsert: of a key's rows the first in `order` stands."""

    rows: DataFrame
    order: Sequence[Column] = ()


class Snapshots:
    """The versions under a folder that driver and executors share."""

    def __init__(
        self, spark: SparkSession, root: str, buckets: int = 64, tables: Mapping[str, object] = schemas.TABLES,
        keys: Mapping[str, str] = schemas.PRIMARY_KEY, unique: Mapping[str, Sequence[str]] | None = None,
    ):
        """buckets: of a new folder; one that has versions keeps its own. unique: columns, by table, whose
        values no two rows of a version may share; user names, unless given."""
        self.spark, self.tables, self.keys = spark, tables, keys
        self.unique = {"users": ["redditor"]} if unique is None else unique
        self.folder = _Folder(spark, root)
        self.root, self._buckets = self.folder.root, buckets

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        found = (name.partition(".")[0] for name in self.folder.names("manifests") if name.endswith(".json"))
        return [int(v) for v in found if v.isdigit() and self._manifest(int(v))]

    def _next(self) -> int:
        """A number that no manifest has, cut off or not."""
        used = [int(n.partition(".")[0]) for n in self.folder.names("manifests") if n.partition(".")[0].isdigit()]
        return max(used, default=0) + 1

    def _manifest(self, version: int) -> dict | None:
        """None for one that was not written to its end."""
        try:
            found = json.loads(self.folder.read(f"manifests/{version:0{_DIGITS}d}.json"))
        except ValueError:
            return None
        return found if found.get("complete") else None

    def _named(self, version: int | None) -> dict:
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "buckets": self._buckets, "tables": {}}
        if version is not None and version not in known:
            raise ValueError(f"no version {version} under {self.root}")
        return self._manifest(known[-1] if version is None else version)

    def _files(self, manifest: dict, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        files = manifest["tables"].get(name, {}).get("files", {})
        wanted = files if buckets is None else [str(b) for b in buckets if str(b) in files]
        paths = [f"{self.root}/{f}" for b in wanted for f in files[b]]
        if not paths:
            return self.spark.createDataFrame([], self.tables[name])
        return self.spark.read.schema(self.tables[name]).parquet(*paths)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the last one unless given; without versions it is empty."""
        return self._files(self._named(version), name)

    def rows(self, version: int | None = None) -> dict[str, int]:
        """The rows of each table, counted while they were written."""
        return {name: sum(t["rows"].values()) for name, t in self._named(version)["tables"].items()}

    def load(
        self, updates: Mapping[str, Updates], feed: tuple[str, int] | None = None, counters: Mapping[str, int] | None = None
    ) -> int:
        """Upsert into the tables named; the new version, which holds all of them or does not exist.

        feed: a feed's name and the number of this batch of it, which the version remembers. A batch that is
        not newer than the last one of its feed, or holds no rows, makes no version; the last one is returned.

        counters: what the load counted before; named with the version, see `counters`.
        """
        number = self._next()  # asked for first: a version that appears meanwhile takes this number
        before = self._named(None)
        feeds = dict(before.get("feeds", {}))
        if feed:
            if feeds.get(feed[0], -1) >= feed[1]:
                return before["version"]
            feeds[feed[0]] = feed[1]
        made = f"{number:0{_DIGITS}d}-{uuid.uuid4().hex}"
        after = {"version": number, "buckets": before["buckets"], "tables": dict(before["tables"]), "feeds": feeds}
        after["counters"] = dict(counters or {})
        try:
            for name, update in updates.items():
                after["tables"][name] = self._merged(before, name, update, made)
        finally:
            self.folder.delete(f"staged/{made}")
        if feed and all(after["tables"][n]["files"] == before["tables"].get(n, {"files": {}})["files"] for n in updates):
            return before["version"]
        self._publish(after, updates)
        return number

    def counters(self) -> DataFrame:
        """`(version, what, n)`: what the load of each version counted."""
        if not self.versions():
            return self.spark.createDataFrame([], "version int, what string, n bigint")
        schema = "complete boolean, version int, counters map<string,bigint>"
        manifests = self.spark.read.schema(schema).json(f"{self.root}/manifests/*.json").where("complete")
        return manifests.select("version", F.explode("counters").alias("what", "n"))

    def holds(self, feed: tuple[str, int]) -> bool:
        """Whether the last version has this batch of a feed, or a newer one."""
        return self._named(None).get("feeds", {}).get(feed[0], -1) >= feed[1]

    def clear(self, names: Iterable[str] | None = None) -> int:
        """A version in which tables, all unless named, are empty."""
        number = self._next()
        before = self._named(None)
        gone = set(self.tables if names is None else names)
        kept = {name: t for name, t in before["tables"].items() if name not in gone}
        self._publish(before | {"version": number, "tables": kept, "counters": {}}, ())
        return number

    def _bucket(self, name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.keys[name])), F.lit(buckets)).cast("int")

    def _merged(self, before: dict, name: str, update: Updates, made: str) -> dict:
        """Stage the rows, rewrite their buckets, and say where the table's files are now."""
        key, bucket = self.keys[name], self._bucket(name, before["buckets"])
        # Staged, the rows are computed once, whatever they come from.
        staged_at = f"{self.root}/staged/{made}/{name}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.tables[name]]
        first = latest(update.rows.where(F.col(key).isNotNull()), [key], update.order or [F.lit(1)])
        first.select(*columns).withColumn(_BUCKET, bucket).write.parquet(staged_at)
        schema = self.spark.createDataFrame([], self.tables[name]).withColumn(_BUCKET, F.lit(0)).schema
        staged = self.spark.read.schema(schema).parquet(staged_at)
        touched = sorted(r[0] for r in staged.select(_BUCKET).distinct().collect())  # at most a row for each bucket
        table = before["tables"].get(name, {"files": {}, "rows": {}})
        if not touched:
            return table
        stored = self._files(before, name, touched).withColumn(_BUCKET, bucket)
        both = stored.withColumn(_STORED, F.lit(True)).unionByName(staged.withColumn(_STORED, F.lit(False)))
        # One exchange, by bucket and share of it: the merge, and a file for each share.
        held = [f for b in touched for f in table["files"].get(str(b), [])]
        size = self.folder.size([f"staged/{made}/{name}", *held])
        shares = max(1, math.ceil(size / SHARE_BYTES / len(touched)))
        share = F.pmod(F.xxhash64(F.lit(_SHARE), F.col(key)), F.lit(shares)).cast("int")
        dealt = both.withColumn(_SHARE, share).repartition(len(touched) * shares, _BUCKET, _SHARE)
        merged = latest(dealt, [_BUCKET, _SHARE, key], [F.col(_STORED).asc()]).drop(_STORED, _SHARE)
        at = f"data/{name}/{made}"
        per_bucket, seen = counted(
            merged, f"{name}-{made}", **{f"b{b}": F.count(F.when(F.col(_BUCKET) == b, 1)) for b in touched}
        )
        per_bucket.write.partitionBy(_BUCKET).parquet(f"{self.root}/{at}")
        files, rows = dict(table["files"]), dict(table["rows"])
        for b in touched:
            inside = f"{at}/{_BUCKET}={b}"
            files[str(b)] = [f"{inside}/{f}" for f in self.folder.names(inside) if f.endswith(".parquet")]
            rows[str(b)] = seen.get[f"b{b}"]
        return {"files": files, "rows": rows}

    def _publish(self, after: dict, updated: Iterable[str]) -> None:
        """Check what was written, then name it."""
        for name in updated:
            for column in self.unique.get(name, ()):
                require_unique(self._files(after, name).select(column), column)
        self.folder.create(f"manifests/{after['version']:0{_DIGITS}d}.json", json.dumps(after | {"complete": True}))
