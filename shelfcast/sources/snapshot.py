"""One snapshot of the sales table, shared by batch and streaming writers.

A snapshot is a folder of commits. Every write goes to a folder of its own,
``data/commit=<id>``, partitioned by sale month, and is seen by nobody until a
manifest lists it. Manifests are numbered files, ``manifest/<n>.json``; the one
of the highest number is the snapshot. A number is taken by renaming a finished
file to it, which fails if it exists, so of two writers one reads the other's
manifest and tries again. Appending, replacing and compacting are all the
same step: write a folder, then publish a manifest with other commits in it.

A streaming writer names the micro-batch with its commit. A batch that the
manifest knows already, because the stream was restarted between publishing and
its own checkpoint, changes nothing.

Commits are kept few by their size: where ``fanin`` of them are of one size
class (powers of ``fanin``), they are rewritten as one. So a row is rewritten a
logarithmic number of times, and a month has as many files as its bytes ask
for, plus at most ``fanin`` small ones per size class.

The exclusive rename holds on HDFS and local file systems; on an object store
without it, let one writer publish at a time.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Commits under this many bytes are of one size class.
SMALL_BYTES = 64 << 20
#: Commits of a size class that are rewritten as one.
FANIN = 8


class _Folder:
    """Small files of a snapshot, through Spark's own file system layer."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.root = self._path(path)
        self.fs = self.root.getFileSystem(self.conf)

    def _path(self, *parts):
        return self.jvm.org.apache.hadoop.fs.Path(*parts)

    def at(self, name: str):
        return self._path(self.root, name)

    def names(self, folder: str) -> list[str]:
        where = self.at(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a file whole under a name that no other writer has taken; false if one has."""
        draft = self.at(f"drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, True)
        self.jvm.org.apache.commons.io.IOUtils.write(text, stream, "UTF-8")
        stream.close()
        target = self.at(name)
        self.fs.mkdirs(target.getParent())
        qualified = [self.fs.makeQualified(x) for x in (draft, target)]
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified[0].toUri(), self.conf)
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            context.rename(*qualified, self.gateway.new_array(rename, 0))
            return True
        except Exception as error:
            taken = self.fs.exists(target)
            self.fs.delete(draft, False)
            if not taken:
                raise error
            return False

    def size(self, name: str) -> int:
        where = self.at(name)
        return sum(self.size(f"{name}/{x.getPath().getName()}") if x.isDirectory() else x.getLen()
                   for x in self.fs.listStatus(where) if x.isDirectory() or x.getPath().getName().endswith(".parquet")) if self.fs.exists(where) else 0

    def age_seconds(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self.at(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def names(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Entries of a folder of the snapshot; none if it isn't there."""
    return _Folder(spark, path).names(folder)


def count_files(spark: SparkSession, path: str, ending: str) -> int:
    """Files below ``path`` whose name has this ending."""
    folder = _Folder(spark, path)
    found, count = folder.fs.listFiles(folder.root, True), 0
    while found.hasNext():
        count += found.next().getPath().getName().endswith(ending)
    return count


EMPTY = {"version": 0, "commits": [], "streams": {}}


def _versions(folder: _Folder) -> list[int]:
    return sorted(int(n[:-5]) for n in folder.names("manifest") if n.endswith(".json"))


def manifest(spark: SparkSession, path: str) -> dict:
    """The snapshot's commits, and the last micro-batch of each stream that wrote to it."""
    folder = _Folder(spark, path)
    found = _versions(folder)
    return json.loads(folder.read(f"manifest/{found[-1]}.json")) if found else EMPTY


def publish(spark: SparkSession, path: str, change: Callable[[dict], dict | None]) -> bool:
    """Publish what ``change`` makes of the newest manifest; false if it makes nothing of it."""
    while True:
        old = manifest(spark, path)
        new = change(old)
        if new is None:
            return False
        new["version"] = old["version"] + 1
        if _Folder(spark, path).publish(f"manifest/{new['version']}.json", json.dumps(new)):
            return True


def _write(df: DataFrame, path: str, name: str) -> int:
    """Write a commit's folder, rebalanced by month; its bytes."""
    (df.withColumn("sale_month", F.date_format("sale_date", "yyyy-MM")).hint("rebalance", "sale_month")
       .write.mode("overwrite").partitionBy("sale_month").parquet(f"{path}/data/commit={name}"))
    return _Folder(df.sparkSession, path).size(f"data/commit={name}")


def commit(df: DataFrame, path: str, replace: bool = False, batch: tuple[str, int] | None = None,
           outcomes: Callable[[], dict[str, int]] | None = None) -> bool:
    """Add ``df`` to the snapshot, or put it in place of all earlier commits.

    ``batch``: a stream's name and the number of its micro-batch; one that was
    committed before is skipped (false). ``outcomes`` is asked, after the rows
    are written, how many source lines were accepted and rejected.
    """
    spark = df.sparkSession

    def known(old: dict) -> bool:
        return batch is not None and old["streams"].get(batch[0], -1) >= batch[1]
    if known(manifest(spark, path)):
        return False
    # a micro-batch that is tried again writes over what its first try left
    name = f"{batch[0]}-{batch[1]}" if batch else uuid.uuid4().hex
    size = _write(df, path, name)
    entry = {"name": name, "bytes": size, "outcomes": outcomes() if outcomes else {}}

    def add(old: dict) -> dict | None:
        if known(old):
            return None
        streams = {**old["streams"], **({batch[0]: batch[1]} if batch else {})}
        return {"commits": ([] if replace else old["commits"]) + [entry], "streams": streams}
    return publish(spark, path, add)


def read(spark: SparkSession, path: str, schema: T.StructType, names: Sequence[str] | None = None) -> DataFrame:
    """Rows of the commits that the newest manifest lists (or of those named), with ``sale_month``."""
    listed = [c["name"] for c in manifest(spark, path)["commits"] if c["bytes"]] if names is None else names
    full = T.StructType([*schema.fields, T.StructField("commit", T.StringType()), T.StructField("sale_month", T.StringType())])
    if not listed:
        return spark.createDataFrame([], full).drop("commit")
    return (spark.read.schema(full).option("basePath", f"{path}/data")
            .parquet(*[f"{path}/data/commit={n}" for n in listed]).drop("commit"))


def outcome_counts(spark: SparkSession, path: str) -> dict[str, int]:
    """Source lines by outcome, over all commits that counted them."""
    total: dict[str, int] = {}
    for c in manifest(spark, path)["commits"]:
        for k, n in c["outcomes"].items():
            total[k] = total.get(k, 0) + n
    return total


def compact(spark: SparkSession, path: str, schema: T.StructType, fanin: int = FANIN, small_bytes: int = SMALL_BYTES) -> int:
    """Rewrite commits of one size class as one, wherever there are ``fanin``; the number of rewrites."""
    done = 0
    while True:
        classes: dict[int, list[dict]] = {}
        for c in manifest(spark, path)["commits"]:
            classes.setdefault(max(0, math.ceil(math.log(max(c["bytes"], 1) / small_bytes, fanin))), []).append(c)
        full = next((cs for _, cs in sorted(classes.items()) if len(cs) >= fanin), None)
        if full is None:
            return done
        old_names = {c["name"] for c in full}
        name = uuid.uuid4().hex
        size = _write(read(spark, path, schema, [c["name"] for c in full if c["bytes"]]).drop("sale_month"), path, name)
        counts: dict[str, int] = {}
        for c in full:
            for k, n in c["outcomes"].items():
                counts[k] = counts.get(k, 0) + n

        def swap(old: dict) -> dict | None:
            if not old_names <= {c["name"] for c in old["commits"]}:
                return None  # replaced or compacted by another writer
            kept = [c for c in old["commits"] if c["name"] not in old_names]
            return {"commits": kept + [{"name": name, "bytes": size, "outcomes": counts}], "streams": old["streams"]}
        if publish(spark, path, swap):
            done += 1


def remove_unlisted(spark: SparkSession, path: str, keep_versions: int = 10, min_age_hours: float = 24.0) -> list[str]:
    """Delete commit folders that none of the newest manifests lists, and older manifests.

    Folders younger than ``min_age_hours`` stay: a writer may be about to publish them.
    """
    folder = _Folder(spark, path)
    versions = _versions(folder)
    kept = versions[-keep_versions:]
    listed = {c["name"] for v in kept for c in json.loads(folder.read(f"manifest/{v}.json"))["commits"]}
    gone = [n for n in folder.names("data") if n.startswith("commit=") and n[len("commit="):] not in listed
            and folder.age_seconds(f"data/{n}") >= min_age_hours * 3600]
    for n in gone:
        folder.delete(f"data/{n}")
    for v in versions[:-keep_versions]:
        folder.delete(f"manifest/{v}.json")
    return gone
