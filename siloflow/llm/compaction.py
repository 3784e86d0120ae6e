"""Sharding by size-tiered compaction, in DataFrame operations only.

A store is a folder with ``data/<generation>/`` of immutable Parquet files, ``manifest/<name>/``, small
tables that name the live files of a version with their rows, bytes of text and tier, and ``version/v<n>``, one small file for each version
that names its manifest. ``append`` writes an
arrival as it comes, without a shuffle, in shards of about ``small`` bytes; documents above that are shards of their own. ``compact`` looks at the
manifest alone: where a tier (files within a factor of ``fan_in`` of each other) has at least ``fan_in``
files, neighbours are merged into files of about ``target`` bytes (1.5 times that at most), in one shuffle of just these
files, in which each task writes one of them; files of half the target or more are done. Each step reads back what it wrote, compares the rows
and then commits: the new manifest is written, then the file that makes it a version is renamed into its place, which fails if
another writer took it. That is atomic wherever a rename of one file that does not overwrite is (HDFS, a local disk); in other stores there may be one writer
at a time. Readers see a whole version or none, and its files stay until ``expire`` drops the version: ``snapshot``
compares the rows of the files with the manifest and fails otherwise.

Generations and manifests have random names, so that a writer that dies leaves nothing in anyone's way; ``expire`` also deletes such
leftovers once they are old. A task that is lost is run again by Spark's committer, and files that no manifest names are never read.
The manifest has one row for each file and is handled as a table; the driver sees counts and, to read files, their names, as
Spark's own file index does. Packing works on stretches of CHUNK files, so that no window spans all of them.

Edge cases: rows with null text have 0 bytes and are kept. Repeated rows are kept as often as they came.
An empty arrival commits a version
without new files. Columns are stored as they are; only names that start with ``_shard`` are refused.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siloflow.llm.common import scratch, small

SMALL = 4 << 20
TARGET = 64 << 20
FAN_IN = 4
CHUNK = 4096
ARRIVALS = 3
MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("generation", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("tier", T.IntegerType()),
    ]
)


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass
class Store:
    spark: SparkSession
    root: str
    schema: T.StructType
    text: str = "text"
    small: int = SMALL
    target: int = TARGET
    fan_in: int = FAN_IN

    def __post_init__(self) -> None:
        if any(c.startswith("_shard") for c in self.schema.names):
            raise ValueError("column names that start with _shard are taken")

    # ---- the file system, by Hadoop's interface

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, top = self._fs(), self._path(*parts)
        return [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names("version") if re.fullmatch(r"v\d{8}", n))

    def version(self) -> int:
        """The last committed version, 0 for a new store."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in MANIFEST.fields))
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{self._manifest_of(version)}")

    def _manifest_of(self, version: int) -> str:
        source = self._fs().open(self._path("version", f"v{version:08d}"))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def _commit(self, files: DataFrame, base: int) -> int:
        """Write the manifest, then rename the file that names it to the next version; the rename fails if that is there."""
        name = uuid.uuid4().hex
        files.select(*MANIFEST.names).coalesce(1 + files.sparkSession.sparkContext.defaultParallelism // 4).write.parquet(f"{self.root}/manifest/{name}")
        fs, aside = self._fs(), self._path("version", f"_{name}")
        out = fs.create(aside, False)
        out.write(bytearray(name.encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("x").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(aside, self._path("version", f"v{base + 1:08d}"), none)
        except Py4JJavaError as e:
            fs.delete(aside, False)
            fs.delete(self._path("manifest", name), True)
            raise Conflict(f"version {base + 1} of {self.root} is there already") from e
        return base + 1

    # ---- files

    def _read(self, paths: list[str]) -> DataFrame:
        """All rows of some files or folders, with _shard_path."""
        if not paths:
            empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
            return self.spark.range(0).select(*empty, F.lit("").alias("_shard_path"))
        read = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*(f"{self.root}/data/{x}" for x in paths))
        return read.withColumn("_shard_path", F.regexp_extract(F.col("_metadata.file_path"), r"/data/([^/]+/.*)$", 1))

    def _described(self, generation: str) -> DataFrame:
        """The manifest rows of a generation, read from its files."""
        held = self._read([generation] if self._names("data", generation) else []).groupBy(F.col("_shard_path").alias("path")).agg(
            F.count("*").alias("rows"), F.sum(F.coalesce(F.octet_length(self.text), F.lit(0))).cast("long").alias("bytes")
        )
        part = F.regexp_extract("path", r"part-(\d+)-([0-9a-f]{4})", 0)
        name = F.when(F.col("path").contains("_shard_group="), F.regexp_extract("path", r"_shard_group=(\d+)", 1)).otherwise(F.concat_ws("-", part, F.regexp_extract("path", r"(c\d+)\.", 1)))
        tier = F.floor(F.log(F.greatest(F.col("bytes") / self.small, F.lit(1.0))) / F.log(F.lit(float(self.fan_in))) + 1e-9).cast("int")
        return held.select("path", F.lit(generation).alias("generation"), F.concat_ws("/", F.lit(generation), name).alias("shard"), "rows", "bytes", tier.alias("tier"))

    def sizes(self) -> list[Column]:
        """What ``append`` needs to know of an arrival: rows, those that are large, and bytes of the others."""
        size = F.coalesce(F.octet_length(self.text), F.lit(0))
        small = F.sum(F.when(size <= self.small, size))
        return [F.count("*").alias("n"), F.coalesce(F.sum((size > self.small).cast("long")), F.lit(0)).alias("large"), F.coalesce(small, F.lit(0)).alias("b")]

    def append(self, docs: DataFrame, told: Row | None = None) -> int:
        """Write an arrival as small immutable shards and commit; returns the new version."""
        base = self.version()
        docs = docs.select(*self.schema.names)
        told = told or docs.agg(*self.sizes()).first()
        each = max(1, int(self.small * (told["n"] - told["large"]) / max(told["b"], 1)))
        generation = f"a{uuid.uuid4().hex}"
        is_large = F.coalesce(F.octet_length(self.text), F.lit(0)) > self.small
        for part, rows in ((docs.where(~is_large) if told["large"] else docs, each), *(((docs.where(is_large), 1),) if told["large"] else ())):
            part.write.mode("append").option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(f"{self.root}/data/{generation}")
        files = self._described(generation).persist()
        try:
            held = files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
            if held != told["n"]:
                raise RuntimeError(f"the arrival has {told['n']} rows, its shards {held}")
            return self._commit(self.manifest(base).unionByName(files), base)
        finally:
            files.unpersist()

    def plan(self, version: int | None = None) -> DataFrame:
        """(path, generation, rows, group): the files to merge, and which of them go together."""
        live = self.manifest(version).where(F.col("bytes") < self.target / 2)
        order = Window.partitionBy("tier", "stretch").orderBy("path")
        crowded = live.join(live.groupBy("tier").agg(F.count("*").alias("files")).where(F.col("files") >= self.fan_in), "tier")
        stretch = F.pmod(F.xxhash64("path"), F.ceil(F.col("files") / CHUNK))
        packed = crowded.withColumn("stretch", stretch).withColumn("upto", F.sum("bytes").over(order))
        packed = packed.withColumn("n", F.floor((F.col("upto") - F.col("bytes") / 2) / self.target))
        several = Window.partitionBy("tier", "stretch", "n")
        packed = packed.withColumn("_files", F.count("*").over(several)).where("_files > 1")
        # groups are numbered through: those of a stretch after those of the stretches before, which are few
        upto = Window.orderBy("tier", "stretch").rowsBetween(Window.unboundedPreceding, -1)
        first = packed.groupBy("tier", "stretch").agg((F.max("n") + 1).alias("groups")).select("tier", "stretch", F.coalesce(F.sum("groups").over(upto), F.lit(0)).alias("first"))
        return packed.join(F.broadcast(first), ["tier", "stretch"]).select("path", "generation", "rows", (F.col("first") + F.col("n")).cast("int").alias("group"))

    def compact(self) -> int:
        """Merge until no tier is crowded; returns the version."""
        while True:
            base = self.version()
            merged = self.plan(base).persist()
            try:
                told = merged.agg(F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.max("group").alias("last")).first()
                if not told["files"]:
                    return base
                generation = f"m{uuid.uuid4().hex}"
                wanted = small(merged.select(F.col("path").alias("_shard_path"), F.col("group").alias("_shard_group")), told["files"], 256)
                rows = self._read([r["path"] for r in merged.select("path").toLocalIterator()]).join(wanted, "_shard_path").drop("_shard_path")
                dealt = rows.repartitionById(told["last"] + 1, F.col("_shard_group"))
                dealt.write.option("compression", "zstd").partitionBy("_shard_group").parquet(f"{self.root}/data/{generation}")
                files = self._described(generation).persist()
                held = files.agg(F.sum("rows").alias("n")).first()["n"]
                if held != told["rows"]:
                    raise RuntimeError(f"the merged files have {told['rows']} rows, their successors {held}")
                self._commit(self.manifest(base).join(merged.select("path"), "path", "left_anti").unionByName(files), base)
                files.unpersist()
            finally:
                merged.unpersist()

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with _shard, _shard_rows, _shard_bytes and _shard_tier; fails if its files do not hold them all."""
        version = self.version() if version is None else version
        live = self.manifest(version)
        paths = [r["path"] for r in live.select("path").toLocalIterator()]
        told, read = live.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"], self._read(paths)
        if (held := read.count()) != told:
            raise RuntimeError(f"version {version} of {self.root} has {told} rows, its files {held}")
        named = live.select(F.col("path").alias("_shard_path"), F.col("shard").alias("_shard"), F.col("rows").alias("_shard_rows"), F.col("bytes").alias("_shard_bytes"), F.col("tier").alias("_shard_tier"))
        return read.join(small(named, len(paths), 256), "_shard_path").drop("_shard_path")

    def expire(self, keep: int = 1, leftover_s: float = 86_400) -> list[int]:
        """Drop all versions but the last ``keep``, and the generations that none of these names; returns the dropped versions.

        Generations and manifests that no version names are another writer's work, or what is left of it; they go when older than ``leftover_s``.
        """
        fs, there = self._fs(), self.versions()
        gone, kept = there[:-keep], there[-keep:]
        of = lambda versions: {r["generation"] for v in versions for r in self.manifest(v).select("generation").distinct().collect()}
        live, dead = {"data": of(kept), "manifest": {*map(self._manifest_of, kept)}}, {"data": of(gone), "manifest": {*map(self._manifest_of, gone)}}
        for v in gone:
            fs.delete(self._path("version", f"v{v:08d}"), False)
        for folder in ("data", "manifest"):
            for name in self._names(folder):
                age = time.time() - fs.getFileStatus(self._path(folder, name)).getModificationTime() / 1000
                if name not in live[folder] and (name in dead[folder] or age > leftover_s):
                    fs.delete(self._path(folder, name), True)
        return gone


def shard(docs: DataFrame, arrivals: int = ARRIVALS, root: str | None = None, **sizes) -> Store:
    """Bring documents into a store in so many arrivals, dealt by a hash of the id, compacting after each."""
    spark = docs.sparkSession
    store = Store(spark, root or scratch(spark), docs.schema, **sizes)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))
    told = {r["_batch"]: r for r in docs.groupBy(batch.alias("_batch")).agg(*store.sizes()).collect()}
    none = Row(n=0, large=0, b=0)
    for i in range(arrivals):
        store.append(docs.where(batch == i), told.get(i, none))
        store.compact()
    return store


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, shard, shard_rows, shard_bytes, tier, version of every document, read from the files of the last version."""
    store = shard(docs)
    version = store.version()
    held = store.snapshot(version)
    return held.select("doc_id", F.col("_shard").alias("shard"), F.col("_shard_rows").alias("shard_rows"), F.col("_shard_bytes").alias("shard_bytes"), F.col("_shard_tier").alias("tier"), F.lit(version).cast("long").alias("version"))
