"""Sharding by size-tiered compaction, in DataFrame functions only.

A store is a folder of immutable runs and of manifests. Arrivals are appended
as runs of small files. Runs whose sizes lie within one power of ``fan_in``
form a tier; a tier with ``fan_in`` runs is merged into one run of files of
about the target size, and so on upwards; a run of the target size or more is
sealed and never rewritten once its files are whole, that is, if a merge made it
or at most one of its files has less than half the target. A larger arrival of
smaller files is rewritten by itself first. So a row is written once for each
tier it passes, about log(target / arrival) / log(fan_in) times, and once if it
arrives in a large run of small files.

A version is a manifest: a table of the live runs. Sealed runs, which stay for
good, move to segments, immutable tables of many runs each, of which a manifest
has one row: what a commit rewrites are the runs that aren't in a segment yet
and a row a segment, not a row for each run of the store. A manifest is written
beside the others under a temporary name and renamed to its number; the rename fails if
that number exists (by FileContext, on HDFS and local file systems; a store that
can't rename atomically needs another commit), so of two writers one wins and
the other starts again from the newer version. Readers see the runs of one version and nothing else: files
of failed or unfinished writes are in no manifest, and ``sweep`` deletes them.
Superseded runs are deleted
only once no kept version names them: a lazy frame of a version can be read as
long as that version is one of the last ``keep``.

Merging reads runs and coalesces their partitions: no shuffle, and each task
writes one file of about the target size. What planning a merge handles on the
driver are the runs of one tier. Reading hands Spark the path of each live run,
as Spark's own listing of their files does; the target bounds how many there are.

Defined results: an empty arrival adds no run; an empty store reads as an
empty table of its schema; null texts, repeated rows and extra columns are
rows and columns like others. Arrivals of one store have one schema.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm.common import columns, free
from quillion.session import read, shared_path

FAN_IN, TARGET_BYTES, KEEP_VERSIONS = 4, 64 << 20, 1
#: Sealed runs that make a segment; names that are looked up at a time.
SEGMENT_RUNS, NAMES = 1024, 10_000
#: Sizes below this are one tier.
LEAST_BYTES = 64 << 10

MANIFEST = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("path", T.StringType()), T.StructField("tier", T.IntegerType()),
    T.StructField("bytes", T.LongType()), T.StructField("files", T.LongType()), T.StructField("sealed", T.BooleanType()),
    # a row of a segment: its path is that of a table of such rows
    T.StructField("segment", T.BooleanType()),
])


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Store:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target: int = TARGET_BYTES, fan_in: int = FAN_IN, keep: int = KEEP_VERSIONS, segment: int = SEGMENT_RUNS):
        self.spark, self.root, self.schema, self.target, self.fan_in, self.keep, self.segment = spark, root.rstrip("/"), schema, target, fan_in, keep, segment
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self.conf)
        self.fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    # manifests

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/manifests")))
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def entries(self, version: int | None = None) -> DataFrame:
        """The manifest of a version (default: the latest): its runs outside of segments, and a row a segment."""
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/v{have[-1] if version is None else version:08d}")

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(*paths) if paths else self.spark.createDataFrame([], MANIFEST)

    def runs(self, version: int | None = None) -> DataFrame:
        """The live runs of a version (default: the latest)."""
        entries = self.entries(version)
        segments = [r["path"] for r in entries.where("segment").select("path").collect()]
        return entries.where("not segment").unionByName(self._rows(segments))

    def roll(self) -> int:
        """Move sealed runs to a segment, if there are enough of them; returns the latest version."""
        while True:
            version = (self.versions() or [0])[-1]
            entries = self.entries()
            own = entries.where("sealed and not segment")
            n = own.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("files").alias("files")).collect()[0]
            if n["n"] < self.segment:
                return version
            name = f"s-{uuid.uuid4().hex}"
            path = f"{self.root}/segments/{name}"
            own.coalesce(1).write.parquet(path)
            made = self.spark.createDataFrame([(name, path, -1, n["bytes"], n["files"], True, True)], MANIFEST)
            try:
                self.commit(entries.where("segment or not sealed").unionByName(made), version + 1)
                return version + 1
            except Conflict:
                self.fs.delete(self._path(path), True)

    def commit(self, runs: DataFrame, version: int) -> None:
        """Make ``runs`` (rows of a manifest) the given version, whole or not at all."""
        part, final = f"{self.root}/manifests/_part-{uuid.uuid4().hex}", f"{self.root}/manifests/v{version:08d}"
        runs.coalesce(1).write.parquet(part)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(final).toUri(), self.conf).rename(self._path(part), self._path(final), options)
        except Exception as e:
            self.fs.delete(self._path(part), True)
            if "FileAlreadyExists" in str(e) or self.fs.exists(self._path(final)):
                raise Conflict(final) from e
            raise
        self.vacuum()

    def vacuum(self) -> None:
        """Delete old manifests, and the runs that only they name."""
        old = self.versions()[: -self.keep]
        if not old:
            return
        kept = self._rows([f"{self.root}/manifests/v{v:08d}" for v in self.versions()[-self.keep :]]).select("run")
        for v in old:
            gone = self.entries(v).where("not sealed").join(kept, "run", "left_anti").select("path")
            for row in gone.toLocalIterator():
                self.fs.delete(self._path(row["path"]), True)
            self.fs.delete(self._path(f"{self.root}/manifests/v{v:08d}"), True)

    def sweep(self, seconds: float) -> int:
        """Delete runs and segments that no kept version names and nothing has changed for ``seconds``: what failed writers left. Returns how many.

        Writers that take longer than that between writing and committing would lose their run.
        The folders' names are looked up some at a time: the driver holds no list of the store's runs.
        """
        versions = self.versions()
        entries = self._rows([f"{self.root}/manifests/v{v:08d}" for v in versions])
        segments = entries.where("segment").select("path", "run").distinct().collect()
        inside = self._rows([r["path"] for r in segments])
        named = entries.where("not segment").unionByName(inside).select(F.element_at(F.split("path", "/"), -1).alias("name"))
        live = {r["run"] for r in segments}
        return self._swept("runs", seconds, lambda names: self._unnamed(names, named)) + self._swept("segments", seconds, lambda names: [n for n in names if n not in live])

    def _unnamed(self, names: list[str], named: DataFrame) -> list[str]:
        old = self.spark.createDataFrame([(n,) for n in names], "name string")
        return [r["name"] for r in old.join(named, "name", "left_anti").collect()]

    def _swept(self, folder: str, seconds: float, unnamed) -> int:
        top, now, n = self._path(f"{self.root}/{folder}"), self.jvm.java.lang.System.currentTimeMillis(), 0
        if not self.fs.exists(top):
            return 0
        listed = self.fs.listStatusIterator(top)
        while listed.hasNext():
            names: list[str] = []
            while listed.hasNext() and len(names) < NAMES:
                found = listed.next()
                if now - found.getModificationTime() >= 1000 * seconds:
                    names.append(found.getPath().getName())
            for name in unnamed(names) if names else []:
                self.fs.delete(self._path(f"{self.root}/{folder}/{name}"), True)
                n += 1
        return n

    # runs

    def tier(self, size: int) -> int:
        t, edge = 0, LEAST_BYTES
        while size >= edge:
            t, edge = t + 1, edge * self.fan_in
        return t

    def describe(self, path: str, merged: bool = False) -> tuple | None:
        """Manifest row of the run at ``path``; None if it has no rows, and then it is deleted.

        A run of the target size is sealed if a merge made it or if its own files are whole.
        """
        files = [s for s in self.fs.listStatus(self._path(path)) if s.getPath().getName().startswith("part-")]
        if not files:
            return None
        sizes = [s.getLen() for s in files]
        if sum(sizes) < LEAST_BYTES and self.spark.read.schema(self.schema).parquet(path).isEmpty():
            self.fs.delete(self._path(path), True)
            return None
        size, small = sum(sizes), sum(2 * n < self.target for n in sizes)
        return (path.rsplit("/", 1)[-1], path, self.tier(size), size, len(files), size >= self.target and (merged or small <= 1), False)

    def append(self, arrivals: DataFrame, by: str | None = None) -> int:
        """Append rows as one run, or as one run for each value of the column ``by``; returns the version.

        Rows are written where they lie, without a shuffle: small files that compaction merges.
        """
        name = f"{self.root}/runs/a-{uuid.uuid4().hex}"
        cols = [f.name for f in self.schema]
        if by is None:
            columns(arrivals, cols).write.parquet(name)
            made = [name]
        else:
            arrival = free("_arrival", cols)
            columns(arrivals, [*cols, by]).withColumnRenamed(by, arrival).write.partitionBy(arrival).parquet(name)
            made = [s.getPath().toString() for s in self.fs.listStatus(self._path(name)) if s.isDirectory()]
            made = [self._moved(p, f"{name}-{k:04d}") for k, p in enumerate(sorted(made))]
        rows = [r for p in made if (r := self.describe(p)) is not None]
        if not rows:
            return (self.versions() or [0])[-1]
        while True:
            version = (self.versions() or [0])[-1]
            try:
                new = self.spark.createDataFrame(rows, MANIFEST)
                self.commit(self.entries().unionByName(new) if version else new, version + 1)
                return version + 1
            except Conflict:
                continue

    def _moved(self, old: str, new: str) -> str:
        self.fs.rename(self._path(old), self._path(new))
        return new

    def plan(self) -> tuple[int, list[tuple[str, str, int]]] | None:
        """What to merge next: a tier and its runs (run, path, bytes).

        An unsealed run of the target size or more by itself, or else the lowest tier with ``fan_in`` runs that aren't sealed.
        """
        unsealed = self.entries().where("not sealed")
        large = unsealed.where(F.col("bytes") >= self.target).orderBy("run").limit(1).collect()
        if large:
            return large[0]["tier"], [(large[0]["run"], large[0]["path"], large[0]["bytes"])]
        full = unsealed.groupBy("tier").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("run", "path", "bytes"))).alias("runs")).where(F.col("n") >= self.fan_in).orderBy("tier").limit(1).collect()
        return (full[0]["tier"], [tuple(r) for r in full[0]["runs"]]) if full else None

    def _packed(self) -> SparkSession:
        """A session of its own whose readers pack small files into parts of at most the target size."""
        s = self.spark.newSession()
        s.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        s.conf.set("spark.sql.files.openCostInBytes", "0")
        s.conf.set("spark.sql.files.minPartitionNum", "1")
        return s

    def compact(self) -> int:
        """Merge tiers until none is full, then move sealed runs to segments; returns the latest version."""
        while (todo := self.plan()) is not None:
            version, (tier, runs) = self.versions()[-1], todo
            path = f"{self.root}/runs/m-{tier}-{uuid.uuid4().hex}"
            # packed one after the other, two neighbours have more than the target: so many parts at most
            files = max(1, 2 * -(-sum(b for _, _, b in runs) // self.target) - 1)
            self._packed().read.schema(self.schema).parquet(*[p for _, p, _ in runs]).coalesce(files).write.parquet(path)
            row = self.describe(path, merged=True)
            made = self.spark.createDataFrame([] if row is None else [row], MANIFEST)
            merged = self.spark.createDataFrame([(r,) for r, _, _ in runs], "run string")
            try:
                self.commit(self.entries(version).join(F.broadcast(merged), "run", "left_anti").select(*[f.name for f in MANIFEST]).unionByName(made), version + 1)
            except Conflict:
                self.fs.delete(self._path(path), True)
        return self.roll()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, from the runs that its manifest names."""
        paths = [r["path"] for r in self.runs(version).select("path").toLocalIterator()]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, through a store: twelve small and two larger arrivals, compacted and read back."""
    docs = read(spark, sf_dir, "documents")
    store = Store(spark, shared_path(spark, "shards"), docs.schema)
    h = F.pmod(F.xxhash64("doc_id"), F.lit(24))
    by = free("_by", docs.columns)
    store.append(docs.withColumn(by, F.when(h < 12, h).when(h < 18, 12).otherwise(13)), by)
    store.compact()
    rows = store.read()
    text = F.coalesce("text", F.lit("")).cast("binary")
    return rows.select("doc_id", "lang", "source", F.octet_length(text).cast("long").alias("text_bytes"), F.sha2(text, 256).alias("text_sha256"))


OP10_SQL = """
SELECT doc_id, lang, source, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS text_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""
