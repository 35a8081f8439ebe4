"""Recorded exchanges with services, as a data source: ``spark.read.format("recorded_replies")``.

An exchange is a line of JSON: qid, provider, endpoint, attempt (from 0),
status (a code, ``timeout`` or ``network``), retry_after and body. The reader
cuts files into ranges of bytes, a partition each, and gives a row for each
line that begins in its range. The options qid, provider and endpoint (values
joined by commas) are its filters: other lines never leave the Python worker.
They are options as Spark 4.1 keeps one pushed filter for all scans of a loaded
frame: two scans of it with filters of their own would both read the rows of
one of them, so this reader takes none.

``replies`` makes of all attempts of a request its outcome by the policy of
``operators.control``: a reply, or a message that is safe to show.

Options beside those: path (a file or folder; any file system that pyarrow
reads) and range_bytes. Defined results: an empty folder has no rows; blank lines and
lines that aren't exchanges are skipped; names that begin with ``.`` or ``_``
aren't read.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillion.config import Settings
from quillion.operators import control
from quillion.session import ship
from quillion.sources.crossref import Crossref
from quillion.sources.pubmed import PubMed

FORMAT, RANGE_BYTES, BATCH_BYTES = "recorded_replies", 32 << 20, 4 << 20
SCHEMA = "qid string, provider string, endpoint string, attempt int, status string, retry_after string, body string"
KEYS = ("qid", "provider", "endpoint")
#: The requests of the two services.
SEARCH, FETCH, WORKS = "esearch", "efetch", "works"
ARROW = pa.schema([(n, pa.int32() if n == "attempt" else pa.string()) for n in ("qid", "provider", "endpoint", "attempt", "status", "retry_after", "body")])


@dataclass
class Range(InputPartition):
    """Bytes ``start`` to ``end`` of a file: the lines that begin there."""

    uri: str
    start: int
    end: int


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def lines(part: Range) -> Iterator[bytes]:
    """Lines that begin in the range; the last one may end beyond it."""
    fs, path = located(part.uri)
    with io.BufferedReader(fs.open_input_file(path), 1 << 20) as f:
        at = part.start
        f.seek(max(0, at - 1))
        if at:  # a line that begins before the range is its neighbour's
            at += len(f.readline()) - 1
        while at < part.end and (line := f.readline()):
            at += len(line)
            yield line


class RecordedReplies(DataSource):
    """Exchanges of a folder, whatever the service."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        wanted = {k: set(self.options[k].split(",")) for k in KEYS if k in self.options}
        return Reader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), wanted)


class Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, wanted: dict[str, set[str]] | None = None):
        self.path, self.range_bytes, self.wanted = path, range_bytes, wanted or {}

    def partitions(self) -> Sequence[Range]:
        fs, path = located(self.path)
        info = fs.get_file_info(path)
        files = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        head = self.path[: -len(path)] if self.path.endswith(path) else ""
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")):
                out += [Range(head + f.path, at, min(at + self.range_bytes, f.size)) for at in range(0, f.size, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for line in lines(partition) if partition.uri else ():
            try:
                x = json.loads(line)
            except ValueError:
                continue
            if not isinstance(x, dict) or any(x.get(k) not in v for k, v in self.wanted.items()):
                continue
            text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
            rows.append({n: (x.get(n) if isinstance(x.get(n), int) else 0) if n == "attempt" else text(x.get(n)) for n in ARROW.names})
            held += len(line)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, **wanted: str) -> DataFrame:
    """Exchanges under ``path``: all, or those whose keys (qid, provider, endpoint) are wanted."""
    ship(spark)
    spark.dataSource.register(RecordedReplies)
    return spark.read.format(FORMAT).options(path=path, range_bytes=str(range_bytes), **wanted).load()


def replies(exchanges: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(qid, payload, error) of the requests of one endpoint: the reply that a question's attempts end with, or why there is none.

    Attempts are followed in order while the policy says retry; an exchange
    that wasn't recorded after a retry counts as a network error.
    """
    backoff = F.lit(float((settings or Settings()).retry_backoff))
    d = control.decide(exchanges.select("qid", "attempt", F.col("status").alias("outcome"), "retry_after", backoff.alias("backoff"), "body"))
    # the first attempt that isn't retried: at most MOST_ATTEMPTS are looked at
    last = F.min_by(F.struct("action", "message", "body"), F.when(F.col("action") != "retry", F.col("attempt")))
    x = d.where(F.col("attempt") < control.MOST_ATTEMPTS).groupBy("qid").agg(last.alias("x"))
    error: Column = F.when(F.col("x").isNull(), control.NETWORK).when(F.col("x.action") == "fail", F.col("x.message"))
    return x.select("qid", F.when(error.isNull(), F.col("x.body")).alias("payload"), error.alias("error"))


class RecordedPubMed(PubMed):
    """The biomedical index from recorded exchanges; a request that failed is its question's error."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None):
        settings = settings or Settings()
        self.found, self.got = (replies(read(spark, path, provider="pubmed", endpoint=e), settings) for e in (SEARCH, FETCH))
        good = lambda r: r.where("error is null").drop("error")
        super().__init__(good(self.found), good(self.got), settings.pubmed_limit)

    def answers(self, questions: DataFrame) -> DataFrame:
        lost = self.found.unionByName(self.got).where("error is not null").select("qid", "error").join(questions.select("qid"), "qid", "left_semi")
        return super().answers(questions).unionByName(lost, allowMissingColumns=True)


class RecordedCrossref(Crossref):
    """The works service from recorded exchanges."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None):
        settings = settings or Settings()
        self.all = replies(read(spark, path, provider="crossref", endpoint=WORKS), settings)
        super().__init__(self.all.where("error is null").drop("error"), settings.crossref_limit)

    def failures(self, questions: DataFrame) -> DataFrame:
        lost = self.all.where("error is not null").select("qid", "error").join(questions.select("qid"), "qid", "left_semi")
        return super().failures(questions).unionByName(lost)
