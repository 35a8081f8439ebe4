"""Snapshots of sources' answers, and the sinks of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.schemas import PAPER
from quillion.sources.base import Source, SourceError


#: Folders of a snapshot, and files of each: as many whatever the questions.
BUCKETS, FILES = 32, 4


def bucket(qid: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(qid), F.lit(buckets)).cast("int")


def write(papers: DataFrame, path: str, format: str = "parquet", buckets: int = BUCKETS) -> None:
    """Papers (qid, source, ...) in folders by the hash of their question, sorted by question and source.

    Parquet files have bloom filters on qid, so that a question's read skips
    what its bucket holds of others. A question of any size is spread over its
    bucket's files.
    """
    p = papers.withColumn("bucket", bucket("qid", buckets))
    p = p.repartition(buckets * FILES, "bucket", F.pmod(F.xxhash64("ord"), F.lit(FILES))).sortWithinPartitions("bucket", "qid", "source", "ord")
    p.write.mode("overwrite").partitionBy("bucket").option("parquet.bloom.filter.enabled#qid", "true").format(format).save(path)


def load(spark: SparkSession, path: str, format: str = "parquet", qids: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Papers of a snapshot: all, or those of a few questions, whose buckets alone are listed and read."""
    schema = spark.createDataFrame([], PAPER).schema.add("bucket", T.IntegerType())
    p = spark.read.schema(schema).format(format).load(path)
    if qids is not None:
        p = p.where(F.col("qid").isin(qids) & F.col("bucket").isin([r[0] for r in spark.createDataFrame([(q,) for q in qids], "qid string").select(bucket("qid", buckets)).distinct().collect()]))
    return p.select(*[f.name for f in PAPER])


def last_wins(papers: DataFrame, order: tuple[str, ...] = ("qid", "ord")) -> DataFrame:
    """One row for each id: that of the last question that holds it, in the order of the columns ``order``."""
    cols = [c for c in papers.columns if c != "id"]
    return papers.groupBy("id").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select("id", "r.*")


class Snapshot(Source):
    """One source's records in a snapshot."""

    def __init__(self, spark: SparkSession, path: str, name: str, format: str = "parquet", buckets: int = BUCKETS):
        self.spark, self.path, self.name, self.format, self.buckets = spark, path, name, format, buckets

    def search(self, questions: DataFrame) -> DataFrame:
        """The questions' records; joined by bucket as well, so that the folders of no question are pruned when the join runs."""
        schema = self.spark.createDataFrame([], PAPER).schema.add("bucket", T.IntegerType())
        p = self.spark.read.schema(schema).format(self.format).load(self.path).where(F.col("source") == self.name)
        q = questions.select("qid", bucket("qid", self.buckets).alias("bucket")).distinct()
        return p.join(q, ["bucket", "qid"], "left_semi").select(*[f.name for f in PAPER]).withColumn("pos", F.col("ord"))


def envelopes(questions: DataFrame, papers: DataFrame, evidence: DataFrame, statuses: DataFrame, codes: DataFrame) -> DataFrame:
    """One JSON reply for each question: (qid, code, body).

    A question's papers are gathered in rank order; each source's limit bounds
    them. Questions without terms are 422.
    """
    fields = [c for c in papers.columns if c not in ("qid", "rank", "ord")]
    p = papers.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("p"))), lambda x, y: x["rank"] - y["rank"]), lambda x: x["p"]).alias("papers"))
    e = evidence.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct(F.col("paper_id"), F.struct(*[c for c in evidence.columns if c != "qid"])))).alias("evidence"))
    s = statuses.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("provider", F.struct("status", "paper_count", "error")))).alias("provider_status"))
    q = questions.join(p, "qid", "left").join(e, "qid", "left").join(s, "qid", "left").join(codes, "qid", "left")
    body = F.struct("question", F.array("search_query").alias("queries_used"), F.coalesce("papers", F.array().cast(p.schema["papers"].dataType)).alias("papers"), "provider_status", "evidence")
    return q.select("qid", F.when(~F.col("valid"), 422).otherwise(F.coalesce("code", F.lit(200))).alias("code"), F.to_json(F.when(F.col("valid"), body), {"ignoreNullFields": "false"}).alias("body"))


__all__ = ["Snapshot", "SourceError", "envelopes", "last_wins", "load", "write"]
