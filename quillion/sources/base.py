"""What a source is: something that gives candidate records for questions.

``Source.search`` takes questions (qid, search_query) and returns records of
the common schema with their question and position. Sources here read
snapshots; one that calls a service would do so in its own reader and give the
same columns, with the policies of ``operators.control``.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class SourceError(RuntimeError):
    """A source can't answer; the message is safe to show."""

    def __init__(self, provider: str, message: str):
        super().__init__(f"{provider}: {message}")
        self.provider, self.message = provider, message


class Source(ABC):
    name: str

    @abstractmethod
    def search(self, questions: DataFrame) -> DataFrame:
        """Records (qid, pos, and the columns of ``record``) for the questions."""

    def failures(self, questions: DataFrame) -> DataFrame:
        """(qid, error) of the questions that this source can't answer; they have no records. Default: none."""
        return questions.select("qid", F.lit("").alias("error")).where("false")

    def answers(self, questions: DataFrame) -> DataFrame:
        """Records and failures as one table: error is null for records, and has the message in a failure's row.

        A source that finds both in one pass over its replies says so here.
        """
        found = self.search(questions).withColumn("error", F.lit(None).cast("string"))
        return found if type(self).failures is Source.failures else found.unionByName(self.failures(questions), allowMissingColumns=True)


def with_provenance(records: DataFrame) -> DataFrame:
    """source_ids default to the record's own, and id is source:source_id."""
    own = F.concat_ws(":", "source", "source_id")
    ids = F.when(F.coalesce(F.size("source_ids"), F.lit(0)) > 0, F.col("source_ids")).otherwise(F.array(own)) if "source_ids" in records.columns else F.array(own)
    return records.withColumns({"source_ids": ids, "id": own})


def with_positions(records: DataFrame, most: int | None = None) -> DataFrame:
    """provider_ranks: each record's position, from 1, in its source's own order for a question; limited per question.

    Rows with an ``error``, where there is such a column, have no position, take none from others and stay.
    """
    failed = F.col("error").isNotNull() if "error" in records.columns else F.lit(False)
    w = Window.partitionBy("qid", "source").orderBy(failed, "pos", "source_id")
    r = records.withColumn("_r", F.when(~failed, F.row_number().over(w)))
    r = r if most is None else r.where(failed | (F.col("_r") <= most))
    return r.withColumn("provider_ranks", F.when(~failed, F.create_map("source", F.col("_r").cast("int")))).withColumn("pos", F.col("_r")).drop("_r")


def united(parts: list[DataFrame]) -> DataFrame:
    """All sources' records in the sources' order: ord numbers them by question, source and position."""
    from quillion.schemas import PAPER

    cols = [f.name for f in PAPER if f.name not in ("ord", "rank_score")]
    frames = [p.select(*[F.col(c) for c in cols], F.lit(k).alias("_source_ord"), "pos") for k, p in enumerate(parts)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    w = Window.partitionBy("qid").orderBy("_source_ord", "pos", "source_id")
    out = out.withColumn("_local", F.row_number().over(w).cast("long"))
    # questions in their order, counted up: no two share a number
    n = out.groupBy("qid").agg(F.max("_local").alias("_n"))
    return numbered(out, n).withColumn("rank_score", F.lit(None).cast("double")).select(*[f.name for f in PAPER])


def numbered(records: DataFrame, sizes: DataFrame, buckets: int = 1024) -> DataFrame:
    """``records`` (qid, _local) with ord: unique, ascending with (bucket of the question, question, _local).

    ``sizes`` has a row for each question. Running sums go by bucket, then over
    the buckets' totals, so no task sees all questions.
    """
    b = F.pmod(F.xxhash64("qid"), F.lit(buckets))
    q = sizes.select("qid", "_n", b.alias("_b"))
    w = Window.partitionBy("_b").orderBy("qid").rowsBetween(Window.unboundedPreceding, -1)
    q = q.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    totals = q.groupBy("_b").agg(F.sum("_n").alias("_t"))
    # one row for each bucket
    first = F.broadcast(totals.withColumn("_first", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t"))
    q = q.join(first, "_b").select(F.col("qid").alias("_q"), (F.col("_first") + F.col("_before")).alias("_base"))
    return records.join(q, F.col("qid").eqNullSafe(F.col("_q"))).withColumn("ord", F.col("_base") + F.col("_local")).drop("_q", "_base", "_local")


def text_or_null(c: Column) -> Column:
    return F.when(c != "", c)
