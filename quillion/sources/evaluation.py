"""Data of an evaluation, in JSON: questions, recorded pools, judgments and gold evidence.

A path names one file, or a folder of them, of which each holds a part. With
``lines`` each line of a file is a part, so that a file may be read by many
tasks. What isn't of the form stated raises: an evaluation on half its data
would say nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.schemas import LONG, PAPER, STR, struct
from quillion.sources.base import Source

RECORD = T.StructType([f for f in PAPER if f.name not in ("ord", "qid", "rank_score")])
QUESTION = struct(id=STR, question=STR)
POOL = struct(questions=T.MapType(STR, struct(question=STR, query=STR, providers=T.MapType(STR, T.ArrayType(RECORD)))))
JUDGED = struct(questions=T.MapType(STR, struct(relevant=T.ArrayType(struct(id=STR, title=STR)))))
_KEYWORDS = T.ArrayType(STR)
GOLD = struct(
    id=STR, study_design=STR, participants=LONG, studies=LONG, population=_KEYWORDS, intervention=_KEYWORDS, comparator=_KEYWORDS, outcomes=_KEYWORDS,
    statistics=_KEYWORDS, limitations_stated=T.BooleanType(), notes=STR,
)


def _read(spark: SparkSession, path: str, schema: T.StructType, lines: bool) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=not lines, mode="FAILFAST")


def questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(qid, question) of a list of objects with id and question."""
    return _read(spark, path, QUESTION, lines).select(F.col("id").alias("qid"), "question")


def judgments(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(qid, paper_id, title) of the papers judged relevant, from an object ``questions`` by id; each once for a question."""
    by_question = _read(spark, path, JUDGED, lines).select(F.explode("questions").alias("qid", "q"))
    return by_question.select("qid", F.explode("q.relevant").alias("r")).select("qid", F.col("r.id").alias("paper_id"), F.col("r.title").alias("title")).dropDuplicates(["qid", "paper_id"])


def gold(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Gold evidence by paper_id, from a list ``papers``: what ``evaluate.field_outcomes`` and ``statistics_recall`` take."""
    return _read(spark, path, struct(papers=T.ArrayType(GOLD)), lines).select(F.explode("papers").alias("p")).select(F.col("p.id").alias("paper_id"), *[f"p.{f.name}" for f in GOLD if f.name != "id"])


class Pool(Source):
    """One source's records in a recorded pool: an object ``questions`` by id, each with its records by source, in their order."""

    def __init__(self, spark: SparkSession, path: str, name: str, lines: bool = False):
        self.spark, self.path, self.name, self.lines = spark, path, name, lines

    def questions(self) -> DataFrame:
        """(qid, question) that the pool was recorded for."""
        return _read(self.spark, self.path, POOL, self.lines).select(F.explode("questions").alias("qid", "q")).select("qid", "q.question")

    def search(self, questions: DataFrame) -> DataFrame:
        q = _read(self.spark, self.path, POOL, self.lines).select(F.explode("questions").alias("qid", "q")).join(questions.select("qid").distinct(), "qid", "left_semi")
        return q.select("qid", F.posexplode(F.try_element_at("q.providers", F.lit(self.name))).alias("at", "r")).select("qid", (F.col("at") + 1).alias("pos"), "r.*")
