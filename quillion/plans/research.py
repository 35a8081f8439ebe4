"""From questions to ranked papers with evidence: the engine's main plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.config import Settings
from quillion.operators import control, dedup, evidence, invariants, query, ranking
from quillion.plans import fanout
from quillion.schemas import PAPER
from quillion.session import cut, delete, ship
from quillion.sources.base import Source, SourceError, united

OUTCOME = "qid string, provider string, failure string, seconds double, budget double, paper_count long"


@dataclass(frozen=True)
class Results:
    questions: DataFrame
    papers: DataFrame
    provider_status: DataFrame
    codes: DataFrame
    #: qid, raw_count, unique_count, removed
    counts: DataFrame
    #: folders that these frames read
    paths: tuple[str, ...] = ()
    extracted: Callable[[], DataFrame | None] = lambda: None

    @cached_property
    def evidence(self) -> DataFrame | None:
        """Evidence of the papers, planned when it is first asked for."""
        return self.extracted()

    def release(self) -> None:
        """Delete what the frames read; they can't be used afterwards."""
        for p in self.paths:
            delete(self.questions.sparkSession, p)


def asked(source: Source, questions: DataFrame, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, failures by question) of one source: what it answers is written here, so whatever fails does so here.

    A question that the source rejects is in error by itself and has no records.
    """
    found, _ = cut(source.answers(questions), f"source-{source.name}", paths)
    bad = found.where("error is not null").groupBy("qid").agg(F.min("error").alias("failure"))
    good = found.where("error is null").drop("error")
    return (good if type(source).answers is Source.answers and type(source).failures is Source.failures else good.join(bad, "qid", "left_anti")), bad


def failure(o: fanout.Outcome) -> str | None:
    """What may be shown of a source's error: its own message, or none of its details."""
    return None if o.error is None else o.error.message if isinstance(o.error, SourceError) else control.UNEXPECTED


def outcome(o: fanout.Outcome, questions: DataFrame, budget: float | None) -> DataFrame:
    """A row for each question: a source that failed or was stopped is in error for all of them."""
    rows = questions.select("qid", F.lit(o.name).alias("provider"), F.lit(failure(o)).cast("string").alias("failure"), F.lit(float(o.seconds)).alias("seconds"), F.lit(budget).cast("double").alias("budget"))
    if o.value is None:
        return rows.withColumn("paper_count", F.lit(0).cast("long"))
    records, bad = o.value
    counts = records.groupBy("qid").agg(F.count("*").alias("paper_count"))
    rows = rows.drop("failure").join(bad, "qid", "left").join(counts, "qid", "left")
    return rows.select("qid", "provider", "failure", "seconds", "budget", F.coalesce("paper_count", F.lit(0)).alias("paper_count"))


def research(questions: DataFrame, sources: list[Source], with_evidence: bool = True, settings: Settings | None = None, extractor: Callable[[DataFrame, list[str]], DataFrame] = evidence.extract) -> Results:
    """Answers for all ``questions`` (qid, question) at once.

    Sources answer at the same time, with ``settings`` each within their
    ``provider_timeout`` for each started thousand questions: a source over its
    budget is stopped. One that fails or is stopped leaves the others' records
    alone. Records are united in the order of the sources, merged by identity,
    ranked, and their evidence extracted after merging, when there are fewest.
    Without sources there are no papers. Another ``extractor`` may take the place
    of the rules; what it says of papers that it wasn't asked about is left out.
    """
    spark = questions.sparkSession
    ship(spark)
    q = query.process(questions)
    valid, path = cut(q.where("valid"), "questions")
    paths = [path]
    budget = settings.provider_timeout * -(-max(1, valid.count()) // 1000) if settings else None
    made: list[list[str]] = [[] for _ in sources]
    work = [(s.name, lambda s=s, m=m: asked(s, valid, m), budget) for s, m in zip(sources, made, strict=True)]
    answers, parts, statuses = fanout.at_once(spark, work), [], spark.createDataFrame([], OUTCOME)
    for o, m in zip(answers, made, strict=True):
        over = o.stopped or (budget is not None and o.seconds > budget)
        if o.value is None or over:
            for p in m:  # what a source that failed has left
                delete(spark, p)
            o.value = None
        else:
            paths += m
            parts.append(o.value[0])
        statuses = statuses.unionByName(outcome(o, valid, budget))
    status = control.provider_status(statuses)
    raw = united(parts) if parts else spark.createDataFrame([], PAPER)
    papers = ranking.ranked(ranking.scored(dedup.deduplicate(raw), valid))
    papers, path = cut(papers, "papers")
    paths.append(path)

    def extracted() -> DataFrame | None:
        found = extractor(papers, ["qid"]) if with_evidence else None
        return found if found is None or extractor is evidence.extract else invariants.filed(found, papers)

    n = lambda df, c: df.groupBy("qid").agg(F.count("*").alias(c))
    counts = valid.select("qid").join(n(raw, "raw_count"), "qid", "left").join(n(papers, "unique_count"), "qid", "left")
    counts = counts.select("qid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw_count", "unique_count")]).withColumn("removed", F.col("raw_count") - F.col("unique_count"))
    return Results(q, papers, status, control.response_code(status), counts, tuple(paths), extracted)
