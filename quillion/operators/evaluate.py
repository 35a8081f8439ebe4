"""The evaluation algebra: retrieval metrics, outcomes by field, recall of statistics, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.operators.order import values_at

#: Cut-offs, outcomes and compared fields.
CUTS = (5, 10, 20)
OUTCOMES = ("correct", "correct-null", "missed", "wrong", "fabricated")
TEXT_FIELDS = ("population", "intervention", "comparator", "outcomes")


def squashed(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def relevant_positions(rankings: DataFrame, judgments: DataFrame) -> DataFrame:
    """Rows of rankings (qid, system, rank, source_ids) that hold any id judged relevant for their question."""
    ids = rankings.select("qid", "system", "rank", F.explode(F.array_distinct("source_ids")).alias("paper_id"))
    return ids.join(judgments.select("qid", "paper_id").distinct(), ["qid", "paper_id"], "left_semi").select("qid", "system", "rank").distinct()


def unretrieved(rankings: DataFrame, judgments: DataFrame) -> DataFrame:
    """Judged ids that no ranking of their question holds; an evaluation wants none."""
    ids = rankings.select("qid", F.explode("source_ids").alias("paper_id")).distinct()
    return judgments.join(ids, ["qid", "paper_id"], "left_anti")


def retrieval_metrics(rankings: DataFrame, judgments: DataFrame) -> DataFrame:
    """(qid, system, recall_5, recall_10, recall_20, mrr) of each ranking against the judged ids."""
    n = judgments.select("qid", "paper_id").distinct().groupBy("qid").agg(F.count("*").alias("n_relevant"))
    systems = rankings.select("qid", "system").distinct().join(n, "qid")
    hits = relevant_positions(rankings, judgments)
    found = hits.groupBy("qid", "system").agg(*[F.count_if(F.col("rank") <= k).alias(f"_h{k}") for k in CUTS], F.min("rank").alias("_first"))
    m = systems.join(found, ["qid", "system"], "left")
    return m.select("qid", "system", *[(F.coalesce(F.col(f"_h{k}"), F.lit(0)) / F.col("n_relevant")).alias(f"recall_{k}") for k in CUTS], F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"))


def macro_means(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("system").agg(*[F.avg(c).alias(c) for c in (*[f"recall_{k}" for k in CUTS], "mrr")])


def judged(expected: Column, got: Column, right: Column) -> Column:
    """One of five outcomes for a field."""
    return F.when(expected.isNull() & got.isNull(), "correct-null").when(expected.isNull(), "fabricated").when(got.isNull(), "missed").when(right, "correct").otherwise("wrong")


def has_keywords(keywords: Column, got: Column) -> Column:
    return F.forall(keywords, lambda k: F.contains(F.lower(got), F.lower(k)))


def flattened(name: str) -> Column:
    """A text field as one string; null where it is unavailable."""
    value = F.array_join(f"{name}.values", " | ") if name == "outcomes" else F.col(f"{name}.value")
    return F.when(F.col(f"{name}.status") != "unavailable", value)


def field_outcomes(gold: DataFrame, evidence: DataFrame) -> DataFrame:
    """(paper_id, field, outcome) of the eight compared fields.

    ``gold`` has paper_id, study_design, participants, studies, limitations_stated
    and arrays of keywords for the text fields, all of which must occur.
    """
    g = gold.select("paper_id", *[F.col(c).alias(f"g_{c}") for c in ("study_design", "participants", "studies", "limitations_stated", *TEXT_FIELDS)])
    j = evidence.join(g, "paper_id")
    said = F.col("limitations.status") != "unavailable"
    limits = F.when(said != F.col("g_limitations_stated"), F.when(said, "fabricated").otherwise("missed")).when(said, "correct").otherwise("correct-null")
    got = {"study_design": F.col("study_design.value"), "participants": F.col("sample_size.participants"), "studies": F.col("sample_size.studies")}
    cols = {f: judged(F.col(f"g_{f}"), v, F.col(f"g_{f}") == v) for f, v in got.items()}
    cols |= {f: judged(F.col(f"g_{f}"), flattened(f), has_keywords(F.col(f"g_{f}"), flattened(f))) for f in TEXT_FIELDS}
    cols["limitations_stated"] = limits
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("outcome")) for f, v in cols.items()])
    return j.select("paper_id", F.explode(pairs).alias("x")).select("paper_id", "x.*")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Per field: the count of each outcome, and accuracy."""
    p = outcomes.groupBy("field").pivot("outcome", list(OUTCOMES)).count().na.fill(0)
    total = sum((F.col(f"`{o}`") for o in OUTCOMES[1:]), F.col("correct"))
    return p.withColumn("accuracy", (F.col("correct") + F.col("`correct-null`")) / total)


def ungrounded(gold: DataFrame, papers: DataFrame) -> DataFrame:
    """Gold rows whose paper isn't there; an evaluation wants none."""
    return gold.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_anti")


def in_both(one: DataFrame, two: DataFrame) -> DataFrame:
    """Papers of both gold sets; what was tuned on one set is tested on the other only if there are none."""
    return one.select("paper_id").distinct().join(two.select("paper_id").distinct(), "paper_id", "left_semi")


def statistics_recall(gold: DataFrame, evidence: DataFrame) -> DataFrame:
    """(found, expected) statistics, compared without white space and case."""
    want = gold.select("paper_id", F.explode("statistics").alias("s")).select("paper_id", squashed(F.col("s")).alias("s"))
    have = evidence.select("paper_id", F.explode(F.flatten(F.transform("findings.items", lambda i: i["statistics"]))).alias("s")).select("paper_id", squashed(F.col("s")).alias("s"), F.lit(1).alias("hit")).distinct()
    return want.join(have, ["paper_id", "s"], "left").agg(F.count("hit").alias("found"), F.count("*").alias("expected"))


def field_availability(evidence: DataFrame) -> DataFrame:
    """Per field: papers with an abstract by status."""
    from quillion.schemas import FIELDS, STATUSES

    e = evidence.where(F.col("abstract_status") == "present")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.status").alias("status")) for f in FIELDS])
    return e.select(F.explode(pairs).alias("x")).select("x.*").groupBy("field").pivot("status", list(STATUSES)).count().na.fill(0)


def latency(samples: DataFrame, by: list[str], item: str, ms: str) -> DataFrame:
    """Per group: mean, median, p95 and max of each item's best time.

    p95 is the value at position floor(0.95 (n - 1)), not interpolated: the
    smallest value that floor(0.95 (n - 1)) + 1 values don't exceed.
    """
    best = samples.groupBy(*by, item).agg(F.min(ms).cast("double").alias("_ms"))
    n = F.col("n")
    places = {"p95": F.floor(F.lit(0.95) * (n - 1)), "low": F.floor((n - 1) / 2), "high": F.floor(n / 2)}
    p = values_at(best, by, "_ms", places)
    return best.groupBy(*by).agg(F.avg("_ms").alias("mean"), F.max("_ms").alias("max")).join(p, by).select(*by, "mean", ((F.col("low") + F.col("high")) / 2).alias("median"), "p95", "max")


def retrieval_report(metrics: DataFrame) -> str:
    """Both systems of each question, and their means, as text: a report's few rows are collected."""
    cols = [*[f"recall_{k}" for k in CUTS], "mrr"]
    each, mean = metrics.orderBy("qid", "system").collect(), macro_means(metrics).orderBy("system").collect()
    return "\n\n".join(["# Retrieval", markdown(each, ["qid", "system", *cols]), "## Means", markdown(mean, ["system", *cols])]) + "\n"


def evidence_report(outcomes: DataFrame, availability: DataFrame, untraceable: DataFrame) -> str:
    """Outcomes and accuracy by field, statuses by field, and how many citations or values can't be traced."""
    counts, statuses = outcome_counts(outcomes).orderBy("field"), availability.orderBy("field")
    parts = ["# Evidence", markdown(counts.collect(), counts.columns), "## Availability", markdown(statuses.collect(), statuses.columns), f"Not traceable: {untraceable.count()}"]
    return "\n\n".join(parts) + "\n"


def write_report(spark, report: str, path: str) -> None:
    """The report as one text file in the folder ``path``, on any file system."""
    spark.createDataFrame([(report.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown(rows: list, columns: list[str], digits: int = 2) -> str:
    """A small collected result as a table for a report."""
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows)])
