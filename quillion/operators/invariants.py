"""Constraints on evidence, as predicates; and the audit of citations against their sources."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.operators import rules
from quillion.schemas import ABSTRACT_STATUSES, DESIGNS, FIELDS, FINDING_KINDS, STATUSES


def spans(name: str) -> Column:
    """The citations of a field; findings carry theirs item by item."""
    return F.transform(f"{name}.items", lambda i: i["source"]) if name == "findings" else F.col(f"{name}.sources")


def has_value(name: str) -> Column:
    if name == "findings":
        return F.size(f"{name}.items") > 0
    if name in ("outcomes", "limitations"):
        return F.size(f"{name}.values") > 0
    if name == "sample_size":
        return F.col(f"{name}.participants").isNotNull() | F.col(f"{name}.studies").isNotNull()
    return F.col(f"{name}.value").isNotNull()


def _offsets_fit(s: Column) -> Column:
    """Both offsets or none, as far apart as the text is long."""
    return (s["start"].isNull() & s["end"].isNull()) | (s["start"].isNotNull() & s["end"].isNotNull() & (s["start"] >= 0) & (s["end"] - s["start"] == F.length(s["text"])))


def violations(evidence: DataFrame) -> DataFrame:
    """(paper_id, problem) of everything in evidence that may not be."""
    bad: list[tuple[str, Column]] = [
        ("blank paper_id", F.coalesce(F.col("paper_id") == "", F.lit(True))),
        ("blank extractor", F.coalesce(F.col("extractor") == "", F.lit(True))),
        ("unknown abstract_status", ~F.coalesce(F.col("abstract_status").isin(*ABSTRACT_STATUSES), F.lit(False))),
        ("unknown design", F.col("study_design.value").isNotNull() & ~F.col("study_design.value").isin(*DESIGNS)),
        ("count below 1", F.coalesce(F.col("sample_size.participants") < 1, F.lit(False)) | F.coalesce(F.col("sample_size.studies") < 1, F.lit(False))),
        ("unknown finding kind", F.exists("findings.items", lambda i: ~i["kind"].isin(*FINDING_KINDS))),
    ]
    for f in FIELDS:
        status, cited, valued = F.col(f"{f}.status"), spans(f), has_value(f)
        origin = F.when(status == "stated", "abstract").otherwise("title")
        bad += [
            (f"{f}: unknown status", ~F.coalesce(status.isin(*STATUSES), F.lit(False))),
            (f"{f}: unavailable with value or citation", (status == "unavailable") & (valued | (F.size(cited) > 0))),
            (f"{f}: available without value or citation", (status != "unavailable") & ~(valued & (F.size(cited) > 0))),
            (f"{f}: wrong origin", (status != "unavailable") & F.exists(cited, lambda s: s["origin"] != origin)),
            (f"{f}: offsets", F.exists(cited, lambda s: ~F.coalesce(_offsets_fit(s), F.lit(False)))),
            (f"{f}: empty citation", F.exists(cited, lambda s: F.coalesce(s["text"] == "", F.lit(True)))),
        ]
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in bad]))
    return evidence.select("paper_id", F.explode(found).alias("problem"))


def filed(evidence: DataFrame, papers: DataFrame) -> DataFrame:
    """Evidence (qid, paper_id) that belongs to a paper of its question, once for each; what an extractor says of others is left out."""
    own = papers.select("qid", F.col("id").alias("paper_id")).distinct()
    return evidence.join(own, ["qid", "paper_id"], "left_semi").dropDuplicates(["qid", "paper_id"])


def availability(evidence: DataFrame) -> DataFrame:
    """Per paper: the names of available and unavailable fields."""
    of = lambda want: F.array_compact(F.array(*[F.when((F.col(f"{f}.status") == "unavailable") == F.lit(not want), F.lit(f)) for f in FIELDS]))
    return evidence.select("paper_id", of(True).alias("available_fields"), of(False).alias("unavailable_fields"))


def untraceable(evidence: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, field, problem) of citations and values that their paper's text doesn't hold."""
    p = papers.select(F.col("id").alias("paper_id"), F.col("title").alias("_title"), F.col("abstract").alias("_abstract"))
    e = evidence.join(p, "paper_id", "left")

    def misplaced(s: Column) -> Column:
        source = F.when(s["origin"] == "abstract", F.col("_abstract")).otherwise(F.col("_title"))
        # substring counts code points, as offsets do
        return ~F.coalesce(F.substring(source, s["start"] + 1, s["end"] - s["start"]) == s["text"], F.lit(False))

    squash = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    joined = lambda f: F.array_join(F.transform(spans(f), lambda s: s["text"]), " ")
    uncited = lambda value, f: ~F.contains(squash(joined(f)), squash(value))
    checks = [("paper", "evidence without its paper", F.col("_title").isNull() & F.col("_abstract").isNull())]
    checks += [(f, "citation isn't in the source", F.exists(spans(f), misplaced)) for f in FIELDS]
    checks += [(f, "value isn't in its citation", F.col(f"{f}.value").isNotNull() & uncited(F.col(f"{f}.value"), f)) for f in ("population", "intervention", "comparator")]
    checks += [(f, "value isn't in its citation", F.exists(f"{f}.values", _uncited_in(squash(joined(f)), squash))) for f in ("outcomes", "limitations")]
    plain = squash(as_digits(F.when(F.col("sample_size.status") != "unavailable", joined("sample_size"))))
    for n in ("participants", "studies"):
        count = F.col(f"sample_size.{n}")
        checks.append(("sample_size", f"{n} aren't in the citation", count.isNotNull() & ~F.contains(plain, count.cast("string")) & ~F.contains(plain, F.format_number(count, 0))))
    checks.append(("findings", "statistic isn't in its citation", F.exists("findings.items", lambda i: F.exists(i["statistics"], lambda t: ~F.contains(squash(i["source"]["text"]), squash(t))))))
    rows = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(what).alias("problem"))) for f, what, cond in checks]))
    return e.select("paper_id", F.explode(rows).alias("x")).select("paper_id", "x.*")


def _uncited_in(cited: Column, squash):
    return lambda v: ~F.contains(cited, squash(v))


@F.pandas_udf(T.StringType())
def as_digits(s: pd.Series) -> pd.Series:
    return s.map(rules.digits, na_action="ignore")


def all_hold(frames: list[DataFrame]) -> bool:
    """True if none of the frames of violations has rows."""
    return reduce(lambda ok, d: ok and d.isEmpty(), frames, True)
