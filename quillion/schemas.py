"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

STR, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()


def struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


#: A bibliographic record. ``ord`` carries the order that rows alone don't have.
PAPER = struct(
    ord=LONG, qid=STR, id=STR, title=STR, authors=T.ArrayType(STR), abstract=STR, journal=STR, publication_date=STR, doi=STR,
    source=STR, source_id=STR, url=STR, source_ids=T.ArrayType(STR), provider_ranks=T.MapType(STR, INT), rank_score=T.DoubleType(),
)
SPAN = struct(origin=STR, text=STR, section=STR, start=INT, end=INT)
TEXT_FIELD = struct(status=STR, value=STR, sources=T.ArrayType(SPAN))
LIST_FIELD = struct(status=STR, values=T.ArrayType(STR), sources=T.ArrayType(SPAN))
SIZE_FIELD = struct(status=STR, participants=LONG, studies=LONG, sources=T.ArrayType(SPAN))
FINDING = struct(kind=STR, source=SPAN, statistics=T.ArrayType(STR))
FINDINGS_FIELD = struct(status=STR, items=T.ArrayType(FINDING))

#: Names of fields, statuses, designs and kinds in results.
FIELDS = ("study_design", "population", "sample_size", "intervention", "comparator", "outcomes", "findings", "limitations")
STATUSES = ("stated", "inferred", "unavailable")
ABSTRACT_STATUSES = ("missing", "empty", "present")
FINDING_KINDS = ("result", "conclusion", "unclassified")
DESIGNS = (
    "randomized controlled trial", "quasi-experimental study", "cohort study", "case-control study", "cross-sectional study", "case series", "case report",
    "qualitative study", "systematic review", "systematic review with meta-analysis", "meta-analysis", "scoping review", "umbrella review", "narrative review", "study protocol",
)
EXTRACTOR = "rule-based-v1"
