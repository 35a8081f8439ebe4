"""Evidence: eight fields of a paper, each citing the text that it comes from.

One Arrow pass turns title and abstract into facts (``rules.facts``); which
facts become values is decided by DataFrame expressions over the paper's
own array of sentences, so nothing is shuffled and a paper is never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillion.functions import text
from quillion.operators import rules
from quillion.schemas import EXTRACTOR, INT, LONG, STR, struct
from quillion.session import spread

PHRASE = struct(field=STR, pattern=INT, at=INT, text=STR, items=T.ArrayType(STR))
SENTENCE = struct(
    idx=INT, text=STR, start=INT, end=INT, section=STR, kind=STR, cues=T.ArrayType(STR), labels=T.ArrayType(STR), review_section=T.BooleanType(), phrases=T.ArrayType(PHRASE),
    items=T.ArrayType(STR), people=T.ArrayType(LONG), n_equals=T.ArrayType(LONG), studies=T.ArrayType(LONG), statistics=T.ArrayType(STR),
)

#: Rows whose facts a Python worker holds at a time.
BATCH_ROWS = 512


def abstract_status(abstract: Column) -> Column:
    return F.when(abstract.isNull(), "missing").when(text.strip(abstract) == "", "empty").otherwise("present")


def _mapped(df: DataFrame, added: T.StructType, keep: list[str], fn) -> DataFrame:
    schema = T.StructType([*[df.schema[c] for c in keep], *added.fields])
    want = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # facts are several times their text: few rows of them at a time, whatever the session's batches hold
        for b in (whole.slice(k, BATCH_ROWS) for whole in batches for k in range(0, whole.num_rows, BATCH_ROWS)):
            out = {c: b.column(c) for c in keep} | fn(b)
            yield pa.RecordBatch.from_arrays([c if isinstance(c := out[f.name], pa.Array) else pa.array(c, f.type) for f in want], schema=want)

    return df.mapInArrow(run, schema)


def with_facts(papers: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with title, abstract, s (facts by sentence), title_cues, title_population and error.

    A paper on which the rules fail has null facts and the name of the error: it costs no other paper its evidence.
    """
    added = struct(s=T.ArrayType(SENTENCE), title_cues=T.ArrayType(STR), title_population=STR, error=STR)

    def fn(b: pa.RecordBatch) -> dict:
        got = []
        for t, a in zip(b.column("title").to_pylist(), b.column("abstract").to_pylist(), strict=True):
            try:
                got.append(rules.facts(t, a) | {"error": None})
            except Exception as e:  # noqa: BLE001
                got.append({"sentences": None, "title_cues": None, "title_population": None, "error": type(e).__name__})
        return {"s": [g["sentences"] for g in got], **{k: [g[k] for g in got] for k in ("title_cues", "title_population", "error")}}

    keep = list(dict.fromkeys([*keep, "title", "abstract"]))
    return _mapped(spread(papers.select(*keep)), added, keep, fn)


def sentences(papers: DataFrame, keep: list[str]) -> DataFrame:
    """One row per sentence: the columns ``keep``, sent_idx, text, start, end, section."""
    kind = T.ArrayType(struct(text=STR, start=INT, end=INT, section=STR))

    def fn(b: pa.RecordBatch) -> dict:
        names = ("text", "start", "end", "section")
        return {"_s": [[dict(zip(names, x, strict=True)) for x in rules.sentences(a or "")] for a in b.column("abstract").to_pylist()]}

    cols = list(dict.fromkeys([*keep, "abstract"]))
    df = _mapped(spread(papers.select(*cols)), struct(_s=kind), keep, fn)
    return df.select(*keep, F.posexplode("_s").alias("sent_idx", "x")).select(*keep, "sent_idx", "x.*")


def first(xs: Column, where) -> Column:
    """The first element for which ``where`` holds, or null."""
    return F.try_element_at(F.filter(xs, where), F.lit(1))


def cued(x: Column, name: str) -> Column:
    return F.array_contains(x["cues"], name)


def kind_in(x: Column, *kinds: str) -> Column:
    return F.coalesce(x["kind"].isin(*kinds), F.lit(False))


def span(x: Column) -> Column:
    """The citation of a sentence."""
    return F.struct(F.lit("abstract").alias("origin"), x["text"].alias("text"), x["section"].alias("section"), x["start"].alias("start"), x["end"].alias("end"))


def title_span() -> Column:
    return F.struct(F.lit("title").alias("origin"), F.col("title").alias("text"), F.lit(None).cast("string").alias("section"), F.lit(0).alias("start"), F.length("title").alias("end"))


def no_spans() -> Column:
    return F.filter(F.array(title_span()), lambda x: F.lit(False))


def field(name: str, *cases: tuple[Column, str, dict[str, Column]], empty: dict[str, Column]) -> Column:
    """A field: the first case (condition, status, parts) that holds, else unavailable."""
    make = lambda status, parts: F.struct(F.lit(status).alias("status"), *[v.alias(k) for k, v in parts.items()])
    out = None
    for when, status, parts in cases:
        out = F.when(when, make(status, parts)) if out is None else out.when(when, make(status, parts))
    return out.otherwise(make("unavailable", empty)).alias(name)


_NO_TEXT = lambda: {"value": F.lit(None).cast("string"), "sources": no_spans()}
_NO_LIST = lambda: {"values": F.array().cast("array<string>"), "sources": no_spans()}


def _designs() -> tuple[Column, Column]:
    """(abstract's, title's) design: structs of label, spans and strong (the wording itself names a review)."""
    own, sys, meta = F.col("own"), F.col("systematic"), F.col("meta")
    strong = lambda x: cued(x, "systematic") | cued(x, "meta")
    found = lambda label, spans, how: F.struct(F.lit(label).alias("label"), spans.alias("spans"), how.alias("strong"))
    plain = lambda d: F.when((x := first(own, lambda y: cued(y, d))).isNotNull(), found(d, F.array(span(x)), strong(x)))
    both = F.when(sys["idx"] == meta["idx"], F.array(span(sys))).otherwise(F.array(span(sys), span(meta)))
    reviews = [
        F.when(sys.isNotNull() & meta.isNotNull(), found("systematic review with meta-analysis", both, F.lit(True))),
        F.when(sys.isNotNull(), found("systematic review", F.array(span(sys)), strong(sys))),
        F.when(meta.isNotNull(), found("meta-analysis", F.array(span(meta)), F.lit(True))),
    ]
    said = F.coalesce(*map(plain, rules.DESIGNS_FIRST), *reviews, *map(plain, rules.DESIGNS_LAST))
    has = lambda name: F.array_contains("title_cues", name)
    review, pooled = has("systematic") | has("searched"), has("meta")
    named = [F.when(has(d), d) for d in rules.DESIGNS_FIRST]
    named += [F.when(review & pooled, "systematic review with meta-analysis"), F.when(review, "systematic review"), F.when(pooled, "meta-analysis")]
    named += [F.when(has(d), d) for d in rules.DESIGNS_LAST]
    return said, F.coalesce(*named)


def _labelled(name: str) -> Column:
    """The first design-level sentence in a section that is named for the field."""
    return first(F.col("level"), lambda x: F.array_contains(x["labels"], name))


def _phrase(name: str) -> Column:
    """The first usable phrase of a field among the design-level sentences: by pattern, then sentence, then place."""
    one = lambda x: F.transform(F.filter(x["phrases"], lambda p: p["field"] == name), lambda p: F.struct(p["pattern"], x["idx"], p["at"], p["text"].alias("phrase"), p["items"].alias("items"), span(x).alias("span")))
    return F.array_min(F.flatten(F.transform("level", one)))


def _count(name: str) -> Column:
    """Candidates of a kind of count: n, the citation, and if the sentence is about enrolment."""
    usable = F.filter("s", lambda x: ~kind_in(x, "background", "conclusion"))
    return F.flatten(F.transform(usable, lambda x: F.transform(x[name], lambda n: F.struct(n.alias("n"), span(x).alias("span"), cued(x, "enrolment").alias("enrolled")))))


def _one(candidates: Column) -> Column:
    """The only candidate; of several, the only one about enrolment; else null."""
    enrolled = F.filter(candidates, lambda c: c["enrolled"])
    return F.when(F.size(candidates) == 1, candidates[0]).when(F.size(enrolled) == 1, enrolled[0])


def _text(name: str, from_title: bool = False) -> Column:
    labelled, phrase = F.col(f"l_{name}"), F.col(f"p_{name}")
    cases = [
        (labelled.isNotNull(), "stated", {"value": labelled["text"], "sources": F.array(span(labelled))}),
        (phrase.isNotNull(), "stated", {"value": phrase["phrase"], "sources": F.array(phrase["span"])}),
    ]
    if from_title:
        cases.append((F.col("title_population").isNotNull(), "inferred", {"value": F.col("title_population"), "sources": F.array(title_span())}))
    return field(name, *cases, empty=_NO_TEXT())


def assembled(facts: DataFrame, keep: list[str]) -> DataFrame:
    """Evidence from ``with_facts``: columns ``keep``, extractor, abstract_status and the eight fields."""
    df = facts.where(F.col("s").isNotNull())
    labelled = F.exists("s", lambda x: x["section"].isNotNull() & (x["section"] != ""))
    design_level = lambda x: F.when(F.col("labelled"), ~kind_in(x, "results", "conclusion") & (~kind_in(x, "background") | cued(x, "aim_or_method"))).otherwise(cued(x, "aim_or_method"))
    df = df.withColumn("labelled", F.coalesce(labelled, F.lit(False)))
    own = lambda x: ~kind_in(x, "conclusion") & (~kind_in(x, "background") | cued(x, "aim_or_method")) & ~cued(x, "others")
    df = df.withColumns({"level": F.filter("s", design_level), "own": F.filter("s", own)})
    search_section = F.when(F.exists("s", lambda x: x["review_section"]), F.try_element_at("own", F.lit(1)))
    df = df.withColumns({
        "systematic": F.coalesce(first(F.col("own"), lambda x: cued(x, "systematic")), first(F.col("own"), lambda x: cued(x, "searched")), search_section),
        "meta": first(F.col("own"), lambda x: cued(x, "meta")),
        **{f"l_{n}": _labelled(n) for n in rules.PHRASES},
        **{f"p_{n}": _phrase(n) for n in rules.PHRASES},
        **{f"c_{n}": _count(n) for n in rules.COUNTS},
    })
    said, titled = _designs()
    people = F.when(F.size("c_people") > 0, _one(F.col("c_people"))).when(F.size("c_n_equals") > 0, _one(F.col("c_n_equals")))
    df = df.withColumns({"said": said, "titled": titled, "people": people, "studies": _one(F.col("c_studies"))})
    weak = F.col("said.label").rlike("(review|meta-analysis)$") & ~F.col("said.strong")
    design = field(
        "study_design",
        (F.col("said").isNotNull() & ~(weak & F.coalesce(F.col("titled") != F.col("said.label"), F.lit(False))), "stated", {"value": F.col("said.label"), "sources": F.col("said.spans")}),
        (F.col("titled").isNotNull(), "inferred", {"value": F.col("titled"), "sources": F.array(title_span())}),
        empty=_NO_TEXT(),
    )
    p, n = F.col("people"), F.col("studies")
    cited = F.array_distinct(F.array_compact(F.array(p["span"], n["span"])))
    size = field(
        "sample_size", (p.isNotNull() | n.isNotNull(), "stated", {"participants": p["n"], "studies": n["n"], "sources": cited}),
        empty={"participants": F.lit(None).cast("long"), "studies": F.lit(None).cast("long"), "sources": no_spans()},
    )
    listed, phrase = F.col("l_outcomes"), F.col("p_outcomes")
    outcomes = field(
        "outcomes",
        (F.coalesce(F.size(listed["items"]), F.lit(0)) > 0, "stated", {"values": listed["items"], "sources": F.array(span(listed))}),
        (F.coalesce(F.size(phrase["items"]), F.lit(0)) > 0, "stated", {"values": phrase["items"], "sources": F.array(phrase["span"])}),
        empty=_NO_LIST(),
    )
    reported = lambda x: F.when(F.col("labelled"), kind_in(x, "results", "conclusion")).otherwise(~cued(x, "states_aim") & ((F.size(x["statistics"]) > 0) | cued(x, "finding")))
    told = lambda x: F.when(~F.col("labelled"), "unclassified").when(x["kind"] == "results", "result").otherwise("conclusion")
    found = F.transform(F.filter("s", reported), lambda x: F.struct(told(x).alias("kind"), span(x).alias("source"), x["statistics"].alias("statistics")))
    findings = field("findings", (F.size(found) > 0, "stated", {"items": found}), empty={"items": found})
    limits = F.filter("s", lambda x: ~kind_in(x, "background") & (cued(x, "limitation") | F.array_contains(x["labels"], "limitations")))
    limitations = field("limitations", (F.size(limits) > 0, "stated", {"values": F.transform(limits, lambda x: x["text"]), "sources": F.transform(limits, span)}), empty=_NO_LIST())
    return df.select(
        *keep, F.lit(EXTRACTOR).alias("extractor"), abstract_status(F.col("abstract")).alias("abstract_status"),
        design, _text("population", from_title=True), size, _text("intervention"), _text("comparator"), outcomes, findings, limitations,
    )


def failures(papers: DataFrame) -> DataFrame:
    """(paper_id, error) of the papers on which the rules fail; ``extract`` leaves them out."""
    f = with_facts(papers.withColumn("paper_id", F.col("id")), ["paper_id"])
    return f.where(F.col("error").isNotNull()).select("paper_id", "error")


def extract(papers: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Evidence of papers (id, title, abstract): paper_id, further columns ``keep``, and the fields."""
    keep = ["paper_id", *(keep or [])]
    return assembled(with_facts(papers.withColumn("paper_id", F.col("id")), keep), keep)
