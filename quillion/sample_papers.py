"""Papers written from the ids of documents, so that what must be read off them is known without reading.

Every sentence is an expression in SQL that Spark and DuckDB share; ``d`` is a
doc_id. Even papers have labelled sections, odd ones none. Queries run the
engine over the written abstracts; their oracles state each result from ``d``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion.operators import evaluate, evidence, invariants, rules
from quillion.schemas import FIELDS, STATUSES
from quillion.session import cut, delete, read, shared_path, ship
from quillion.sources import evaluation


def case(n: int, *values: str | None) -> str:
    """The value for d modulo n: the first ones as given, else null."""
    return f"CASE d % {n} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values) if v is not None) + " END"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: (sentence, design that it states) by d modulo 19; the last ones state none.
DESIGNS = (
    ("This paper is a study protocol of a coming trial.", "study protocol"), ("We conducted an umbrella review of massage.", "umbrella review"), ("We conducted a scoping review of massage.", "scoping review"),
    ("We conducted a systematic review with meta-analysis.", "systematic review with meta-analysis"), ("We conducted a systematic review of massage.", "systematic review"), ("We conducted a meta-analysis.", "meta-analysis"),
    ("A quasi-experimental plan was evaluated.", "quasi-experimental study"), ("We conducted a randomised controlled trial of massage.", "randomized controlled trial"), ("We conducted a cohort study.", "cohort study"),
    ("A case-control plan was evaluated.", "case-control study"), ("A cross-sectional plan was evaluated.", "cross-sectional study"), ("We examined a case series.", "case series"), ("We examined a case report.", "case report"),
    ("We conducted qualitative interviews.", "qualitative study"), ("We conducted a narrative review.", "narrative review"), ("PubMed and Embase were searched and assessed.", "systematic review"),
    ("Previous randomised trials have shown much, so we conducted more.", None), ("A cross-sectional area was measured.", None),
)
#: Designs whose sentence doesn't itself say systematic or pooled: a title that says otherwise wins.
WEAK = (1, 2, 14, 15)

N, K = "(20 + d)", "(3 + d % 7)"
TITLE = case(3, "'Massage and pain, part ' || d", "'Massage in adults with knee pain: a cohort study, part ' || d", "'Massage, part ' || d")
SAMPLE = case(7, f"'A total of ' || {N} || ' patients were recruited.'", f"'A total of ' || {N} || ' patients and ' || {K} || ' nurses were recruited.'", f"'We included ' || {K} || ' trials and assessed them.'", f"'The sample had n = ' || {N} || ' at the start.'", "'In total, one hundred and forty-two patients were recruited.'", f"'Of 9 patients who were screened, ' || {N} || ' patients were recruited.'")
POPULATION = case(5, "'We studied massage in adults with knee pain.'", "'Nurses with back pain.'", "'We studied massage in patients.'")
INTERVENTION = case(11, "'We assessed the effect of yoga on pain during work.'", "'Ten yoga lessons.'", "'We assessed the lack of effects of tea.'")
COMPARATOR = case(13, "'It was compared with usual care, as tested.'", "'No treatment at all.'", "'A sham group was tested.'", "'It was tested without placebo group.'")
OUTCOMES = case(4, "'Pain, stiffness and walking speed.'", "'As measured, the primary outcomes were mood, sleep, and a walking test.'")
RESULT = case(17, "'Pain fell by ' || (d % 90) || '% (p < 0.05).'", "'The RR = 0.' || (d % 9 + 1) || ' (95% CI 0.2 to 1.4) was seen vs. tea.'", "'Nothing was seen by Dr. A. Smith.'", "'Pain was lower, Cohen''s d = 0.5.'")
CONCLUSION = case(6, "'Yoga was effective.'", "'Rest is fine.'")
LIMITATION = case(8, "'Few men took part.'", "'Our study was limited by its length.'")

#: Lines of an abstract: the label of even papers, and sentences.
LINES = (
    ("BACKGROUND", ("'Many systematic reviews exist of ' || (d + 7) || ' patients.'",)), ("METHODS", (case(19, *(text(s) for s, _ in DESIGNS)), SAMPLE)),
    ("PARTICIPANTS", (POPULATION,)), ("INTERVENTIONS", (INTERVENTION,)), ("COMPARISON", (COMPARATOR,)), ("MAIN OUTCOME MEASURES", (OUTCOMES,)),
    ("RESULTS", (RESULT,)), ("LIMITATIONS", (LIMITATION,)), ("CONCLUSIONS", (CONCLUSION,)),
)
SENTENCES = [(f"s{i}_{j}", label, s) for i, (label, ss) in enumerate(LINES) for j, s in enumerate(ss)]
_LINE = [f"CASE WHEN coalesce({', '.join(f's{i}_{j}' for j in range(len(ss)))}) IS NOT NULL THEN (CASE WHEN d % 2 = 0 THEN '{label}: ' ELSE '' END) || concat_ws(' ', {', '.join(f's{i}_{j}' for j in range(len(ss)))}) END" for i, (label, ss) in enumerate(LINES)]
#: Every 23rd paper has no abstract, every 29th an empty one.
ABSTRACT = f"CASE WHEN d % 23 = 5 THEN NULL WHEN d % 29 = 5 THEN ' ' ELSE concat_ws(chr(10), {', '.join(_LINE)}) END"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper for each document: doc_id, id, title, abstract."""
    ship(spark)
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"))
    d = d.select("d", F.expr(TITLE).alias("title"), *[F.expr(s).alias(c) for c, _, s in SENTENCES])
    return d.select(F.col("d").alias("doc_id"), F.concat(F.lit("paper:"), F.col("d").cast("string")).alias("id"), "title", F.expr(ABSTRACT).alias("abstract"))


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.extract(papers(spark, sf_dir), ["doc_id"])


def citations(sources) -> F.Column:
    """Texts of citations with their origins."""
    return F.array_join(F.transform(sources, lambda s: F.concat(s["origin"], F.lit(":"), s["text"])), "|")


# queries


def sentence_split(spark, sf_dir):
    s = evidence.sentences(papers(spark, sf_dir), ["doc_id"])
    return s.select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), "text", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "section")


def evidence_design(spark, sf_dir):
    return extracted(spark, sf_dir).select("doc_id", "abstract_status", F.col("study_design.status").alias("status"), F.col("study_design.value").alias("value"), citations(F.col("study_design.sources")).alias("cited"))


def evidence_sample_size(spark, sf_dir):
    return extracted(spark, sf_dir).select("doc_id", F.col("sample_size.status").alias("status"), F.col("sample_size.participants").alias("participants"), F.col("sample_size.studies").alias("studies"), citations(F.col("sample_size.sources")).alias("cited"))


def _texts(name):
    def query(spark, sf_dir):
        return extracted(spark, sf_dir).select("doc_id", F.col(f"{name}.status").alias("status"), F.col(f"{name}.value").alias("value"), citations(F.col(f"{name}.sources")).alias("cited"))

    return query


def evidence_outcomes(spark, sf_dir):
    return extracted(spark, sf_dir).select("doc_id", F.col("outcomes.status").alias("status"), F.array_join("outcomes.values", "; ").alias("values"), citations(F.col("outcomes.sources")).alias("cited"))


def evidence_findings(spark, sf_dir):
    found = extracted(spark, sf_dir).select("doc_id", F.posexplode("findings.items").alias("pos", "x"))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("x.kind").alias("kind"), F.col("x.source.text").alias("text"), F.array_join("x.statistics", "; ").alias("statistics"))


def evidence_limitations(spark, sf_dir):
    return extracted(spark, sf_dir).select("doc_id", F.col("limitations.status").alias("status"), F.array_join("limitations.values", "|").alias("values"))


def number_words(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"))
    ship(spark)
    return d.select(F.col("d").alias("doc_id"), invariants.as_digits(F.expr(NUMBER_TEXT)).alias("plain"))


def evidence_availability(spark, sf_dir):
    return evaluate.field_availability(extracted(spark, sf_dir)).select("field", *[F.col(s).cast("long").alias(s) for s in STATUSES])


def available_fields(spark, sf_dir):
    a = invariants.availability(extracted(spark, sf_dir).withColumn("n", F.lit(1)))
    return a.select(F.substring_index("paper_id", ":", -1).cast("long").alias("doc_id"), F.array_join("available_fields", ",").alias("available"), F.array_join("unavailable_fields", ",").alias("unavailable"))


def _gold(spark, sf_dir):
    """Gold rows that agree with the papers but where d says otherwise."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"))
    arrays = {f: F.when(F.expr(g).isNotNull(), F.array(F.expr(g))) for f, g in GOLD_TEXTS.items()}
    return d.select(
        F.concat(F.lit("paper:"), F.col("d").cast("string")).alias("paper_id"), F.expr(GOLD_DESIGN).alias("study_design"), F.expr(f"CAST({GOLD_PARTICIPANTS} AS BIGINT)").alias("participants"), F.lit(None).cast("long").alias("studies"),
        F.expr("d % 8 < 2").alias("limitations_stated"), *[v.alias(f) for f, v in arrays.items()], F.array(F.lit("P<0.05"), F.lit("95 % ci 0.2 TO 1.4")).alias("statistics"),
    )


def gold_outcomes(spark, sf_dir):
    o = evaluate.field_outcomes(_gold(spark, sf_dir), extracted(spark, sf_dir))
    return o.select(F.substring_index("paper_id", ":", -1).cast("long").alias("doc_id"), "field", "outcome")


def gold_accuracy(spark, sf_dir):
    return _accuracy(evaluate.field_outcomes(_gold(spark, sf_dir), extracted(spark, sf_dir)))


def _accuracy(outcomes):
    c = evaluate.outcome_counts(outcomes)
    return c.select("field", F.col("correct").cast("long").alias("correct"), F.col("`correct-null`").cast("long").alias("correct_null"), F.round("accuracy", 9).alias("accuracy"))


def gold_from_files(spark, sf_dir):
    """The rows of gold_accuracy, with the gold read from JSON: a line for up to a thousand papers."""
    path = shared_path(spark, "gold")
    g = _gold(spark, sf_dir).withColumnRenamed("paper_id", "id")
    part = g.groupBy(F.floor(F.substring_index("id", ":", -1).cast("long") / 1000)).agg(F.collect_list(F.struct(*g.columns)).alias("papers"))
    part.select(F.to_json(F.struct("papers"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    outcomes = evaluate.field_outcomes(evaluation.gold(spark, path, lines=True), extracted(spark, sf_dir))
    out, _ = cut(_accuracy(outcomes), "gold-outcomes")
    delete(spark, path)
    return out


def statistics_recall(spark, sf_dir):
    return evaluate.statistics_recall(_gold(spark, sf_dir), extracted(spark, sf_dir)).select("found", "expected")


def gold_ungrounded(spark, sf_dir):
    u = evaluate.ungrounded(_gold(spark, sf_dir), papers(spark, sf_dir).where("doc_id % 7 <> 3"))
    return u.select(F.substring_index("paper_id", ":", -1).cast("long").alias("doc_id"))


def gold_in_both(spark, sf_dir):
    """Papers that two gold sets share: ids divisible by 6, and by 10."""
    g = _gold(spark, sf_dir).withColumn("d", F.substring_index("paper_id", ":", -1).cast("long"))
    both = evaluate.in_both(g.where("d % 6 = 0"), g.where("d % 10 = 0"))
    return both.select(F.substring_index("paper_id", ":", -1).cast("long").alias("doc_id"))


def evidence_violations(spark, sf_dir):
    """Problems by kind in evidence of which some was damaged, by d modulo 31."""
    e = extracted(spark, sf_dir)
    hurt = lambda k: F.pmod("doc_id", F.lit(31)) == k
    put = lambda c, name, value: F.col(c).withField(name, value)
    shifted = F.transform("limitations.sources", lambda s: s.withField("end", s["end"] + 1))
    blank = F.transform("findings.items", lambda i: i.withField("source", i["source"].withField("text", F.lit(""))).withField("kind", F.lit("rumour")))
    e = e.withColumns({
        "paper_id": F.when(hurt(0), "").otherwise(F.col("paper_id")), "extractor": F.when(hurt(1), F.lit(None)).otherwise(F.col("extractor")), "abstract_status": F.when(hurt(2), "odd").otherwise(F.col("abstract_status")),
        "study_design": F.when(hurt(3) & F.col("study_design.value").isNotNull(), put("study_design", "value", F.lit("poem"))).otherwise(F.col("study_design")),
        "sample_size": F.when(hurt(4) & F.col("sample_size.participants").isNotNull(), put("sample_size", "participants", F.lit(0).cast("long"))).otherwise(F.col("sample_size")),
        "limitations": F.when(hurt(5), put("limitations", "sources", shifted)).when(hurt(6), put("limitations", "status", F.lit("unavailable"))).otherwise(F.col("limitations")),
        "population": F.when(hurt(7), put("population", "status", F.lit("stated"))).when(hurt(8), put("population", "status", F.lit("guessed"))).otherwise(F.col("population")),
        "findings": F.when(hurt(9), put("findings", "items", blank)).otherwise(F.col("findings")),
    })
    return invariants.violations(e).groupBy("problem").agg(F.count("*").alias("n"))


def evidence_untraceable(spark, sf_dir):
    """Problems by field where papers have lost their abstract (d modulo 10 = 0), their title (1) or everything (2), or values were changed (3)."""
    p = papers(spark, sf_dir)
    e = evidence.extract(p, ["doc_id"])
    k = F.pmod("doc_id", F.lit(10))
    e = e.withColumns({
        "population": F.when((k == 3) & F.col("population.value").isNotNull(), F.col("population").withField("value", F.lit("birds"))).otherwise(F.col("population")),
        "limitations": F.when((k == 3) & (F.size("limitations.values") > 0), F.col("limitations").withField("values", F.array(F.lit("none")))).otherwise(F.col("limitations")),
        "sample_size": F.when((k == 3) & F.col("sample_size.participants").isNotNull(), F.col("sample_size").withField("participants", F.lit(77777).cast("long"))).otherwise(F.col("sample_size")),
    })
    q = p.where(k != 2).withColumns({"abstract": F.when(k == 0, F.lit(None)).otherwise(F.col("abstract")), "title": F.when(k == 1, "Other").otherwise(F.col("title"))})
    return invariants.untraceable(e, q).groupBy("field", "problem").agg(F.count("*").alias("n"))


QUERIES = {
    "sentence_split": sentence_split, "evidence_design": evidence_design, "evidence_sample_size": evidence_sample_size, **{f"evidence_{n}": _texts(n) for n in ("population", "intervention", "comparator")},
    "evidence_outcomes": evidence_outcomes, "evidence_findings": evidence_findings, "evidence_limitations": evidence_limitations, "number_words": number_words, "evidence_availability": evidence_availability,
    "available_fields": available_fields, "gold_outcomes": gold_outcomes, "gold_accuracy": gold_accuracy, "gold_from_files": gold_from_files, "statistics_recall": statistics_recall, "gold_ungrounded": gold_ungrounded, "gold_in_both": gold_in_both,
    "evidence_violations": evidence_violations, "evidence_untraceable": evidence_untraceable,
}

# SQL

_UNITS, _TEENS, _TENS = (tuple(w for w, n in rules.NUMBERS.items() if low <= n < high) for low, high in ((1, 10), (10, 20), (20, 100)))
_X = "(10 + d % 990)"
_HUNDREDS, _REST = f"CAST(floor({_X} / 100) AS INT)", f"{_X} % 100"
_pick = lambda n, words: f"CASE {n} " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in words) + " END"
_SMALL = f"CASE WHEN {_REST} BETWEEN 1 AND 9 THEN {_pick(_REST, enumerate(_UNITS, 1))} WHEN {_REST} < 20 THEN {_pick(_REST, enumerate(_TEENS, 10))} ELSE {_pick(f'CAST(floor(({_REST}) / 10) AS INT)', enumerate(_TENS, 2))} || coalesce((CASE WHEN d % 2 = 0 THEN '-' ELSE ' ' END) || {_pick(f'({_REST}) % 10', enumerate(_UNITS, 1))}, '') END"
#: A text with a number from 10 to 999 in words, and numbers below ten, which stay.
NUMBER_TEXT = f"'the two groups had ' || concat_ws(CASE WHEN d % 3 = 0 THEN ' and ' ELSE ' ' END, {_pick(_HUNDREDS, ((k, f'{w} hundred') for k, w in enumerate(_UNITS, 1)))}, {_SMALL}) || ' adults'"

GOLD_DESIGN = "CASE WHEN d % 4 = 0 THEN 'cohort study' WHEN d % 4 = 1 THEN 'case series' END"
GOLD_PARTICIPANTS = f"CASE WHEN d % 7 IN (0, 3) THEN {N} WHEN d % 7 = 4 THEN 5 END"
GOLD_TEXTS = {"population": case(5, "'KNEE'", "'nurses'", None, "'women'"), "intervention": case(11, "'tea'", "'yoga'"), "comparator": case(13, "'usual'", None, "'sham'"), "outcomes": case(4, "'walking'", "'Sleep'", "'pain'")}

ALL = f"""
d0 AS (SELECT doc_id AS d FROM documents),
d1 AS (SELECT d, {TITLE} AS title, {', '.join(f'{s} AS {c}' for c, _, s in SENTENCES)} FROM d0),
p AS (SELECT *, {ABSTRACT} AS abstract, d % 2 = 0 AS lab FROM d1),
ok AS (SELECT *, abstract IS NOT NULL AND abstract <> ' ' AS has FROM p),
x AS (SELECT *, CASE WHEN abstract IS NULL THEN 'missing' WHEN has THEN 'present' ELSE 'empty' END AS abstract_status, CASE WHEN has THEN {case(19, *(text(v) if v else None for _, v in DESIGNS))} END AS said,
  CASE WHEN d % 3 = 1 THEN 'cohort study' END AS titled, d % 19 IN {WEAK} AS weak FROM ok),
design AS (SELECT d, abstract_status, CASE WHEN said IS NOT NULL AND NOT (weak AND titled IS NOT NULL) THEN 'stated' WHEN titled IS NOT NULL THEN 'inferred' ELSE 'unavailable' END AS status,
  CASE WHEN said IS NOT NULL AND NOT (weak AND titled IS NOT NULL) THEN said ELSE titled END AS value,
  CASE WHEN said IS NOT NULL AND NOT (weak AND titled IS NOT NULL) THEN 'abstract:' || s1_0 WHEN titled IS NOT NULL THEN 'title:' || title ELSE '' END AS cited FROM x),
size0 AS (SELECT d, s1_1 AS s, CASE WHEN has THEN CASE d % 7 WHEN 0 THEN {N} WHEN 3 THEN {N} WHEN 4 THEN 142 WHEN 5 THEN {N} END END AS n, CASE WHEN has AND d % 7 = 2 THEN {K} END AS k FROM x),
size AS (SELECT d, CASE WHEN n IS NULL AND k IS NULL THEN 'unavailable' ELSE 'stated' END AS status, CAST(n AS BIGINT) AS participants, CAST(k AS BIGINT) AS studies, CASE WHEN n IS NULL AND k IS NULL THEN '' ELSE 'abstract:' || s END AS cited FROM size0),
who AS (SELECT *, CASE WHEN has THEN CASE WHEN lab AND s2_0 IS NOT NULL THEN s2_0 WHEN d % 5 = 0 THEN 'adults with knee pain' WHEN d % 7 = 1 THEN 'nurses' WHEN d % 7 = 5 THEN 'patients who were screened' END END AS v FROM x),
population AS (SELECT d, CASE WHEN v IS NOT NULL THEN 'stated' WHEN d % 3 = 1 THEN 'inferred' ELSE 'unavailable' END AS status, coalesce(v, CASE WHEN d % 3 = 1 THEN 'adults with knee pain' END) AS value,
  CASE WHEN v IN ('nurses', 'patients who were screened') THEN 'abstract:' || s1_1 WHEN v IS NOT NULL THEN 'abstract:' || s2_0 WHEN d % 3 = 1 THEN 'title:' || title ELSE '' END AS cited FROM who),
intervention AS (SELECT d, v, s3_0 AS s FROM (SELECT *, CASE WHEN has THEN CASE WHEN lab THEN s3_0 WHEN d % 11 = 0 THEN 'yoga' END END AS v FROM x)),
comparator AS (SELECT d, v, s4_0 AS s FROM (SELECT *, CASE WHEN has THEN CASE WHEN lab THEN s4_0 WHEN d % 13 = 0 THEN 'usual care' WHEN d % 13 = 2 THEN 'sham group' END END AS v FROM x)),
outcomes AS (SELECT d, v, CASE WHEN v = 'pain' THEN s3_0 ELSE s5_0 END AS s FROM (SELECT *, CASE WHEN has THEN CASE WHEN lab AND d % 4 = 0 THEN 'Pain; stiffness; walking speed' WHEN NOT lab AND d % 4 = 1 THEN 'mood; sleep' WHEN d % 11 = 0 THEN 'pain' END END AS v FROM x)),
found AS (SELECT d, 1 AS o, lab, s6_0 AS s, 'result' AS kind, CASE d % 17 WHEN 0 THEN (d % 90) || '%; p < 0.05' WHEN 1 THEN 'RR = 0.' || (d % 9 + 1) || '; 95% CI 0.2 to 1.4' WHEN 3 THEN 'Cohen''s d = 0.5' ELSE '' END AS statistics FROM x WHERE has AND s6_0 IS NOT NULL AND (lab OR d % 17 <> 2)
  UNION ALL SELECT d, 2, lab, s8_0, 'conclusion', '' FROM x WHERE has AND s8_0 IS NOT NULL AND (lab OR d % 6 = 0)),
findings AS (SELECT d, row_number() OVER (PARTITION BY d ORDER BY o) - 1 AS pos, CASE WHEN lab THEN kind ELSE 'unclassified' END AS kind, s AS text, statistics FROM found),
limits AS (SELECT d, CASE WHEN has AND (lab OR d % 8 = 1) THEN s7_0 END AS v FROM x),
f AS (SELECT design.d, design.abstract_status, design.status AS study_design, population.status AS population, size.status AS sample_size, CASE WHEN intervention.v IS NULL THEN 'unavailable' ELSE 'stated' END AS intervention, CASE WHEN comparator.v IS NULL THEN 'unavailable' ELSE 'stated' END AS comparator,
  CASE WHEN outcomes.v IS NULL THEN 'unavailable' ELSE 'stated' END AS outcomes, CASE WHEN design.d IN (SELECT d FROM findings) THEN 'stated' ELSE 'unavailable' END AS findings, CASE WHEN limits.v IS NULL THEN 'unavailable' ELSE 'stated' END AS limitations
  FROM design JOIN population ON population.d = design.d JOIN size ON size.d = design.d JOIN intervention ON intervention.d = design.d JOIN comparator ON comparator.d = design.d JOIN outcomes ON outcomes.d = design.d JOIN limits ON limits.d = design.d),
statuses AS (UNPIVOT f ON study_design, population, sample_size, intervention, comparator, outcomes, findings, limitations INTO NAME field VALUE status)
"""
_TEXT = "SELECT d AS doc_id, CASE WHEN v IS NULL THEN 'unavailable' ELSE 'stated' END AS status, v AS value, CASE WHEN v IS NULL THEN '' ELSE 'abstract:' || s END AS cited FROM"
SPLIT = " UNION ALL ".join(f"SELECT d, {k} AS o, {c} AS text, CASE WHEN d % 2 = 0 THEN '{label}' END AS section FROM x WHERE has AND {c} IS NOT NULL" for k, (c, label, _) in enumerate(SENTENCES))
_judge = lambda field, e, g, right: f"SELECT d AS doc_id, '{field}' AS field, CASE WHEN {e} IS NULL AND {g} IS NULL THEN 'correct-null' WHEN {e} IS NULL THEN 'fabricated' WHEN {g} IS NULL THEN 'missed' WHEN {right} THEN 'correct' ELSE 'wrong' END AS outcome"
_GOLD = f"""
{ALL}, o AS (
{_judge('study_design', f'({GOLD_DESIGN})', 'value', f'({GOLD_DESIGN}) = value')} FROM design
UNION ALL {_judge('participants', f'({GOLD_PARTICIPANTS})', 'participants', f'({GOLD_PARTICIPANTS}) = participants')} FROM size
UNION ALL {_judge('studies', 'NULL', 'studies', 'false')} FROM size
UNION ALL {_judge('population', f"({GOLD_TEXTS['population']})", 'value', f"contains(lower(value), lower({GOLD_TEXTS['population']}))")} FROM population
UNION ALL {_judge('intervention', f"({GOLD_TEXTS['intervention']})", 'v', f"contains(lower(v), lower({GOLD_TEXTS['intervention']}))")} FROM intervention
UNION ALL {_judge('comparator', f"({GOLD_TEXTS['comparator']})", 'v', f"contains(lower(v), lower({GOLD_TEXTS['comparator']}))")} FROM comparator
UNION ALL {_judge('outcomes', f"({GOLD_TEXTS['outcomes']})", 'v', f"contains(lower(v), lower({GOLD_TEXTS['outcomes']}))")} FROM outcomes
UNION ALL SELECT d, 'limitations_stated', CASE WHEN v IS NOT NULL THEN CASE WHEN d % 8 < 2 THEN 'correct' ELSE 'fabricated' END WHEN d % 8 < 2 THEN 'missed' ELSE 'correct-null' END FROM limits)
"""
_CITED = "CASE WHEN status = 'stated' THEN 'abstract' WHEN status = 'inferred' THEN 'title' END"

ORACLES = {
    "sentence_split": f"WITH {ALL}, s AS ({SPLIT}), t AS (SELECT s.*, strpos(x.abstract, s.text) - 1 AS b FROM s JOIN x ON x.d = s.d) SELECT d AS doc_id, row_number() OVER (PARTITION BY d ORDER BY o) - 1 AS sent_idx, text, CAST(b AS BIGINT) AS start, CAST(b + length(text) AS BIGINT) AS \"end\", section FROM t",
    "evidence_design": f"WITH {ALL} SELECT d AS doc_id, abstract_status, status, value, cited FROM design",
    "evidence_sample_size": f"WITH {ALL} SELECT d AS doc_id, status, participants, studies, cited FROM size",
    "evidence_population": f"WITH {ALL} SELECT d AS doc_id, status, value, cited FROM population",
    "evidence_intervention": f"WITH {ALL} {_TEXT} intervention",
    "evidence_comparator": f"WITH {ALL} {_TEXT} comparator",
    "evidence_outcomes": f"WITH {ALL} SELECT d AS doc_id, CASE WHEN v IS NULL THEN 'unavailable' ELSE 'stated' END AS status, coalesce(v, '') AS values, CASE WHEN v IS NULL THEN '' ELSE 'abstract:' || s END AS cited FROM outcomes",
    "evidence_findings": f"WITH {ALL} SELECT d AS doc_id, pos, kind, text, statistics FROM findings",
    "evidence_limitations": f"WITH {ALL} SELECT d AS doc_id, CASE WHEN v IS NULL THEN 'unavailable' ELSE 'stated' END AS status, coalesce(v, '') AS values FROM limits",
    "number_words": f"SELECT d AS doc_id, 'the two groups had ' || {_X} || ' adults' AS plain FROM (SELECT doc_id AS d FROM documents)",
    "evidence_availability": f"WITH {ALL} SELECT field, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATUSES)} FROM statuses WHERE abstract_status = 'present' GROUP BY field",
    "available_fields": f"WITH {ALL} SELECT d AS doc_id, {', '.join(f"concat_ws(',', {', '.join(f"CASE WHEN ({f} = 'unavailable') = {no} THEN '{f}' END" for f in FIELDS)}) AS {name}" for name, no in (('available', 'false'), ('unavailable', 'true')))} FROM f",
    "gold_outcomes": f"WITH {_GOLD} SELECT doc_id, field, outcome FROM o",
    "gold_accuracy": f"WITH {_GOLD} SELECT field, count(*) FILTER (WHERE outcome = 'correct') AS correct, count(*) FILTER (WHERE outcome = 'correct-null') AS correct_null, round(count(*) FILTER (WHERE outcome LIKE 'correct%') / count(*), 9) AS accuracy FROM o GROUP BY field",
    "gold_from_files": f"WITH {_GOLD} SELECT field, count(*) FILTER (WHERE outcome = 'correct') AS correct, count(*) FILTER (WHERE outcome = 'correct-null') AS correct_null, round(count(*) FILTER (WHERE outcome LIKE 'correct%') / count(*), 9) AS accuracy FROM o GROUP BY field",
    "statistics_recall": f"WITH {ALL} SELECT count(*) FILTER (WHERE statistics <> '' AND d % 17 < 2) AS found, CAST(2 * (SELECT count(*) FROM x) AS BIGINT) AS expected FROM findings",
    "gold_in_both": "SELECT DISTINCT doc_id FROM documents WHERE doc_id % 30 = 0",
    "gold_ungrounded": "SELECT doc_id FROM documents WHERE doc_id % 7 = 3",
    "evidence_violations": f"""WITH {ALL}, v AS (
SELECT 'blank paper_id' AS problem FROM f WHERE d % 31 = 0 UNION ALL SELECT 'blank extractor' FROM f WHERE d % 31 = 1 UNION ALL SELECT 'unknown abstract_status' FROM f WHERE d % 31 = 2
UNION ALL SELECT 'unknown design' FROM f WHERE d % 31 = 3 AND study_design <> 'unavailable' UNION ALL SELECT 'count below 1' FROM size WHERE d % 31 = 4 AND participants IS NOT NULL
UNION ALL SELECT 'limitations: offsets' FROM f WHERE d % 31 = 5 AND limitations = 'stated' UNION ALL SELECT 'limitations: unavailable with value or citation' FROM f WHERE d % 31 = 6 AND limitations = 'stated'
UNION ALL SELECT 'population: available without value or citation' FROM f WHERE d % 31 IN (7, 8) AND population = 'unavailable' UNION ALL SELECT 'population: wrong origin' FROM f WHERE d % 31 = 7 AND population = 'inferred' OR d % 31 = 8 AND population = 'stated'
UNION ALL SELECT 'population: unknown status' FROM f WHERE d % 31 = 8 UNION ALL SELECT unnest(['unknown finding kind', 'findings: empty citation', 'findings: offsets']) FROM f WHERE d % 31 = 9 AND findings = 'stated')
SELECT problem, count(*) AS n FROM v GROUP BY problem""",
    "evidence_untraceable": f"""WITH {ALL}, c AS (SELECT d, field, {_CITED} AS origin FROM statuses WHERE status <> 'unavailable'),
v AS (SELECT field, 'citation isn''t in the source' AS problem FROM c WHERE d % 10 = 0 AND origin = 'abstract' OR d % 10 = 1 AND origin = 'title' OR d % 10 = 2
UNION ALL SELECT 'paper', 'evidence without its paper' FROM f WHERE d % 10 = 2
UNION ALL SELECT field, 'value isn''t in its citation' FROM c WHERE d % 10 = 3 AND field IN ('population', 'limitations') UNION ALL SELECT 'sample_size', 'participants aren''t in the citation' FROM size WHERE d % 10 = 3 AND participants IS NOT NULL)
SELECT field, problem, count(*) AS n FROM v GROUP BY 1, 2""",
}
