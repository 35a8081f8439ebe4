import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillion.operators import evidence, invariants, rules
from quillion.schemas import FIELDS


LABELLED = (
        "BACKGROUND: Pain is common in adults with arthritis.\nPARTICIPANTS: Adults with knee pain.\nMETHODS: A total of 120 patients were randomized to receive yoga or usual care. Ten were lost.\n"
        "MAIN OUTCOME MEASURES: Pain, function and sleep.\nRESULTS: Pain fell by 12% (p < 0.05) versus the control group.\nCONCLUSIONS: Yoga helps.\nLIMITATIONS: One site."
)
PAPERS = [
    ("T", " \n"),
    ("T", "METHODS: Pain fell by 40%."),
    ("T", "The study was conducted without a control group. We compared it with controls."),
    ("T", "There was no lack of blinding; the study had limitations of the usual kind."),
    ("T", "To reduce pain is good. Pain fell significantly. The weather was fine. We saw 40%."),
    ("Yoga in older adults: a cohort study", None),
    ("Yoga", "CONCLUSION: A systematic review is needed."),
    ("Yoga: a narrative review", "PubMed was searched for papers. Databases were searched."),
    ("Yoga", LABELLED),
]


@pytest.fixture(scope="module")
def found(spark):
    """Evidence of all papers of this module's tests by (title, abstract), from one job; constraints checked on all."""
    papers = [*PAPERS, *(("A title", a) for a, _ in DESIGNS), *(("T", a) for a, _, _ in SIZES)]
    df = spark.createDataFrame([(str(i), t, a) for i, (t, a) in enumerate(papers)], "id string, title string, abstract string").cache()
    e = evidence.extract(df).cache()
    assert invariants.violations(e).collect() == [] and invariants.untraceable(e, df).collect() == []
    return {papers[int(r["paper_id"])]: r for r in e.collect()}


def test_sentences_and_sections():
    text = "BACKGROUND: Pain is common (e.g. Smith et al. 2019). It hurts!\nIt goes on.\nThe study was done in a small town: nothing here\nMain Outcome Measures:: Pain vs. Function. Group A. Next"
    got = [(t, sec) for t, s, e, sec in rules.sentences(text) if text[s:e] == t]
    assert got == [
        ("Pain is common (e.g. Smith et al. 2019).", "BACKGROUND"), ("It hurts!", "BACKGROUND"), ("It goes on.", "BACKGROUND"), ("The study was done in a small town: nothing here", "BACKGROUND"),
        ("Pain vs. Function.", "Main Outcome Measures"), ("Group A. Next", "Main Outcome Measures"),
    ]


@settings(max_examples=60)
@given(st.text(alphabet="Ab .!?:\n\t(1é𝔘", max_size=80))
def test_offsets_always_give_the_sentence(text):
    for t, s, e, _ in rules.sentences(text):
        assert text[s:e] == t and t.strip() == t and t


@pytest.mark.parametrize("section, kind", [("METHODS", "other"), ("RESULTS AND CONCLUSIONS", "conclusion"), ("Findings", "results"), ("Context and aims", "background"), ("Interpretation", "conclusion"), (None, None)])
def test_section_kinds(section, kind):
    assert rules.kind(section) == kind


@pytest.mark.parametrize("text, got", [
    ("Pain fell (p < 0.001; 95% CI -2 to -0.2) by 12.5% and 12.5%.", ["p < 0.001", "95% CI -2 to -0.2", "12.5%"]), ("OR 1.8, d = 0.4", ["OR 1.8", "d = 0.4"]), ("no numbers", []), ("in 2019 we saw 40 people", []),
])
def test_statistics(text, got):
    assert rules.statistics(text) == got


@pytest.mark.parametrize("text, got", [("Seventy-five adults", "75 adults"), ("one hundred and forty-five", "145"), ("Thirteen of one group", "13 of one group"), ("two hundred", "200")])
def test_number_words(text, got):
    assert rules.digits(text) == got


@pytest.mark.parametrize("phrase, got", [
    ("pain, function, and quality of life", ["pain", "function", "quality of life"]), ("pain and function", ["pain and function"]), ("pain, sleep and mood at 6 weeks", ["pain", "sleep", "mood at"]), ("a worker with pain, strength", ["strength"]), ("strength (left, right), speed 12 weeks", ["strength (left, right)", "speed"]),
    ("patients with asthma, via mail, could fall, 12 months on", []),
])
def test_lists_of_outcomes(phrase, got):
    assert rules.items(phrase) == got


DESIGNS = [
    ("This is a protocol for a trial of yoga.", "study protocol"), ("We did an umbrella review of exercise.", "umbrella review"), ("We conducted a systematic review and meta-analysis.", "systematic review with meta-analysis"),
    ("PubMed and Embase were searched for trials.", "systematic review"), ("A meta-analysis was conducted.", "meta-analysis"), ("A randomised controlled trial was conducted.", "randomized controlled trial"),
    ("A non-randomized comparison was made.", "quasi-experimental study"), ("This cohort study followed nurses.", "cohort study"), ("We measured muscle cross-sectional area.", None), ("A cross-sectional survey was sent.", "cross-sectional study"),
    ("Previous randomized trials have shown benefits.", None), ("Participants were randomly assigned.", "randomized controlled trial"), ("This narrative review looks back.", "narrative review"),
]


@pytest.mark.parametrize("abstract, design", DESIGNS)
def test_designs(found, abstract, design):
    assert found["A title", abstract]["study_design"]["value"] == design


def test_title_gives_inferred_values_and_overrides_weak_cues(found):
    r = found["Yoga in older adults: a cohort study", None]
    assert (r["abstract_status"], r["study_design"]["status"], r["study_design"]["value"], r["population"]["status"], r["population"]["value"]) == ("missing", "inferred", "cohort study", "inferred", "older adults")
    r = found["Yoga: a narrative review", "PubMed was searched for papers. Databases were searched."]
    assert (r["study_design"]["status"], r["study_design"]["value"]) == ("inferred", "narrative review")
    r = found["Yoga", "CONCLUSION: A systematic review is needed."]
    assert r["study_design"]["status"] == "unavailable"


def test_labelled_abstract(found):
    r = found["Yoga", LABELLED]
    assert r["population"]["value"] == "Adults with knee pain." and r["intervention"]["value"] == "yoga" and r["comparator"]["status"] == "unavailable"
    assert r["sample_size"]["participants"] == 120 and r["outcomes"]["values"] == ["Pain", "function", "sleep"] and r["limitations"]["values"] == ["One site."]
    assert [(i["kind"], i["statistics"]) for i in r["findings"]["items"]] == [("result", ["12%", "p < 0.05"]), ("conclusion", [])]


SIZES = [
    ("We enrolled 34 patients (n = 17 in each).", 34, None), ("We studied 34 patients. We tested 40 adults.", None, None), ("We recruited 34 patients. We tested 40 adults with pain.", 34, None), ("We recruited 34 patients. We enrolled 40 adults.", None, None),
    ("Included were 30 patients per group.", None, None), ("107 participants completed the study, and were analyzed.", None, None), ("Twelve studies were included, with 1,582 participants.", 1582, 12), ("0 studies met the criteria.", None, None), ("The sample was Seventy-five volunteers.", 75, None),
]


@pytest.mark.parametrize("abstract, participants, studies", SIZES)
def test_sample_sizes(found, abstract, participants, studies):
    s = found["T", abstract]["sample_size"]
    assert (s["participants"], s["studies"]) == (participants, studies)


def test_negation_and_generic_phrases(found):
    r = found["T", "The study was conducted without a control group. We compared it with controls."]
    assert r["comparator"]["status"] == "unavailable"
    assert found["T", "There was no lack of blinding; the study had limitations of the usual kind."]["limitations"]["status"] == "unavailable"


def test_unlabelled_findings_need_a_cue(found):
    r = found["T", "To reduce pain is good. Pain fell significantly. The weather was fine. We saw 40%."]
    assert [i["source"]["text"] for i in r["findings"]["items"]] == ["Pain fell significantly.", "We saw 40%."] and {i["kind"] for i in r["findings"]["items"]} == {"unclassified"}
    assert found["T", "METHODS: Pain fell by 40%."]["findings"]["status"] == "unavailable"


def test_blank_and_missing(found):
    r = found["T", " \n"]
    assert r["abstract_status"] == "empty" and all(r[f]["status"] == "unavailable" for f in FIELDS)


def test_result_does_not_depend_on_partitions_and_gating_loses_nothing(spark):
    texts = [a for a, _ in DESIGNS]
    df = spark.createDataFrame([(str(i), "t", a) for i, a in enumerate(texts)], "id string, title string, abstract string")
    one = sorted(map(str, evidence.extract(df.coalesce(1)).collect()))
    assert one == sorted(map(str, evidence.extract(df.repartition(5)).collect()))


#: Texts of this module, and the same with letters that tests in any case of letters take for ASCII ones.
GATED = [t for _, a in PAPERS if a for t in (a, a.upper(), a.replace("s", "\u017f").replace("i", "\u0131"), a.replace("i", "\u0130").replace("k", "\u212a"))]


def test_no_test_is_skipped_that_would_succeed():
    every = rules.ALWAYS.union(rules.NEEDS)
    for t in [*GATED, *(a for a, _ in DESIGNS), *(a for a, _, _ in SIZES)]:
        for s, *_ in rules.sentences(t):
            able = rules.possible(s)
            assert rules.cues(s, able) == rules.cues(s, set(rules.CUE_TESTS)) and rules.counts(s, able) == rules.counts(s, set(every))
            assert [name for name, _, _, test in rules.PHRASE_TESTS if test.search(s) and name not in able] == []
            assert not rules.limited(s) or "limitation" in able


_PARTS = sorted({p for parts in rules.NEEDS.values() for p in parts} | {"review", "search", "of", "with", "was", "were", "12", "n", "group", "trial", "by"})


@settings(max_examples=200)
@given(st.lists(st.sampled_from(_PARTS), max_size=12).map(" ".join))
def test_gating_of_random_words(s):
    able = rules.possible(s)
    assert rules.cues(s, able) == rules.cues(s, set(rules.CUE_TESTS)) and rules.counts(s, able) == rules.counts(s, set(rules.NEEDS))
    assert [name for name, _, _, test in rules.PHRASE_TESTS if test.search(s) and name not in able] == []


def test_the_session_keeps_its_settings(spark):
    """Large batches of the session are cut inside the pass; its settings stay as they were."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        many = spark.range(1500).select(F.col("id").cast("string").alias("id"), F.lit("T").alias("title"), F.concat(F.lit("We enrolled "), F.col("id") + 1, F.lit(" patients.")).alias("abstract")).coalesce(1)
        e = evidence.extract(many).select("paper_id", "sample_size.participants").collect()
        assert len(e) == 1500 and all(r["participants"] == int(r["paper_id"]) + 1 for r in e)
        assert spark.conf.get(name) == "10000"
    finally:
        spark.conf.set(name, old)


def test_invariants_catch_wrong_evidence(spark):
    df = spark.createDataFrame([("p", "T", "We enrolled 34 patients.")], "id string, title string, abstract string")
    e = evidence.extract(df)
    bad = e.withColumn("sample_size", F.col("sample_size").withField("status", F.lit("unavailable"))).withColumn("study_design", F.col("study_design").withField("status", F.lit("stated")))
    assert {r["problem"] for r in invariants.violations(bad).collect()} == {"sample_size: unavailable with value or citation", "study_design: available without value or citation"}
    other = df.withColumn("abstract", F.lit("Something else entirely."))
    assert {r["field"] for r in invariants.untraceable(e, other).collect()} == {"sample_size"}
    a = invariants.availability(e).collect()[0]
    assert a["available_fields"] == ["sample_size"] and len(a["unavailable_fields"]) == 7



def test_papers_on_which_rules_fail_cost_no_other(spark):
    """Rows whose facts couldn't be read are left out and listed with the name of the error."""
    df = spark.createDataFrame([("1", "T", "We saw 40%."), ("2", "T", "More.")], "id string, title string, abstract string")
    facts = evidence.with_facts(df.withColumn("paper_id", F.col("id")), ["paper_id"])
    hurt = facts.withColumns({"s": F.when(F.col("paper_id") != "2", F.col("s")), "error": F.when(F.col("paper_id") == "2", "ValueError")})
    assert [r["paper_id"] for r in evidence.assembled(hurt, ["paper_id"]).collect()] == ["1"]
    assert evidence.failures(df).count() == 0
