import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillion.operators import control, evaluate


@pytest.mark.parametrize("outcome, attempt, header, action, wait, message", [
    ("200", 0, None, "return", None, None), ("301", 0, None, "return", None, None), ("429", 0, "3", "retry", 3.0, None), ("429", 0, "60", "retry", 5.0, None), ("429", 0, "0", "retry", 1.0, None),
    ("429", 0, "soon", "retry", 1.0, None), ("429", 0, "-1", "retry", 1.0, None), ("503", 0, "3", "retry", 1.0, None), ("503", 1, None, "fail", None, "HTTP 503 after retry"), ("404", 0, None, "fail", None, "HTTP 404"),
    ("timeout", 0, None, "fail", None, "request timed out"), ("network", 1, None, "fail", None, "network error"),
])
def test_retries(spark, outcome, attempt, header, action, wait, message):
    df = spark.createDataFrame([(outcome, attempt, header, 1.0)], "outcome string, attempt int, retry_after string, backoff double")
    r = control.decide(df).collect()[0]
    assert (r["action"], r["wait"], r["message"]) == (action, wait, message)


def test_schedule_equals_the_recurrence(spark):
    at = [0, 10, 400_000, 2_000_000, 2_000_001]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(at)], "p string, i int, at_us long")
    got = [r["start_us"] for r in control.schedule(df, "p", "at_us", F.lit(3), ["at_us", "i"]).orderBy("i").collect()]
    want, last = [], None
    for t in at:
        last = t if last is None else max(t, last + 333_333)
        want.append(last)
    assert got == want


def test_statuses_and_codes(spark):
    o = spark.createDataFrame([("q", "a", None, 1.0, 18.0, 5), ("q", "b", "network error", 1.0, 18.0, 0), ("z", "a", None, 19.0, 18.0, 4)], "qid string, provider string, failure string, seconds double, budget double, paper_count int")
    s = control.provider_status(o)
    assert {(r["qid"], r["provider"]): (r["status"], r["paper_count"], r["error"]) for r in s.collect()} == {("q", "a"): ("ok", 5, None), ("q", "b"): ("error", 0, "network error"), ("z", "a"): ("error", 0, "exceeded time budget")}
    assert {r["qid"]: r["code"] for r in control.response_code(s).collect()} == {"q": 200, "z": 502}


def test_retrieval_metrics(spark):
    r = spark.createDataFrame([("q", "s", i, [f"p{i}", "x"] if i == 3 else [f"p{i}"]) for i in range(1, 25)], "qid string, system string, rank int, source_ids array<string>")
    j = spark.createDataFrame([("q", "p2"), ("q", "x"), ("q", "p11"), ("q", "gone")], "qid string, paper_id string")
    m = evaluate.retrieval_metrics(r, j).collect()[0]
    assert (m["recall_5"], m["recall_10"], m["recall_20"], m["mrr"]) == (0.5, 0.5, 0.75, 0.5)
    assert [x["paper_id"] for x in evaluate.unretrieved(r, j).collect()] == ["gone"]
    none = evaluate.retrieval_metrics(r, spark.createDataFrame([("q", "no")], "qid string, paper_id string")).collect()[0]
    assert (none["recall_20"], none["mrr"]) == (0.0, 0.0)


def test_field_outcomes_and_statistics_recall(spark):
    from quillion.operators import evidence

    p = spark.createDataFrame([("p", "T", "We enrolled 34 patients with asthma. Pain fell by 12 % (p < 0.05).")], "id string, title string, abstract string")
    e = evidence.extract(p)
    gold = [{"paper_id": "p", "study_design": "cohort study", "participants": 34, "studies": None, "limitations_stated": False, "population": ["Asthma"], "intervention": None, "comparator": ["x"], "outcomes": None, "statistics": ["12%", "P<0.05", "d=1"]}]
    g = spark.read.schema("paper_id string, study_design string, participants long, studies long, limitations_stated boolean, population array<string>, intervention array<string>, comparator array<string>, outcomes array<string>, statistics array<string>").json(spark.sparkContext.parallelize([json.dumps(x) for x in gold]))
    out = {r["field"]: r["outcome"] for r in evaluate.field_outcomes(g, e).collect()}
    assert out == {"study_design": "missed", "participants": "correct", "studies": "correct-null", "limitations_stated": "correct-null", "population": "correct", "intervention": "correct-null", "comparator": "missed", "outcomes": "correct-null"}
    r = evaluate.statistics_recall(g, e).collect()[0]
    assert (r["found"], r["expected"]) == (2, 3)
    counts = {r["field"]: r for r in evaluate.outcome_counts(evaluate.field_outcomes(g, e)).collect()}
    assert counts["participants"]["accuracy"] == 1.0 and counts["comparator"]["missed"] == 1
    assert evaluate.ungrounded(g, p.where("id = 'none'")).count() == 1


def test_latency_takes_a_value_not_between(spark):
    df = spark.createDataFrame([("g", i, float(v)) for i in range(1, 5) for v in (i, i + 10)], "g string, item int, ms double")
    r = evaluate.latency(df, ["g"], "item", "ms").collect()[0]
    assert (r["mean"], r["median"], r["p95"], r["max"]) == (2.5, 2.5, 3.0, 4.0)


def test_report():
    assert evaluate.markdown([{"a": 1, "b": 0.5}], ["a", "b"]) == "| a | b |\n|---|---|\n| 1 | 0.50 |"


def test_streaming_answers_files(spark, tmp_path):
    from quillion.plans.research import research
    from quillion.sources import crossref
    from quillion.streaming.questions import answer, fused

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"qid": "q", "question": "Does yoga help?"}\n')
    works = spark.createDataFrame([("q", json.dumps({"status": "ok", "message": {"items": [{"DOI": "10.1/a", "title": ["Yoga"]}]}}))], "qid string, payload string")
    q = answer(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: research(df, [crossref.Crossref(works)], with_evidence=False))
    q.awaitTermination()
    papers = spark.read.parquet(str(tmp_path / "out" / "papers"))
    assert [r["id"] for r in papers.collect()] == ["crossref:10.1/a"]
    assert abs(fused(papers).collect()[0]["fused_score"] - 1 / 61) < 1e-12


def test_schedules_of_blocks_and_values_at_places(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{k % 2}", i, int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 2, 200), rng.integers(0, 50_000_000, 200), strict=True))] + [("one", 999, 5)]
    df = spark.createDataFrame(rows, "source string, id long, at long")
    for blocks in (1, 7, 1024):
        got = {r["id"]: r["start_us"] for r in control.schedule(df, "source", "at", F.lit(2.0), ["at", "id"], blocks).collect()}
        for s in ("s0", "s1", "one"):
            free = 0
            for _, i, at in sorted((x for x in rows if x[0] == s), key=lambda x: (x[2], x[1])):
                assert got[i] == max(at, free)
                free = got[i] + 500_000
    values = [float(v) for v in [*rng.integers(0, 30, 101), 1e6]]
    v = spark.createDataFrame([("a", x) for x in values] + [("b", 4.0)] * 3 + [("c", None)], "g string, v double")
    places = {"first": F.lit(0), "late": F.floor(0.95 * (F.col("n") - 1)), "last": F.col("n") - 1}
    got = {r["g"]: (r["first"], r["late"], r["last"]) for r in evaluate.values_at(v, ["g"], "v", places, bins=8).collect()}
    values.sort()
    assert got == {"a": (values[0], values[int(0.95 * 101)], values[-1]), "b": (4.0, 4.0, 4.0)}


def test_reports_and_shared_papers(spark, tmp_path):
    m = spark.createDataFrame([("q1", "ranked", 0.5, 0.5, 1.0, 1.0), ("q2", "ranked", 0.0, 0.5, 0.5, 0.25)], "qid string, system string, recall_5 double, recall_10 double, recall_20 double, mrr double")
    text = evaluate.retrieval_report(m)
    assert "| q2 | ranked | 0.00 | 0.50 | 0.50 | 0.25 |" in text and "| ranked | 0.25 | 0.50 | 0.75 | 0.62 |" in text
    o = spark.createDataFrame([("1", "population", "correct"), ("2", "population", "missed")], "paper_id string, field string, outcome string")
    text = evaluate.evidence_report(o, spark.createDataFrame([("population", 1, 0, 1)], "field string, stated long, inferred long, unavailable long"), m.where("false"))
    assert "| population | 1 | 0 | 1 | 0 | 0 | 0.50 |" in text and text.endswith("Not traceable: 0\n")
    evaluate.write_report(spark, text, str(tmp_path / "r"))
    assert "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()) + "\n" == text
    assert [r["paper_id"] for r in evaluate.in_both(o, o.where("paper_id = '2'")).collect()] == ["2"]
