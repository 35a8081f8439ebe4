import json

import pytest
from pyspark.sql import functions as F

from quillion.operators import evaluate
from quillion.plans.research import research
from quillion.sources import evaluation

PAPER = {"title": "Yoga for knees", "authors": ["A B"], "abstract": "We enrolled 34 patients.", "journal": None, "publication_date": "2020", "url": None}


def paper(source, key, **more):
    return {"id": f"{source}:{key}", "source": source, "source_id": key, "source_ids": [f"{source}:{key}"], "provider_ranks": {source: 1}, "doi": None, **PAPER, **more}


def write(path, value, lines=False):
    path.write_text("\n".join(map(json.dumps, value)) if lines else json.dumps(value, indent=1))
    return path.as_uri()


def test_pool_and_judgments_give_metrics(spark, tmp_path):
    """Two questions, one of them without records of a source; both systems' metrics come from the files alone."""
    pool = {"recorded_on": "2024-01-01", "limit": 20, "questions": {
        "q1": {"question": "Does yoga help knees?", "query": "yoga knees", "providers": {"pubmed": [paper("pubmed", "1", title="Other things"), paper("pubmed", "2", doi="https://doi.org/10.1/x")], "crossref": [paper("crossref", "10.1/x", doi="https://doi.org/10.1/x")]}},
        "q2": {"question": "Is tape good?", "query": "tape", "providers": {"pubmed": []}},
    }}
    judged = {"criteria": "…", "questions": {"q1": {"relevant": [{"id": "crossref:10.1/x", "title": "Yoga for knees"}] * 2}, "q2": {"relevant": []}}}
    path = write(tmp_path / "pools.json", pool)
    sources = [evaluation.Pool(spark, path, n) for n in ("pubmed", "crossref")]
    q = sources[0].questions()
    assert sorted(map(tuple, q.collect())) == [("q1", "Does yoga help knees?"), ("q2", "Is tape good?")]
    assert [(r["pos"], r["id"]) for r in sources[0].search(q).orderBy("pos").collect()] == [(1, "pubmed:1"), (2, "pubmed:2")]
    assert sources[1].search(q.where("qid = 'q2'")).count() == 0
    r = research(q, sources, with_evidence=False)
    assert r.papers.select("qid", "rank", "id").collect() == [("q1", 1, "pubmed:2"), ("q1", 2, "pubmed:1")]
    j = evaluation.judgments(spark, write(tmp_path / "judgments.json", judged))
    assert j.collect() == [("q1", "crossref:10.1/x", "Yoga for knees")]
    ranked = r.papers.select("qid", F.lit("ranked").alias("system"), "rank", "source_ids")
    m = evaluate.retrieval_metrics(ranked, j).collect()
    assert [(x["qid"], x["recall_5"], x["mrr"]) for x in m] == [("q1", 1.0, 1.0)] and evaluate.unretrieved(ranked, j).isEmpty()
    r.release()


def test_questions_and_gold(spark, tmp_path):
    """Lists in one file or a line each, in one file or several; null and absent fields are null."""
    q = [{"id": "q1", "question": "One?"}, {"id": "q2", "question": None}]
    assert sorted(map(tuple, evaluation.questions(spark, write(tmp_path / "q.json", q)).collect())) == [("q1", "One?"), ("q2", None)]
    assert sorted(map(tuple, evaluation.questions(spark, write(tmp_path / "q.jsonl", q, lines=True), lines=True).collect())) == [("q1", "One?"), ("q2", None)]
    (tmp_path / "gold").mkdir()
    one = {"id": "p1", "study_design": None, "participants": 34, "studies": None, "population": ["adults"], "statistics": ["p < 0.05"], "limitations_stated": True, "notes": "n"}
    write(tmp_path / "gold/a.json", {"how_this_was_made": "…", "papers": [one]})
    write(tmp_path / "gold/b.json", {"papers": [{**one, "id": "p2", "participants": None}]})
    g = {r["paper_id"]: r for r in evaluation.gold(spark, (tmp_path / "gold").as_uri()).collect()}
    assert sorted(g) == ["p1", "p2"] and g["p1"]["participants"] == 34 and g["p1"]["population"] == ["adults"] and g["p1"]["outcomes"] is None and g["p2"]["participants"] is None
    assert evaluation.questions(spark, write(tmp_path / "none.json", [])).count() == 0


@pytest.mark.parametrize("text", ['{"questions": {"q1": {"relevant": [', '{"questions": ["q1"]}'])
def test_data_of_another_form_raises(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        evaluation.judgments(spark, (tmp_path / "bad.json").as_uri()).collect()
