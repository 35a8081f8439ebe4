import json

from quillion.config import Settings
from quillion.plans.research import research
from quillion.sources import recorded


def exchange(qid, provider, endpoint, body, status="200", attempt=0, retry_after=None):
    return json.dumps({"qid": qid, "provider": provider, "endpoint": endpoint, "attempt": attempt, "status": status, "retry_after": retry_after, "body": body})


def ids(*pmids):
    return json.dumps({"esearchresult": {"idlist": list(pmids)}})


def fetched(*pmids):
    article = "<PubmedArticle><MedlineCitation><PMID>{0}</PMID><Article><ArticleTitle>Title {0} ü</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    return "<PubmedArticleSet>" + "".join(article.format(p) for p in pmids) + "</PubmedArticleSet>"


def work(*dois):
    return json.dumps({"status": "ok", "message": {"items": [{"DOI": d, "title": [f"Work {d}"]} for d in dois]}})


LINES = [
    exchange("a", "pubmed", "esearch", ids("3", "1", "2")), exchange("a", "pubmed", "efetch", fetched("1", "2", "3")), exchange("a", "crossref", "works", work("10.1/a")),
    exchange("b", "pubmed", "esearch", None, "503"), exchange("b", "pubmed", "esearch", ids("5"), attempt=1), exchange("b", "pubmed", "efetch", fetched("5")), exchange("b", "crossref", "works", None, "503"),
    exchange("b", "crossref", "works", None, "503", 1), exchange("c", "pubmed", "esearch", json.dumps({"esearchresult": {"ERROR": "no"}})), exchange("c", "crossref", "works", "[]"),
    exchange("d", "pubmed", "esearch", ids("1")), exchange("d", "pubmed", "efetch", "<broken"), exchange("d", "crossref", "works", None, "timeout"), "", "no json", "[1]", exchange("e", "pubmed", "esearch", None, "404"),
]


def folder(tmp_path, lines=LINES):
    for k in range(2):
        (tmp_path / f"part-{k}.json").write_text("\n".join(lines[k::2]) + "\n" * k)
    (tmp_path / "_SUCCESS").write_text("")
    return str(tmp_path)


def test_every_line_is_read_once_whatever_the_ranges(spark, tmp_path):
    path = folder(tmp_path)
    want = sorted(str(json.loads(x)["qid"]) for x in LINES if x.startswith("{"))
    for size in (1, 7, 64, 300, 1 << 20):
        parts = recorded.Reader(path, size).partitions()
        got = [r["qid"] for p in parts for b in recorded.Reader(path, size).read(p) for r in b.to_pylist()]
        assert sorted(got) == want
    df = recorded.read(spark, path, 300)
    assert sorted(r["qid"] for r in df.collect()) == want and df.rdd.getNumPartitions() > 4
    assert recorded.read(spark, (tmp_path / "part-0.json").as_uri()).count() == sum(x.startswith("{") for x in LINES[::2])
    (tmp_path / "none").mkdir()
    assert recorded.read(spark, str(tmp_path / "none")).count() == 0


def test_wanted_keys_are_chosen_by_the_reader(spark, tmp_path):
    path = folder(tmp_path)
    some = recorded.read(spark, path, endpoint="efetch", qid="a,d")
    assert sorted(r["qid"] for r in some.collect()) == ["a", "d"]
    every = recorded.read(spark, path)
    one, two = every.where("endpoint = 'works'"), every.where("endpoint = 'efetch'")
    assert (one.unionByName(two).count(), one.count(), two.count(), every.count()) == (8, 5, 3, 14)


def test_recorded_sources_answer_in_id_order_with_errors_of_their_own(spark, tmp_path):
    path = folder(tmp_path)
    q = spark.createDataFrame([(k, f"Does thing {k} help?") for k in "abcde"], "qid string, question string")
    pm, cr = recorded.RecordedPubMed(spark, path, Settings(pubmed_limit=2)), recorded.RecordedCrossref(spark, path)
    got = sorted((r["qid"], r["pos"], r["source_id"], r["error"]) for r in pm.answers(q).collect() if r["error"] is None)
    assert got == [("a", 1, "3", None), ("a", 2, "1", None), ("b", 1, "5", None)]
    r = research(q, [pm, cr], with_evidence=False)
    status = {(s["qid"], s["provider"]): (s["status"], s["paper_count"], s["error"]) for s in r.provider_status.collect()}
    assert status == {
        ("a", "pubmed"): ("ok", 2, None), ("b", "pubmed"): ("ok", 1, None), ("c", "pubmed"): ("error", 0, "search request was rejected"), ("d", "pubmed"): ("error", 0, "unreadable article response"),
        ("e", "pubmed"): ("error", 0, "HTTP 404"), ("a", "crossref"): ("ok", 1, None), ("b", "crossref"): ("error", 0, "HTTP 503 after retry"), ("c", "crossref"): ("error", 0, "unexpected search response"),
        ("d", "crossref"): ("error", 0, "request timed out"), ("e", "crossref"): ("ok", 0, None),
    }
    assert {c["qid"]: c["code"] for c in r.codes.collect()} == {"a": 200, "b": 200, "c": 502, "d": 502, "e": 200}
    r.release()
