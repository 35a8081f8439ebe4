import json
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillion.config import Settings
from quillion.operators import evidence
from quillion.plans.fanout import at_once
from quillion.plans.research import research
from quillion.schemas import PAPER
from quillion.sources import crossref, pubmed, snapshot
from quillion.sources.base import Source, united


def works(spark, items, qid="q", **top):
    return spark.createDataFrame([(qid, json.dumps({"status": "ok", "message": {"items": items}, **top}))], "qid string, payload string")


WORK = {"DOI": "doi:10.77/Knee-9", "title": ["Walking <b>barefoot</b> &lt;daily&gt; &amp; knees"], "container-title": ["Gait &amp; Feet"], "author": [{"given": "Noor", "family": "Haddad"}, {"family": "Osei"}, {"name": "Walkers' Union"}, 7, {"given": None}], "issued": {"date-parts": [[2019, 11, 2]]}, "URL": "https://x.org/1", "abstract": "<jats:title>Abstract</jats:title><jats:sec><jats:title>Aims</jats:title><jats:p>Who &lt;p&gt;walks  far?</jats:p></jats:sec><jats:p>n &gt; 30</jats:p>"}


def test_work_is_read(spark):
    r = crossref.parse(works(spark, [WORK])).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["id"], r["title"], r["journal"], r["publication_date"], r["url"]) == ("crossref:10.77/Knee-9", "Walking barefoot <daily> & knees", "Gait & Feet", "2019-11-02", "https://x.org/1")
    assert r["authors"] == ["Noor Haddad", "Osei", "Walkers' Union"] and r["source_ids"] == ["crossref:10.77/Knee-9"]
    assert r["abstract"] == "Aims: Who walks far?\nn > 30"


def test_bad_works_cost_no_other(spark):
    items = [5, None, "x", {"DOI": 5, "title": ["t"]}, {"DOI": "10.1/a"}, {"DOI": "10.1/b", "title": "bare"}, {"DOI": "10.1/c", "title": [None, " ", "second"], "author": "no", "issued": {"date-parts": [["2024"]]}, "URL": "javascript:x", "abstract": 3}]
    got = {r["doi"]: r for r in crossref.parse(works(spark, items)).collect()}
    assert {k: v["title"] for k, v in got.items()} == {"10.1/b": "bare", "10.1/c": "second"}
    c = got["10.1/c"]
    assert (c["authors"], c["publication_date"], c["url"], c["abstract"]) == ([], None, None, None)


@pytest.mark.parametrize("parts, date", [([[2024]], "2024"), ([[2024, 13]], "2024"), ([[2024, 2, 40]], "2024-02"), ([[None]], None), ([[True]], None), ([[999]], None), ([], None), ([[2024, 3.0]], "2024"), ("x", None)])
def test_dates_claim_no_more_than_given(spark, parts, date):
    r = crossref.parse(works(spark, [{"DOI": "10.1/a", "title": ["t"], "issued": {"date-parts": parts}}])).collect()[0]
    assert r["publication_date"] == date


def test_other_date_fields_follow_in_order(spark):
    w = {"DOI": "10.1/a", "title": ["t"], "issued": {"date-parts": [[None]]}, "published-online": {"date-parts": [[2020]]}, "published-print": {"date-parts": [[2021, 5]]}, "created": {"date-parts": [[1999]]}}
    assert crossref.parse(works(spark, [w])).collect()[0]["publication_date"] == "2021-05"


@pytest.mark.parametrize("payload", ["[]", "{}", '{"status": "error", "message": {"items": []}}', '{"status": "ok", "message": {"items": {}}}', "not json", '{"status": "ok", "message": 4}'])
def test_replies_that_are_no_listings(spark, payload):
    df = spark.createDataFrame([("q", payload)], "qid string, payload string")
    assert crossref.rejected(df).count() == 1 and crossref.parse(df).count() == 0


def article(pmid="7", title="A <i>mixed</i>  title", extra="", date="<Year>2024</Year><Month>Mar</Month><Day>5</Day>", ids='<ArticleId IdType="doi">10.1/own</ArticleId>'):
    return f"""<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><MedlineJournalInfo><MedlineTA>Short J</MedlineTA></MedlineJournalInfo><Article><Journal><JournalIssue><PubDate>{date}</PubDate></JournalIssue></Journal>
    <ArticleTitle>{title}</ArticleTitle><Abstract><AbstractText Label="AIM">To <b>see</b>.</AbstractText><AbstractText> </AbstractText><AbstractText>Plain.</AbstractText></Abstract>
    <AuthorList><Author><LastName>B</LastName><Initials>A</Initials></Author><Author><CollectiveName>Team</CollectiveName></Author><Author><ForeName>X</ForeName></Author></AuthorList>{extra}</Article></MedlineCitation>
    <PubmedData><ArticleIdList>{ids}</ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType="doi">10.9/ref</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle>"""


def fetched(spark, *articles, qid="q"):
    return spark.createDataFrame([(qid, f"<PubmedArticleSet>{''.join(articles)}</PubmedArticleSet>")], "qid string, payload string")


def test_article_is_read(spark):
    r = pubmed.parse(fetched(spark, article())).collect()[0]
    assert (r["id"], r["title"], r["journal"], r["publication_date"], r["doi"]) == ("pubmed:7", "A mixed title", "Short J", "2024-03-05", "10.1/own")
    assert r["authors"] == ["A B", "Team"] and r["abstract"] == "AIM: To see.\nPlain." and r["url"].endswith("/7/")


@pytest.mark.parametrize("date, want", [("<Year>2024</Year>", "2024"), ("<Year>2024</Year><Month>Spring</Month>", "2024"), ("<Year>2024</Year><Month>13</Month>", "2024"), ("<Year>2024</Year><Month>04</Month><Day>x</Day>", "2024-04"), ("<MedlineDate>2019 Jan-Feb</MedlineDate>", "2019"), ("<Year>24</Year>", None), ("", None)])
def test_article_dates(spark, date, want):
    assert pubmed.parse(fetched(spark, article(date=date))).collect()[0]["publication_date"] == want


def test_doi_locations_and_skipped_articles(spark):
    ok = article("1", ids="", extra='<ELocationID EIdType="doi" ValidYN="N">10.1/bad</ELocationID><ELocationID EIdType="doi">doi:10.1/loc</ELocationID>')
    got = {r["source_id"]: r["doi"] for r in pubmed.parse(fetched(spark, ok, article("2", ids=""), article("", "x"), article("3", ""), "<PubmedBookArticle/>")).collect()}
    assert got == {"1": "10.1/loc", "2": None}


@pytest.mark.parametrize("xml", ["<a><b></a>", "", "plain", '<!DOCTYPE a [<!ENTITY x "y">]><PubmedArticleSet>&x;</PubmedArticleSet>'])
def test_xml_that_is_refused(xml):
    assert pubmed.raw_articles(xml) is None


def test_search_keeps_the_order_of_ids(spark):
    ids = spark.createDataFrame([("q", json.dumps({"esearchresult": {"idlist": ["3", "1", "9", "2"]}}))], "qid string, payload string")
    s = pubmed.PubMed(ids, fetched(spark, article("1"), article("2"), article("3")), most=20)
    got = sorted(((r["pos"], r["source_id"], r["provider_ranks"]) for r in s.search(spark.createDataFrame([("q",)], "qid string")).collect()), key=lambda x: x[0])
    assert got == [(1, "3", {"pubmed": 1}), (2, "1", {"pubmed": 2}), (3, "2", {"pubmed": 3})]


@pytest.mark.parametrize("payload, message", [('{"esearchresult": {"ERROR": "x"}}', "search request was rejected"), ("{}", "unexpected search response"), ('{"esearchresult": {"idlist": 4}}', "unexpected search response")])
def test_rejected_searches(spark, payload, message):
    """A rejected question has an error of its own and costs no other question its records."""
    good = json.dumps({"esearchresult": {"idlist": ["7"]}})
    s = pubmed.PubMed(spark.createDataFrame([("bad", payload), ("q", good)], "qid string, payload string"), fetched(spark, article("7")))
    q = spark.createDataFrame([("q",), ("bad",)], "qid string")
    assert [(r["qid"], r["source_id"]) for r in s.search(q).collect()] == [("q", "7")]
    assert [tuple(r) for r in s.failures(q).collect()] == [("bad", message)]


class Broken(Source):
    name = "broken"

    def search(self, questions):
        raise ValueError("secret detail")


class Late(Source):
    """Fails when its records are computed, not when they are asked for."""

    name = "late"

    def __init__(self, parts):
        self.parts = parts

    def search(self, questions):
        return self.parts.withColumn("title", F.raise_error(F.lit("secret detail")).cast("string"))


def test_research_without_sources(spark):
    r = research(spark.createDataFrame([("q", "Does yoga help?")], "qid string, question string"), [])
    assert r.papers.count() == r.evidence.count() == r.provider_status.count() == r.codes.count() == 0
    assert [tuple(x) for x in r.counts.collect()] == [("q", 0, 0, 0)]


def test_failures_stay_with_their_question_and_source(spark):
    q = spark.createDataFrame([("a", "Does yoga help knees?"), ("b", "Does rest help?")], "qid string, question string")
    ids = spark.createDataFrame([("a", json.dumps({"esearchresult": {"idlist": ["7", "7"]}})), ("b", "{}")], "qid string, payload string")
    pm = pubmed.PubMed(ids, fetched(spark, article("7"), qid="a"))
    cr = crossref.Crossref(works(spark, [WORK], "a").unionByName(works(spark, [WORK], "b")))
    r = research(q, [pm, Late(cr.search(q)), cr])
    got = {(s["qid"], s["provider"]): (s["status"], s["paper_count"], s["error"]) for s in r.provider_status.collect()}
    assert got == {
        ("a", "pubmed"): ("ok", 2, None), ("b", "pubmed"): ("error", 0, "unexpected search response"), ("a", "late"): ("error", 0, "unexpected error"), ("b", "late"): ("error", 0, "unexpected error"),
        ("a", "crossref"): ("ok", 1, None), ("b", "crossref"): ("ok", 1, None),
    }
    assert {x["qid"]: x["code"] for x in r.codes.collect()} == {"a": 200, "b": 200}
    assert {x["qid"]: tuple(x)[1:] for x in r.counts.collect()} == {"a": (3, 2, 1), "b": (1, 1, 0)}
    r.release()
    slow = research(q, [cr], settings=Settings(provider_timeout=1e-6))
    assert {s["error"] for s in slow.provider_status.collect()} == {"exceeded time budget"} and slow.papers.count() == 0


def test_order_is_unique_over_questions(spark):
    p = None
    for k in range(3):
        x = works(spark, [{**WORK, "DOI": f"10.1/{i}"} for i in range(4)], f"q{k}")
        p = x if p is None else p.unionByName(x)
    rows = united([crossref.Crossref(p).search(spark.createDataFrame([(f"q{k}",) for k in range(3)], "qid string"))]).collect()
    assert sorted(r["ord"] for r in rows) == list(range(1, 13))
    assert all([r["source_id"] for r in sorted(rows, key=lambda r: r["ord"]) if r["qid"] == f"q{k}"] == [f"10.1/{i}" for i in range(4)] for k in range(3))


def test_works_are_filtered_and_projected(spark, tmp_path):
    path = str(tmp_path / "works")
    spark.createDataFrame([("q", i, "journal-article" if i % 2 else "book", f"10.1/{i}", ["A title"], "unread") for i in range(10)], "qid string, pos int, type string, DOI string, title array<string>, other string").write.parquet(path)
    replies = crossref.works(spark.read.parquet(path), rows=3)
    plan = replies._jdf.queryExecution().toString()
    assert "EqualTo(type,journal-article)" in plan and "other" not in plan.split("ReadSchema")[1]
    assert [r["source_id"] for r in crossref.parse(replies).orderBy("pos").collect()] == ["10.1/1", "10.1/3", "10.1/5"]


def test_research_end_to_end(spark):
    q = spark.createDataFrame([("q", "Does a mixed title help?"), ("z", "What is it?")], "qid string, question string")
    ids = spark.createDataFrame([("q", json.dumps({"esearchresult": {"idlist": ["7", "8"]}}))], "qid string, payload string")
    pm = pubmed.PubMed(ids, fetched(spark, article("7"), article("8", "Other", ids="")))
    cr = crossref.Crossref(works(spark, [{**WORK, "DOI": "10.1/OWN"}, {**WORK, "DOI": "10.1/else"}]))
    r = research(q, [pm, cr, Broken()])
    papers = sorted(r.papers.collect(), key=lambda p: p["rank"])
    assert papers[0]["id"] == "pubmed:7" and papers[0]["source_ids"] == ["pubmed:7", "crossref:10.1/OWN"] and papers[0]["provider_ranks"] == {"pubmed": 1, "crossref": 1}
    assert len(papers) == 3
    status = {s["provider"]: (s["status"], s["paper_count"], s["error"]) for s in r.provider_status.collect()}
    assert status == {"pubmed": ("ok", 2, None), "crossref": ("ok", 2, None), "broken": ("error", 0, "unexpected error")}
    body = {x["qid"]: (x["code"], x["body"]) for x in snapshot.envelopes(r.questions, r.papers, r.evidence, r.provider_status, r.codes).collect()}
    assert body["q"][0] == 200 and body["z"] == (422, None)
    reply = json.loads(body["q"][1])
    assert [p["id"] for p in reply["papers"]] == [p["id"] for p in papers] and set(reply["evidence"]) == {p["id"] for p in papers}
    failed = research(q.where("qid = 'q'"), [Broken()])
    assert [c["code"] for c in failed.codes.collect()] == [502] and failed.papers.count() == 0


def test_snapshot_round_trip_and_last_wins(spark, tmp_path):
    q = spark.createDataFrame([("q",)], "qid string")
    p = united([crossref.Crossref(works(spark, [WORK])).search(q)])
    snapshot.write(p, str(tmp_path / "s"))
    back = snapshot.load(spark, str(tmp_path / "s"))
    assert back.collect() == p.collect()
    twice = back.unionByName(back.selectExpr("ord + 1 as ord", *[f"'new' as {c}" if c == "title" else c for c in back.columns if c != "ord"]))
    assert [r["title"] for r in snapshot.last_wins(twice).collect()] == ["new"]


def test_settings():
    s = Settings.from_env(env={"QUILLION_PUBMED_LIMIT": "5", "QUILLION_PUBMED_API_KEY": " ", "QUILLION_CONTACT_EMAIL": "a@b.org"})
    assert (s.pubmed_limit, s.pubmed_api_key, s.rates) == (5, None, {"pubmed": 3, "crossref": 3})
    for bad in ({"pubmed_limit": 0}, {"crossref_limit": 101}, {"provider_timeout": 0}, {"contact_email": "nobody"}):
        with pytest.raises(ValueError):
            Settings(**bad)


class Sleeper(Source):
    """Answers as ``inner`` does, after ``seconds`` in a task."""

    def __init__(self, name, inner, seconds):
        self.name, self.inner, self.seconds = name, inner, seconds

    def search(self, questions):
        def wait(batches, seconds=self.seconds):
            import time

            for b in batches:
                time.sleep(seconds if b.num_rows else 0)
                yield b

        return self.inner.search(questions.coalesce(1).mapInArrow(wait, questions.schema))


def test_sources_answer_at_the_same_time(spark):
    """Three sources of four seconds overlap; rows and order are those of one after the other."""
    q = spark.createDataFrame([("q", "Does yoga help knees?")], "qid string, question string")
    inner = [crossref.Crossref(works(spark, [{**WORK, "DOI": f"10.1/{k}"}])) for k in range(3)]
    slow = [Sleeper(f"s{k}", c, 4) for k, c in enumerate(inner)]
    began = time.monotonic()
    out = at_once(spark, [(s.name, lambda s=s: s.search(q).collect(), None) for s in slow])
    assert time.monotonic() - began < 0.6 * sum(o.seconds for o in out) and [o.value[0]["source_id"] for o in out] == ["10.1/0", "10.1/1", "10.1/2"]
    plain, r = research(q, inner, with_evidence=False), research(q, slow, with_evidence=False)
    rows = lambda x: [(p["id"], p["rank"], p["ord"]) for p in x.papers.orderBy("rank").collect()]
    assert rows(r) == rows(plain) and len(rows(r)) == 3
    r.release()
    plain.release()


def test_a_source_over_its_budget_is_stopped(spark):
    """Its task ends, it is in error, its files go; another source's records stay."""
    q = spark.createDataFrame([("q", "Does yoga help knees?")], "qid string, question string")
    cr = crossref.Crossref(works(spark, [WORK]))
    cr.name = "quick"
    began = time.monotonic()
    out = at_once(spark, [("slow", lambda: Sleeper("slow", cr, 60).search(q).collect(), 3.0), ("quick", lambda: cr.search(q).collect(), 3000.0)])
    assert time.monotonic() - began < 4.5 or out[1].seconds > 3
    assert out[0].stopped and out[0].value is None and not out[1].stopped and len(out[1].value) == 1
    end = time.monotonic() + 5
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.monotonic() < end:
        time.sleep(0.1)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    r = research(q, [Sleeper("slow", cr, 60), cr], with_evidence=False, settings=Settings(provider_timeout=12))
    got = {s["provider"]: (s["status"], s["error"]) for s in r.provider_status.collect()}
    assert got == {"slow": ("error", "exceeded time budget"), "quick": ("ok", None)}
    assert r.papers.count() == 1 and not any("source-slow" in p for p in r.paths)


def test_one_pass_gives_records_and_unreadable_replies(spark):
    ids = spark.createDataFrame([(k, json.dumps({"esearchresult": {"idlist": ["2", "1"]}})) for k in ("a", "b")], "qid string, payload string")
    pm = pubmed.PubMed.of(ids, fetched(spark, article("1"), article("2"), qid="a").unionByName(spark.createDataFrame([("b", "<broken")], "qid string, payload string")), Settings(pubmed_limit=1))
    q = spark.createDataFrame([("a",), ("b",)], "qid string")
    rows = sorted((r["qid"], r["source_id"], r["pos"], r["error"]) for r in pm.answers(q).collect())
    assert rows == [("a", "2", 1, None), ("b", None, None, "unreadable article response")]
    assert pm.answers(q)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_snapshot_of_many_questions_is_few_files(spark, tmp_path):
    """2,000 questions and one of a third of all rows: files by hash, a question's read prunes to its bucket, equal rows come back."""
    path = str(tmp_path / "s")
    ids = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("q"), (F.col("id") % 2000).cast("string"))).alias("qid"), F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, "pubmed").otherwise("crossref").alias("source"))
    empty = spark.createDataFrame([], PAPER)
    p = ids.select(*[F.col(f.name) if f.name in ids.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PAPER])
    snapshot.write(p, path, buckets=16)
    files = [f for f in (tmp_path / "s").rglob("*.parquet")]
    assert len(files) <= 16 * snapshot.FILES and max(f.stat().st_size for f in files) < 0.2 * sum(f.stat().st_size for f in files)
    whole = snapshot.load(spark, path, buckets=16)
    assert sorted((r["ord"], r["qid"], r["source"]) for r in whole.collect()) == sorted((r["ord"], r["qid"], r["source"]) for r in p.collect())
    one = snapshot.load(spark, path, qids=["q7"], buckets=16)
    assert sorted(r["ord"] for r in one.collect()) == [k for k in range(6000) if k % 3 and k % 2000 == 7]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and re.search(r"PushedFilters: \[[^]]*qid", plan)
    q = spark.createDataFrame([("q7",), ("hot",), ("none",)], "qid string")
    got = snapshot.Snapshot(spark, path, "pubmed", buckets=16).search(q)
    assert sorted(r["ord"] for r in got.collect()) == [k for k in range(0, 6000, 2) if k % 3 == 0 or k % 2000 == 7]
    snapshot.write(empty, str(tmp_path / "e"))
    assert snapshot.load(spark, str(tmp_path / "e")).count() == 0


def test_large_files_of_articles_are_read_in_splits(spark, tmp_path):
    """One file over many tasks gives the rows of parsing it whole; broken articles cost no other, files with entities are refused."""
    many = [article(str(k), f"Title {k} &lt;b&gt; é" + "x" * (k % 90)) for k in range(800)]
    (tmp_path / "big.xml").write_text('<?xml version="1.0"?>\n<!DOCTYPE PubmedArticleSet PUBLIC "-//NLM" "x.dtd">\n<PubmedArticleSet>\n' + "\n".join(many) + "\n<PubmedBookArticle><a/></PubmedBookArticle></PubmedArticleSet>")
    size = (tmp_path / "big.xml").stat().st_size
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 9))
    try:
        got = pubmed.read_files(spark, (tmp_path / "big.xml").as_uri())
        assert got.rdd.getNumPartitions() >= 9
        rows = sorted(got.collect(), key=lambda r: (r["block"], r["at"]))
        whole = sorted(pubmed.parse(fetched(spark, *many)).collect(), key=lambda r: r["pos"])
        same = [c for c in rows[0].asDict() if c in whole[0].asDict() and c not in ("qid", "pos")]
        assert [tuple(r[c] for c in same) for r in rows] == [tuple(r[c] for c in same) for r in whole] and len(same) > 9
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "two").mkdir()
    (tmp_path / "two/bad.xml").write_text("<PubmedArticleSet>" + article("1") + "<PubmedArticle><MedlineCitation><PMID>2</PMI></PubmedArticle>" + article("3") + "<PubmedArticle><cut")
    (tmp_path / "two/evil.xml").write_text('<!DOCTYPE x [<!ENTITY a "b">]><PubmedArticleSet>' + article("4") + article("5") + "</PubmedArticleSet>")
    (tmp_path / "two/none.xml").write_text("")
    got = pubmed.read_files(spark, str(tmp_path / "two"))
    assert sorted((r["file"].rsplit("/", 1)[1], r["source_id"] or "", r["error"] or "") for r in got.collect()) == [("bad.xml", "", "unreadable article response")] * 2 + [("bad.xml", "1", ""), ("bad.xml", "3", ""), ("evil.xml", "", "the document declares entities")]


def test_evidence_of_another_paper_is_left_out(spark):
    q = spark.createDataFrame([("q", "Does yoga help knees?")], "qid string, question string")
    cr = crossref.Crossref(works(spark, [{**WORK, "DOI": "10.1/a"}, {**WORK, "DOI": "10.1/b", "title": ["Other"]}]))

    def wrong(papers, keep):
        e = evidence.extract(papers, keep)
        return e.withColumn("paper_id", F.when(F.col("paper_id") == "crossref:10.1/b", "crossref:10.1/none").otherwise(F.col("paper_id")))

    r = research(q, [cr], extractor=wrong)
    assert r.papers.count() == 2 and [e["paper_id"] for e in r.evidence.collect()] == ["crossref:10.1/a"]
    r.release()


def test_few_replies_are_open_at_a_time_whatever_a_batch_holds(spark):
    xml = "<PubmedArticleSet>" + "<PubmedArticle><MedlineCitation><PMID>{0}</PMID><Article><ArticleTitle>T {0}</ArticleTitle></Article></MedlineCitation></PubmedArticle>" + "</PubmedArticleSet>"
    size = len(xml.format(10))
    payloads = pa.array([xml.format(k) for k in range(10, 17)] + [None, "x" * (5 * size), ""])
    cut = list(pubmed.portions(payloads, 3 * size))
    assert cut == [(0, 3), (3, 3), (6, 2), (8, 1), (9, 1)] and list(pubmed.portions(pa.array([], pa.string()))) == []
    assert [n for n, _ in pubmed.portions(pa.array([None, "y" * 9, "z"]), 5)] == [0, 1, 2]
    rows = [(str(k), xml.format(k)) for k in range(50)] + [("bad", "<x"), ("none", None)]
    replies = spark.createDataFrame(rows, "qid string, payload string").coalesce(1)
    assert sorted(r["source_id"] for r in pubmed.parse(replies).collect()) == sorted(str(k) for k in range(50))
    assert {r["qid"] for r in pubmed.parsed(replies).where("error is not null").collect()} == {"bad", "none"}
