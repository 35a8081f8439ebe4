import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillion.functions import text
from quillion.operators import index, query, ranking

QUESTIONS = [
    ("Does yoga help back pain?", "yoga help back pain"),
    ("what does the WHO say about IT workers", "WHO say IT workers"),
    ("WHAT IS IT ABOUT YOGA", "YOGA"),
    ("A vitamin", "vitamin"),
    ("is vitamin A safe", "vitamin A safe"),
    ("yoga OR pilates NOT running AND walking", "yoga or pilates not running walking"),
    ("Parkinson’s and COVID-19?", "Parkinson's COVID-19"),
    ("ｙｏｇａ for sleep", "yoga sleep"),
    ("What is it?", None),
    ("???", None),
    (None, None),
]


def test_search_queries(spark):
    df = spark.createDataFrame(list(enumerate(q for q, _ in QUESTIONS)), "qid int, question string")
    got = {r["qid"]: (r["search_query"], r["valid"]) for r in query.process(df).collect()}
    assert [got[i][0] for i in range(len(QUESTIONS))] == [e for _, e in QUESTIONS]
    assert all(got[i][1] == (e is not None) for i, (_, e) in enumerate(QUESTIONS))


def test_question_length_counts_after_trimming(spark):
    df = spark.createDataFrame([("  ab  ",), ("abc",), ("x" * 1001,)], "question string")
    assert sorted(r["valid"] for r in query.process(df).collect()) == [False, False, True]


def test_whole_turns_are_questions(spark, tmp_path):
    from quillion.queries import query_terms

    long = [" ".join(f"word{k}" for k in range(n)) for n in (60, 120, 300)]
    rows = [(k, 0, "user", t) for k, t in enumerate([*long, "x" * 1000, " " + "x" * 1000 + "\n", "x" * 1001, "yoga " * 100 + "sleep"])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in query_terms(spark, str(tmp_path)).collect()}
    # terms behind character 400, uncut, and the limit of 1000 characters after trimming
    for k, t in enumerate(long):
        assert got[k]["search_query"] == t and set(got[k]["terms"].split(",")) == set(t.split())
    assert [got[k]["valid"] for k in range(len(rows))] == [True, True, False, True, True, False, True]
    assert got[6]["terms"] == "sleep,yoga"


WORDS = [("Injuries and patients", ["injury", "and", "patient"]), ("Diabetes mellitus, stress", ["diabete", "mellitus", "stress"]), ("type 2 x é", ["type", "2"]), ("Überblick café ²", ["uberblick", "cafe", "2"]), ("", []), (None, [])]


@pytest.mark.parametrize("given_text, expected", WORDS)
def test_words(spark, given_text, expected):
    df = spark.createDataFrame([(given_text,)], "t string").withColumn("w", text.words(F.col("t")))
    assert df.collect()[0]["w"] == expected


@given(st.lists(st.text(max_size=12), min_size=1, max_size=30))
def test_fold_table_agrees_with_unicode(texts):
    table = str.maketrans(text._FOLD_FROM, text._FOLD_TO)
    for t in texts:
        if all(ord(c) in text._SIMPLE for c in t):
            want = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
            assert t.translate(table) == want


def test_scores_and_order(spark):
    q = spark.createDataFrame([("q", "yoga pain")], "qid string, search_query string")
    rows = [
        ("a", "Yoga for pain", None, "2020"), ("b", "Yoga", "pain pain pain pain", "2021"), ("c", "Other", "yoga pain yoga pain yoga pain", None), ("d", "Yoga for pain", "x", "2019"),
        ("e", "Nothing", "", "2024-13x"), ("f", "Nothing", "z", "2023-05"), ("g", "Nothing", "z", "2023-05-01"), ("h", "Nothing", "z", "bad"),
    ]
    p = spark.createDataFrame([("q", *r) for r in rows], "qid string, id string, title string, abstract string, publication_date string")
    for parts in (1, 3, 7):
        r = ranking.ranked(ranking.scored(p.repartition(parts), q)).orderBy("rank").collect()
        assert [x["id"] for x in r] == ["d", "a", "b", "c", "g", "f", "h", "e"]
    assert {x["id"]: x["rank_score"] for x in r} == {"a": 0.75, "d": 0.75, "b": 0.5, "c": 0.25, "e": 0.0, "f": 0.0, "g": 0.0, "h": 0.0}


def test_score_rounds_half_to_even_and_needs_terms(spark):
    q = spark.createDataFrame([("q", " ".join(f"w{i:02d}" for i in range(32))), ("n", "the of")], "qid string, search_query string")
    p = spark.createDataFrame([("q", "a", "none", "w00 w00 w00"), ("n", "b", "the", "of")], "qid string, id string, title string, abstract string")
    got = {r["qid"]: r["rank_score"] for r in ranking.scored(p, q).collect()}
    assert got == {"q": 0.007812, "n": 0.0}


@pytest.mark.parametrize("date, key", [("2024", (2024, 0, 0)), ("2024-03", (2024, 3, 0)), ("2024-03-15", (2024, 3, 15)), ("2024-x", (0, 0, 0)), (None, (0, 0, 0)), ("", (0, 0, 0))])
def test_date_key(spark, date, key):
    df = spark.createDataFrame([(date,)], "d string")
    assert tuple(df.select(ranking.date_key(F.col("d")).alias("k")).collect()[0]["k"]) == key


def test_index_gives_the_rows_of_a_scan(spark):
    """Frequent and rare terms, ties, no abstracts, no terms, fewer hits than asked for, an empty table; every k, both scopes."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    pick = lambda n: " ".join(rng.choices(words, weights=[60, 40, 20, 9, 5, 4, 3, 2, 1, 1, 0.3, 0.3], k=n))
    rows = [(k, f"s{k % 2}", f"p{k}", pick(rng.randint(0, 4)), pick(rng.randint(0, 9)) if k % 5 else None, rng.choice(["2020", "2021-03", "", None, "2021-03-09"])) for k in range(400)]
    papers = spark.createDataFrame(rows, "ord long, qid string, id string, title string, abstract string, publication_date string")
    asked = [("s0", "w0"), ("s1", "w0 w1 w2"), ("s0", "w11 w10 w9"), ("s1", "nothing"), ("s0", None), ("s1", "w3 w0 w11 w1"), ("s0", "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    for scoped in (False, True):
        q = spark.createDataFrame([(s if scoped and k < 2 else f"q{k}", s, t) for k, (s, t) in enumerate(asked)][: 2 if scoped else None], "qid string, s string, search_query string")
        i = index.build(papers, "qid" if scoped else None)
        own = q.select("qid", "search_query")
        whole = papers if scoped else papers.drop("qid").join(q.select("qid"))
        want = ranking.ranked(ranking.scored(whole, own)).select("qid", "rank", "ord", "rank_score").collect()
        for k in (1, 5, 30):
            got = index.top(i, q, k, "s" if scoped else None).select("qid", "rank", "ord", "rank_score").collect()
            assert sorted(got) == sorted(r for r in want if r["rank"] <= k)
        i.release()
    none = index.build(papers.limit(0))
    assert index.top(none, q, 3).count() == 0


def test_index_reads_only_what_may_lead(spark):
    """A term that most papers have brings up none where a rarer one suffices, and only its best postings where it stands alone."""
    rows = [(k, f"p{k}", "common" if k % 2 else "other", "common rare common common" if k % 50 == 1 else "common", "2020") for k in range(1000)]
    i = index.build(spark.createDataFrame(rows, "ord long, id string, title string, abstract string, publication_date string"))
    q = spark.createDataFrame([("a", "", ["common"]), ("b", "", ["common", "rare"])], "qid string, scope string, terms array<string>")
    got = {(r["qid"], r["term"]): (r["floor"], r["least"], r["leads"]) for r in index.needs(i.levels, q, 5).collect()}
    assert got == {("a", "common"): (12, 12, True), ("b", "common"): (12, 11, True), ("b", "rare"): (12, 1, True)}
    i.release()


def test_entities_cut_off_stay_as_sql_leaves_them(spark, tmp_path):
    from quillion.queries import strip_tags

    pages = [(1, "<title>a &amp;&amp</title><style>p{}</style>&copy; &copyright; &ampx;"), (2, "&#65;&#x42;&#67 &amp;quot;"), (3, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["plain"] for r in strip_tags(spark, str(tmp_path)).collect()}
    assert got == {1: "a &&ampp{}© &copyright; &ampx;", 2: "AB&#67 &quot;", 3: None}
    # the operator itself decodes as browsers do, unless asked
    assert spark.range(1).select(text.plain_texts(F.array(F.lit("x &ampp"))).alias("t")).collect()[0]["t"] == ["x &p"]


def test_index_makes_no_row_for_papers_that_are_not_among_the_first(spark, monkeypatch):
    """Every question shares a term with every paper: blocks return k rows a question, whatever their number."""
    monkeypatch.setattr(index, "BLOCK", 40)
    monkeypatch.setattr(index, "CHUNK", 7)
    rows = [(k, f"p{k:03d}", "yoga" if k % 9 == 0 else "other", "yoga pain " * (k % 4) or None, f"20{k % 30 + 10}") for k in range(300)]
    papers = spark.createDataFrame(rows, "ord long, id string, title string, abstract string, publication_date string")
    q = spark.createDataFrame([(f"q{k}", "yoga pain" if k % 2 else "yoga") for k in range(20)], "qid string, search_query string")
    i = index.build(papers)
    assert i.papers.select("block").distinct().count() > 4
    got = index.top(i, q, 6).select("qid", "rank", "ord", "rank_score").collect()
    want = ranking.ranked(ranking.scored(papers.join(q.select("qid")), q)).where("rank <= 6").select("qid", "rank", "ord", "rank_score").collect()
    assert sorted(got) == sorted(want) and len(got) == 120
    every = pa.table({"term": [None, None, None, "a", "a"], "ord": [5, 6, 7, 5, 7], "t": [0, 1, 2, 0, 1], "m": [0, 0, 0, 2, 0]})
    asked = pa.table({"qid": ["x", "y", "z"], "terms": [["a"], ["b"], []], "floor": [0, 0, 0]})
    best = index.best_of_block(every, asked, 1)
    assert (best["qid"].to_pylist(), list(best["ord"]), list(best["t"]), list(best["m"])) == (["x", "y", "z"], [7, 5, 5], [1, 0, 0], [0, 0, 0])
    i.release()


def test_questions_are_broadcast_and_texts_stay_behind(spark, tmp_path):
    """Papers meet the few questions where they lie; ranking by ranges moves no texts."""
    from quillion.queries import questions

    spark.range(1000).selectExpr("id", "'en' qid").write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    plan = p.join(query.process(questions(spark)), "qid", "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r["qid"] for r in questions(spark).collect()) == ["de", "en", "es", "fr"]


ODD = [
    "Überblick—café “words” ½ ﬁnding Kelvin İstanbul", "e\u0301te\u0301 a\u0301-\u0301b 日本語 x２y straße Στάς", "studies bus Gas glass this axis ties dies flies s 7 x 42s", "«naïve» naïves NAÏVE naive", "a\u00a0b\u2014cc\u2014cc l’été l'été", "", None, " - ", "ends", "begins", "日本 ²³ ǆ Ǆ ﷺ",
]


def test_index_has_a_row_for_a_term_of_a_block_and_the_words_of_texts(spark, monkeypatch):
    """Postings of a term are a list, whatever the number of papers; words are those that a scan finds."""
    for at, size in ((1 << 11, 1 << 22), (3, 1 << 22), (1 << 11, 40)):
        monkeypatch.setattr(index, "AT_A_TIME", at)
        monkeypatch.setattr(index, "TEXT_BYTES", size)
        rows = [(k, b, k * 10, t, a) for b in (0, 1) for k, (t, a) in enumerate(zip(ODD, ODD[4:] + ODD[:4], strict=True))]
        p = spark.createDataFrame(rows, "k int, block int, ord long, title string, abstract string").withColumn("scope", F.lit("x"))
        w = p.select("block", "ord", text.words(F.col("title")).alias("a"), text.words(F.col("abstract")).alias("b")).collect()
        want = {}
        for r in w:
            for t in {*r["a"], *r["b"]} - set(query.STOPWORDS):
                want[r["block"], t, r["ord"]] = (t in r["a"]) * index.TITLE + min(3, r["b"].count(t))
        cols = ["scope", "block", "ord", "title", "abstract"]
        batch = pa.Table.from_pylist([{c: r[c] for c in cols} for r in p.collect()], pa.schema([("scope", pa.string()), ("block", pa.int32()), ("ord", pa.int64()), ("title", pa.string()), ("abstract", pa.string())]))
        lists = [x for b in index.counted(iter(batch.to_batches())) for x in b.to_pylist()]
        found = [((x["block"], x["term"], o), v) for x in lists for o, v in zip(x["ords"], x["weights"], strict=True)]
        assert len(found) == len(want) and dict(found) == want
        if size > 40 and at > 3:
            assert len(lists) == len({(b, t) for b, t, _ in want})
    assert list(index.counted(iter(batch.slice(0, 0).to_batches()))) == []
    papers = spark.createDataFrame([(k, f"p{k}", "yoga", "pain yoga", "2020") for k in range(500)], "ord long, id string, title string, abstract string, publication_date string")
    i = index.build(papers)
    assert i.postings.count() <= 2 * index.SHARES and i.postings.selectExpr("sum(size(ords))").collect()[0][0] == 1000
    i.release()


def _shuffled(spark, f):
    """Rows written to shuffles while ``f`` runs."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        s = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {s.apply(i).stageId(): s.apply(i).shuffleWriteRecords() for i in range(s.size())}

    last = max(stages(), default=-1)
    f()
    return sum(n for i, n in stages().items() if i > last)


def test_search_moves_postings_once_and_few_rows_a_question(spark, monkeypatch):
    """More chunks of questions don't copy postings, and more blocks of papers don't bring more rows for each question."""
    monkeypatch.setattr(index, "BLOCK", 20)
    monkeypatch.setattr(index, "LANES", 2, raising=False)
    rng = random.Random(7)
    rows = [(k, f"p{k}", " ".join(rng.choices("abcdefgh", k=3)).replace(" ", "1 "), "a1 b1", "2020") for k in range(600)]
    i = index.build(spark.createDataFrame(rows, "ord long, id string, title string, abstract string, publication_date string"))
    moved = {}
    for n, chunk in ((40, 1000), (40, 4), (400, 1000)):
        monkeypatch.setattr(index, "CHUNK", chunk)
        q = spark.createDataFrame([(f"q{k}", "a1 b1 c1 d1") for k in range(n)], "qid string, search_query string")
        moved[n, chunk] = _shuffled(spark, lambda q=q: index.top(i, q, 3).count())
    assert moved[40, 4] <= moved[40, 1000] + 200
    assert moved[400, 1000] - moved[40, 1000] <= 360 * (2 * 3 + 6)
    i.release()


@pytest.mark.parametrize("few", [0, 100])
def test_blocks_and_chunks_keep_the_order_of_ties(spark, monkeypatch, few):
    """Small blocks, frequent terms as rows or not, floors from a few papers, questions of thousands of terms, scopes compared or joined."""
    for name, value in (("BLOCK", 30), ("CHUNK", 3), ("LANES", 2), ("FEW_SCOPES", few), ("PROBE", 8), ("ROW_SHARE", 3)):
        monkeypatch.setattr(index, name, value)
    rng = random.Random(9)
    rows = [(k, f"s{k % 2}", f"p{k}", " ".join(rng.choices(["a1", "b1", "c1", "d1"], [9, 4, 1, 1], k=2)), rng.choice(["a1 b1 b1", "c1", "", None]), rng.choice(["2020", "2021-03", None])) for k in range(300)]
    papers = spark.createDataFrame(rows, "ord long, qid string, id string, title string, abstract string, publication_date string")
    long = " ".join(f"x{k}" for k in range(4200)) + " c1 a1"
    q = spark.createDataFrame([(f"q{k}", f"s{k % 3}", t) for k, t in enumerate(["a1", "a1 b1", "c1 d1 a1", "none", long, "d1", "b1", None])], "qid string, s string, search_query string")
    i = index.build(papers, "qid")
    got = index.top(i, q, 4, "s").select("qid", "rank", "ord", "rank_score").collect()
    own = papers.withColumnRenamed("qid", "s").join(q.select("qid", "s"), "s").drop("s")
    want = ranking.ranked(ranking.scored(own, q.select("qid", "search_query"))).where("rank <= 4").select("qid", "rank", "ord", "rank_score").collect()
    assert sorted(got) == sorted(want) and len(got) == 24
    i.release()
