import random

import pytest
from pyspark.sql import functions as F

from quillion.operators import dedup, identity
from quillion.schemas import PAPER


def paper(ord, source="pubmed", sid=None, doi=None, title="T", **kw):
    sid = sid or str(ord)
    row = dict(ord=ord, qid="q", id=f"{source}:{sid}", title=title, authors=[], abstract=None, journal=None, publication_date=None, doi=doi, source=source, source_id=sid, url=None, source_ids=[f"{source}:{sid}"], provider_ranks={source: ord}, rank_score=None)
    return tuple({**row, **kw}[f.name] for f in PAPER)


def frame(spark, rows):
    return spark.createDataFrame(rows, PAPER)


@pytest.mark.parametrize("doi", ["10.1/AbC", "doi:10.1/abc", "https://doi.org/10.1/ABC ", "http://dx.doi.org/10.1/abc", "DOI: 10.1/abc"])
def test_doi_spellings(spark, doi):
    assert spark.createDataFrame([(doi,)], "d string").select(dedup.doi_key(F.col("d"))).collect()[0][0] == "10.1/abc"


def test_keys_and_blanks(spark):
    df = frame(spark, [paper(1, doi=" "), paper(2, "crossref", title="Low-Back  Pain: é!"), paper(3, "crossref", title="?!"), paper(4, doi="10.1/x")])
    got = [sorted(r[0]) for r in df.orderBy("ord").select(dedup.identity_keys(F.col("doi"), F.col("source_ids"), F.col("title"))).collect()]
    assert got == [["pmid:1"], ["title:low back pain e"], [], ["doi:10.1/x", "pmid:4"]]


def test_chain_merges_with_the_first_as_base(spark):
    rows = [
        paper(1, "crossref", "a", doi="10.1/A", title="First", authors=["x"], abstract="short", publication_date="2024", journal=""),
        paper(2, "pubmed", "7", doi="10.1/a", title="Second", authors=["x", "y"], abstract="longer text", publication_date="2024-03", journal="J"),
        paper(3, "local", "z", title="Third", source_ids=["local:z", "pubmed:7"], abstract="", publication_date="2024-03", provider_ranks={"pubmed": 1}),
        paper(4, "crossref", "b", doi="10.1/b", title="First"),
    ]
    out = {r["ord"]: r for r in dedup.deduplicate(frame(spark, rows)).collect()}
    assert set(out) == {1, 4}
    m = out[1]
    assert (m["id"], m["title"], m["journal"], m["abstract"], m["publication_date"]) == ("crossref:a", "First", "J", "longer text", "2024-03")
    assert m["source_ids"] == ["crossref:a", "pubmed:7", "local:z"] and m["authors"] == ["x", "y"]
    assert m["provider_ranks"] == {"crossref": 1, "pubmed": 1} and m["rank_score"] is None


def test_single_records_stay_unchanged(spark):
    row = dedup.deduplicate(frame(spark, [paper(5, abstract="", rank_score=0.5)])).collect()[0]
    assert row["abstract"] == "" and row["rank_score"] == 0.5


def test_long_chain_and_order_independence(spark):
    n = 40
    rows = [paper(i, "local", f"s{i}", title=f"t{i}", source_ids=[f"pubmed:{i}", f"pubmed:{i + 1}"]) for i in range(n)] + [paper(100, title="alone")]
    for seed in (0, 1):
        random.Random(seed).shuffle(rows)
        p = frame(spark, rows).repartition(3)
        keys = p.select("ord", F.explode(dedup.identity_keys(F.col("doi"), F.col("source_ids"), F.col("title"))).alias("key"))
        got = {r["ord"]: r["leader"] for r in dedup.leaders(p, keys).collect()}
        assert got == {**{i: 0 for i in range(n)}, 100: 100}


def test_star_of_many_records(spark):
    p = spark.range(5000).select(F.col("id").alias("ord"))
    got = dedup.leaders(p, p.select("ord", F.lit("doi:x").alias("key"))).select("leader").distinct().collect()
    assert [r[0] for r in got] == [0]


def test_empty_and_same_titles(spark):
    assert dedup.deduplicate(frame(spark, [])).count() == 0
    df = frame(spark, [paper(1, title="A b"), paper(2, title="a  B!"), paper(3, title="a b"), paper(4, title="c")])
    assert dedup.unmerged_same_titles(df).collect()[0]["pairs"] == 2


def test_batches_in_any_split_equal_one_run(spark):
    """Random graphs in batches: the store's labels are those of one run; listed changes lead from old labels to new ones."""
    rng = random.Random(11)
    edges = [(k, f"k{rng.randint(0, 60)}") for k in range(70) for _ in range(rng.randint(0, 2))]
    every = spark.createDataFrame([(k,) for k in range(70)], "ord long")
    whole = {r["ord"]: r["leader"] for r in dedup.leaders(every, spark.createDataFrame(edges, "ord long, key string")).collect()}
    for order in (list(range(70)), rng.sample(range(70), 70)):
        store, seen = identity.Identity(), {}
        for part in (order[:30], order[30:32], order[32:]):
            batch = spark.createDataFrame([(k,) for k in part], "ord long")
            mine = spark.createDataFrame([e for e in edges if e[0] in part], "ord long, key string")
            store, changed = identity.extend(store, batch, mine)
            moves = {r["old"]: r["new"] for r in changed.collect()}
            now = {r["ord"]: r["leader"] for r in identity.Identity.from_json(store.to_json()).labels(spark).collect()}
            assert all(now[o] == moves.get(was, was) for o, was in seen.items())
            seen = now
        assert seen == whole
        store.release(spark)


def test_an_arrival_touches_only_its_component(spark):
    a = spark.createDataFrame([(k, f"k{k // 2}") for k in range(100)], "ord long, key string")
    store, changed = identity.extend(identity.Identity(), a.select("ord"), a)
    assert changed.count() == 0
    b = spark.createDataFrame([(200, "k3"), (200, "k7"), (201, "new")], "ord long, key string")
    more, changed = identity.extend(store, b.select("ord"), b)
    assert [tuple(r) for r in changed.collect()] == [(14, 6)]
    assert spark.read.parquet(more.hubs[1]).collect()[0]["key"] == "new" and spark.read.parquet(more.records[1]).count() == 2
    again, changed = identity.extend(more, b.select("ord").limit(0), b.limit(0))
    assert changed.count() == 0 and again.labels(spark).count() == 102


def test_one_large_component_merges_from_partial_rows(spark):
    """20,000 records of one DOI: no task gathers them; ids in order of first appearance, ranks by source, as for two."""
    n = 20_000
    rows = [(k, "q", f"s:{k % 7}", f"t{k}", ["a"] * (k % 3), "x" * (k % 50), f"j{k}" if k % 2 else None, "2020", "10.1/x", "pubmed" if k % 2 else "crossref", "1", None, [f"crossref:{k % 7}", f"pubmed:{k % 5}"], {"pubmed" if k % 2 else "crossref": 1 + (k * 31) % 977}, None) for k in range(n)]
    p = spark.createDataFrame(rows, PAPER)
    got = dedup.deduplicate(p).collect()
    assert len(got) == 1
    seen = list(dict.fromkeys(s for r in rows for s in r[12]))
    ranks = {}
    for r in rows:
        for s, v in r[13].items():
            ranks[s] = min(v, ranks.get(s, v))
    assert got[0]["source_ids"] == seen and got[0]["provider_ranks"] == ranks and got[0]["ord"] == 0 and len(got[0]["abstract"]) == 49 and got[0]["journal"] == "j1"
    plan = dedup.merged(p, p.select("ord", F.lit(0).cast("long").alias("leader")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1  # of distinct ids and sources


def test_labels_and_hubs_never_go_by_the_driver(spark):
    """Joins of what grows with the records shuffle, however small the tables are here."""
    keys = spark.createDataFrame([(k, f"k{k // 2}") for k in range(40)], "ord long, key string")
    store = identity.Identity()
    for k in range(2):
        batch = keys.where(f"ord % 2 = {k}")
        store, _ = identity.extend(store, batch.select("ord"), batch)
    for df in (store.labels(spark), store.known(spark, keys), dedup.leaders(keys.select("ord"), keys)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r["ord"], r["leader"]) for r in store.labels(spark).collect()} == {(k, k // 2 * 2) for k in range(40)}
    store.release(spark)
