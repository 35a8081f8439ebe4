"""Identity of records: shared keys, chains of them, and ordered merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.functions import text
from quillion.session import cut, delete


def doi_key(doi: Column) -> Column:
    return text.nonempty(F.lower(text.doi_bare(F.lower(doi))))


def pmids(source_ids: Column) -> Column:
    return F.transform(F.filter(source_ids, lambda s: s.startswith("pubmed:")), lambda s: F.substring(s, F.lit(8), F.length(s)))


def identity_keys(doi: Column, source_ids: Column, title: Column) -> Column:
    """Keys under which a record is known: DOI and PubMed ids, or its title where it has neither."""
    d, p = doi_key(doi), pmids(F.coalesce(source_ids, F.array().cast("array<string>")))
    strong = F.array_compact(F.concat(F.array(F.concat(F.lit("doi:"), d)), F.transform(p, lambda x: F.concat(F.lit("pmid:"), x))))
    return F.when(F.size(strong) > 0, strong).otherwise(F.array_compact(F.array(F.concat(F.lit("title:"), text.title_key(title)))))


def leaders(records: DataFrame, keys: DataFrame) -> DataFrame:
    """(ord, leader): the smallest ord that a record is connected with through shared keys.

    ``records`` has ord, ``keys`` has ord and key. Keys are hubs: records meet at
    their key, never in pairs, so a key of any number of records costs its rows.
    Minimum labels travel from records to keys and back, with pointer jumping.
    Labels and hubs grow with the records, and files of numbers are far smaller
    than what they hold: joins are told to shuffle, so nothing goes by the driver.
    """
    spark = records.sparkSession
    keys = keys.distinct()
    shared = keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key").hint("merge"), "key")
    edges, edges_path = cut(shared, "dedup-edges")

    def spread(label: DataFrame) -> DataFrame:
        hub = edges.join(label.hint("merge"), "ord").groupBy("key").agg(F.min("leader").alias("least"))
        return edges.join(hub.hint("merge"), "key").groupBy("ord").agg(F.min("least").alias("leader"))

    # one step settles all groups that share one key; a key whose records differ asks for more
    label, path = cut(spread(edges.select("ord", F.col("ord").alias("leader")).distinct()), "dedup-labels")
    while not edges.join(label.hint("merge"), "ord").groupBy("key").agg(F.min("leader").alias("a"), F.max("leader").alias("b")).where("a <> b").isEmpty():
        near, mid = cut(spread(label), "dedup-labels")
        jump = near.select(F.col("ord").alias("leader"), F.col("leader").alias("further"))
        new, new_path = cut(near.join(jump.hint("merge"), "leader").select("ord", F.col("further").alias("leader")), "dedup-labels")
        delete(spark, path)
        delete(spark, mid)
        label, path = new, new_path
    delete(spark, edges_path)
    return records.select("ord").join(label.hint("merge"), "ord", "left").select("ord", F.coalesce("leader", "ord").alias("leader"))


def merged(papers: DataFrame, lead: DataFrame) -> DataFrame:
    """One paper per leader, in the order of first appearance; a single record stays as it is.

    Everything is combined in the tasks that read the records before it is
    shuffled: fields by the smallest or largest, identifiers once each with
    their first place, positions once for each source. So a group of any size
    comes to one task as a row a task, and its own distinct identifiers.
    """
    p = papers.join(lead, "ord")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    first = lambda c: F.min_by(F.col(c), F.when(filled(c).isNotNull(), F.col("ord")))
    longest = lambda c: F.max_by(F.col(c), F.when(filled(c).isNotNull(), F.struct(F.length(c), -F.col("ord"))))
    base = {c: F.min_by(F.col(c), "ord").alias(f"_b_{c}") for c in papers.columns if c != "ord"}
    g = p.groupBy("leader").agg(
        F.count("*").alias("_n"), *base.values(),
        F.max_by("authors", F.struct(F.size("authors"), -F.col("ord"))).alias("_authors"),
        longest("abstract").alias("_abstract"), longest("publication_date").alias("_publication_date"),
        first("journal").alias("_journal"), first("doi").alias("_doi"), first("url").alias("_url"),
    )
    # identifiers with their first place and sources with their best rank, each once a task and then once a leader
    places = F.transform(F.coalesce("source_ids", F.array().cast("array<string>")), lambda x, k: F.struct(F.lit(0).alias("kind"), x.alias("name"), F.col("ord").alias("a"), k.alias("b")))
    best = F.transform(F.map_entries(F.coalesce("provider_ranks", F.create_map().cast("map<string,int>"))), lambda x: F.struct(F.lit(1).alias("kind"), x["key"].alias("name"), x["value"].cast("long").alias("a"), F.lit(0).alias("b")))
    each = p.select("leader", F.explode(F.concat(places, best)).alias("x")).groupBy("leader", "x.kind", "x.name").agg(F.min(F.struct("x.a", "x.b")).alias("least"))
    lists = each.groupBy("leader").agg(F.sort_array(F.collect_list(F.struct("kind", "least", "name"))).alias("x"))
    ranks = F.map_from_entries(F.array_sort(F.transform(F.filter("x", lambda x: x["kind"] == 1), lambda x: F.struct(x["name"], x["least"]["a"].cast("int")))))
    lists = lists.select("leader", F.transform(F.filter("x", lambda x: x["kind"] == 0), lambda x: x["name"]).alias("_source_ids"), ranks.alias("_provider_ranks"))
    g = g.join(lists, "leader", "left").withColumns({"_rank_score": F.lit(None).cast("double"), "_source_ids": F.coalesce("_source_ids", F.array().cast("array<string>")), "_provider_ranks": F.coalesce("_provider_ranks", F.create_map().cast("map<string,int>"))})
    many = F.col("_n") > 1
    cols = [F.when(many, F.col(f"_{c}")).otherwise(F.col(f"_b_{c}")).alias(c) if f"_{c}" in g.columns else F.col(f"_b_{c}").alias(c) for c in papers.columns if c != "ord"]
    return g.select(F.col("leader").alias("ord"), *cols)


def deduplicate(papers: DataFrame) -> DataFrame:
    """Papers (unique ord) merged by identity within their question."""
    scope = F.coalesce(F.col("qid"), F.lit("")) if "qid" in papers.columns else F.lit("")
    keys = papers.select("ord", scope.alias("_q"), F.explode(identity_keys(F.col("doi"), F.col("source_ids"), F.col("title"))).alias("key"))
    return merged(papers, leaders(papers, keys.select("ord", F.concat_ws("\u0000", "_q", "key").alias("key"))))


def unmerged_same_titles(papers: DataFrame) -> DataFrame:
    """How many papers beyond the first share a normalised title (pairs that identity left apart)."""
    t = papers.select(text.title_key(F.col("title")).alias("k")).where("k is not null")
    return t.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("pairs"))
