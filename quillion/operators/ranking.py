"""Lexical scores and a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.functions import text
from quillion.operators import query
from quillion.operators.order import positions
from quillion.session import spread

#: Weights, and mentions that earn an abstract full credit.
TITLE_WEIGHT, ABSTRACT_WEIGHT, FULL_MENTIONS = 0.75, 0.25, 3


def score(terms: Column, title_words: Column, abstract_words: Column) -> Column:
    """Weighted share of terms in the title, and of saturating mentions in the abstract; 0 without terms."""
    n = F.size(terms)
    in_title = F.size(F.array_intersect(terms, title_words)) / n
    # one pass over the abstract leaves the words that are terms; bound to a variable, they are found once, not once a term
    hits = F.array(F.filter(abstract_words, lambda w: F.array_contains(terms, w)))
    of = lambda h: F.aggregate(terms, F.lit(0), lambda a, t: a + F.least(F.lit(FULL_MENTIONS), F.size(F.filter(h, lambda w: w == t))))
    mentions = F.element_at(F.transform(hits, of), 1)
    # rounded half to even, so that noise can't reorder ties
    return F.when(n > 0, F.bround(TITLE_WEIGHT * in_title + ABSTRACT_WEIGHT * (mentions / FULL_MENTIONS / n), 6)).otherwise(0.0)


def date_key(date: Column) -> Column:
    """(year, month, day) of a partial date, missing parts 0; all 0 if any part is malformed."""
    parts = F.transform(F.split(F.coalesce(date, F.lit("")), "-"), lambda p: text.strip(p).try_cast("int"))
    ok = F.forall(parts, lambda p: p.isNotNull())
    part = lambda i: F.when(ok, F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(0))).otherwise(0)
    return F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d"))


def scored(papers: DataFrame, questions: DataFrame) -> DataFrame:
    """``papers`` (with qid) with rank_score for their question's search_query.

    Questions are few and joined by qid; the optimiser broadcasts them if they are small.
    """
    q = questions.select("qid", query.terms(F.col("search_query")).alias("_terms"))
    p = spread(papers.drop("rank_score")).withColumns({"_title": text.words(F.col("title")), "_abstract": text.words(F.col("abstract"))}).join(q, "qid", "left")
    return p.withColumn("rank_score", F.coalesce(score(F.col("_terms"), F.col("_title"), F.col("_abstract")), F.lit(0.0))).drop("_terms", "_title", "_abstract")


def order(papers_id: str = "id") -> list[tuple[Column, bool]]:
    """What orders papers: (column, whether descending): score, an abstract, the newer date, id."""
    date = date_key(F.col("publication_date"))
    has = F.coalesce(F.col("abstract") != "", F.lit(False))
    return [(F.col("rank_score"), True), (has, True), (date["y"], True), (date["m"], True), (date["d"], True), (F.col(papers_id), False)]


def ranked_large(scored_papers: DataFrame, by: str = "qid", only: DataFrame | None = None) -> tuple[DataFrame, str]:
    """As ``ranked``, for groups too large for a task; and the folder that the frame reads."""
    return positions(scored_papers, [by], order(), "rank", only)


def ranked(scored_papers: DataFrame, by: str = "qid", most: int | None = None) -> DataFrame:
    """Adds rank, from 1 within ``by``: score, then an abstract, then the newer date, then id."""
    w = Window.partitionBy(by).orderBy(*[c.desc() if down else c.asc() for c, down in order()])
    out = scored_papers.withColumn("rank", F.row_number().over(w))
    return out if most is None else out.where(F.col("rank") <= most)
