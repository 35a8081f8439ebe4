"""Questions become search queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.functions import text
from quillion.session import spread

#: Words that say nothing about a topic.
STOPWORDS = (
    "what what's which who whom whose when where why how is are was were be been being am do does did done can could will would should shall may might must "
    "has have had having there their theirs it its this that these those i me my we us our you your the a an of in on at for to with by from as about into and "
    "please tell give show find list explain describe summarize summarise search look know want need"
).split()
#: Words that sources could read as operators.
KEPT_LOWER, NEVER_UPPER = ("or", "not"), ("or", "not", "and")
LEAST_CHARS, MOST_CHARS = 3, 1000


def plain(question: Column) -> Column:
    """Compatibility forms composed, curly apostrophes straight."""
    return F.replace(text.nfkc(question), F.lit("’"), F.lit("'"))


def search_query(plain: Column) -> Column:
    """The terms of a question in plain form, joined by spaces; null if no term is left.

    Stopwords go unless capitals mark them as acronyms: upper case in a
    question that isn't all upper case, and not a single letter in front.
    """
    shouting = ~plain.rlike(r"(?U)\p{Lower}")
    found = F.regexp_extract_all(plain, F.lit(r"(?U)\w+(?:['-]\w+)*"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])

    def keep(t: Column, i: Column) -> Column:
        low = F.lower(t)
        upper = (F.upper(t) == t) & (low != t)
        acronym = ~shouting & upper & ~low.isin(*NEVER_UPPER) & ((F.length(t) > 1) | (i > 0))
        return ~F.array_contains(stop, low) | acronym

    kept = F.filter(found, keep)
    return text.nonempty(F.array_join(F.transform(kept, lambda t: F.when(F.lower(t).isin(*KEPT_LOWER), F.lower(t)).otherwise(t)), " "))


def process(questions: DataFrame, col: str = "question") -> DataFrame:
    """Adds question (trimmed), search_query and valid.

    A question is valid if it has 3 to 1000 characters after trimming and at
    least one term.
    """
    q = spread(questions).withColumn(col, text.strip(F.col(col)))
    # a column of its own: Python functions may not stand inside lambda functions
    q = q.withColumn("_plain", plain(F.col(col))).withColumn("search_query", search_query(F.col("_plain"))).drop("_plain")
    return q.withColumn("valid", F.coalesce(F.length(col).between(LEAST_CHARS, MOST_CHARS) & F.col("search_query").isNotNull(), F.lit(False)))


def terms(query: Column) -> Column:
    """Distinct words of a query that a ranking compares, in order."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(text.words(query), lambda w: ~F.array_contains(stop, w)))
