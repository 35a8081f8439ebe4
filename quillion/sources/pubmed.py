"""Records of the biomedical index: id lists as JSON, articles as XML.

The XML tree is read once per reply in an Arrow function (mixed content, and
entities that must be refused, are beyond the JVM readers); it yields the raw
parts of each article, and DataFrame expressions make a record of them.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillion.config import Settings
from quillion.functions import text
from quillion.schemas import STR, struct
from quillion.sources.base import Source, with_positions, with_provenance
from quillion.sources.crossref import array_at, of_type, string_at

NAME = "pubmed"
#: Months as the index abbreviates them, and the address of a record.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ADDRESS = "https://pubmed.ncbi.nlm.nih.gov/%s/"

#: Bytes of replies that are parsed into one Arrow batch.
PORTION_BYTES = 1 << 20

DATE = struct(year=STR, month=STR, day=STR, free=STR)
NAMED = struct(kind=STR, valid=STR, value=STR)
ARTICLE = struct(
    pmid=STR, title=STR, journal=STR, journal_short=STR, people=T.ArrayType(struct(group=STR, last=STR, fore=STR, initials=STR)), parts=T.ArrayType(struct(label=STR, body=STR)),
    printed=DATE, online=DATE, article_ids=T.ArrayType(NAMED), locations=T.ArrayType(NAMED),
)


def refuse_entities(xml: bytes) -> None:
    """Raise ValueError if the document declares entities."""

    def declared(*args) -> None:
        raise ValueError("the document declares entities")

    p = expat.ParserCreate()
    p.EntityDeclHandler = declared
    p.ExternalEntityRefHandler = declared
    p.Parse(xml, True)


def flat(e: ET.Element | None) -> str | None:
    """All text inside an element, white space runs as single spaces; None if there is none."""
    return None if e is None else " ".join("".join(e.itertext()).split()) or None


def raw_articles(xml: str | bytes | None) -> list[dict] | None:
    """The raw parts of every article, or None for XML that is broken or declares entities."""
    raw = xml.encode() if isinstance(xml, str) else xml
    try:
        refuse_entities(raw or b"")
        root = ET.fromstring(raw)
    except (ET.ParseError, expat.ExpatError, ValueError):
        return None
    date = lambda e: None if e is None else {"year": flat(e.find("Year")), "month": flat(e.find("Month")), "day": flat(e.find("Day")), "free": flat(e.find("MedlineDate"))}
    out = []
    for a in root.findall("PubmedArticle"):
        c = a.find("MedlineCitation")
        if c is None:
            continue
        out.append({
            "pmid": flat(c.find("PMID")), "title": flat(c.find("Article/ArticleTitle")), "journal": flat(c.find("Article/Journal/Title")), "journal_short": flat(c.find("MedlineJournalInfo/MedlineTA")),
            "people": [{"group": flat(p.find("CollectiveName")), "last": flat(p.find("LastName")), "fore": flat(p.find("ForeName")), "initials": flat(p.find("Initials"))} for p in c.findall("Article/AuthorList/Author")],
            "parts": [{"label": t.get("Label"), "body": flat(t)} for t in c.findall("Article/Abstract/AbstractText")],
            "printed": date(c.find("Article/Journal/JournalIssue/PubDate")), "online": date(c.find("Article/ArticleDate")),
            "article_ids": [{"kind": i.get("IdType"), "valid": None, "value": flat(i)} for i in a.findall("PubmedData/ArticleIdList/ArticleId")],
            "locations": [{"kind": i.get("EIdType"), "valid": i.get("ValidYN", "Y"), "value": flat(i)} for i in c.findall("Article/ELocationID")],
        })
    return out


def portions(payloads: pa.Array, most: int = PORTION_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of replies of about ``most`` bytes together; a longer reply is one by itself."""
    start, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(payloads), 0).to_pylist()):
        if k > start and held + n > most:
            yield start, k - start
            start, held = k, 0
        held += n
    if len(payloads) > start:
        yield start, len(payloads) - start


def articles(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """qid, and the list of raw articles of each reply (null where the XML is refused).

    However many replies an Arrow batch holds, a few of them are open as trees and lists at a time.
    """
    schema = T.StructType([replies.schema["qid"], T.StructField("articles", T.ArrayType(ARTICLE))])
    want = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, n in portions(whole.column(payload)):
                b = whole.slice(start, n)
                yield pa.RecordBatch.from_arrays([b.column("qid"), pa.array((raw_articles(x.as_py()) for x in b.column(payload)), want.field("articles").type, size=n)], schema=want)

    return replies.select("qid", payload).mapInArrow(run, schema)


def people(a: Column) -> Column:
    """Groups by name; persons with a surname, after their first name or initials."""
    name = lambda p: F.when(p["last"].isNotNull(), F.concat_ws(" ", F.coalesce(p["fore"], p["initials"]), p["last"]))
    return F.array_compact(F.transform(a["people"], lambda p: F.coalesce(p["group"], name(p))))


def sectioned(a: Column) -> Column:
    """The abstract, a line for each part, with its label."""
    some = F.filter(a["parts"], lambda p: p["body"].isNotNull())
    labelled = lambda p: F.when(F.coalesce(p["label"], F.lit("")) != "", F.concat(p["label"], F.lit(": "), p["body"])).otherwise(p["body"])
    return text.nonempty(F.array_join(F.transform(some, labelled), "\n"))


def month_number(m: Column) -> Column:
    n = F.when(m.rlike("^[0-9]+$"), m.try_cast("int"))
    named = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.lower(F.substring(m, 1, 3))).cast("int")
    return F.when(m.rlike("^[0-9]+$"), F.when(n.between(1, 12), n)).when(named > 0, named)


def partial_date(d: Column) -> Column:
    """As much of a date as is given; of free text only the first standalone year."""
    month, day = month_number(d["month"]), F.when(d["day"].rlike("^[0-9]+$"), d["day"].try_cast("int"))
    year = F.when(d["year"].rlike("^[0-9]{4}$"), d["year"])
    free = text.nonempty(F.regexp_extract(F.coalesce(d["free"], F.lit("")), r"(?U)\b([0-9]{4})\b", 1))
    whole = F.when(month.isNull(), year).when(day.between(1, 31), F.format_string("%s-%02d-%02d", year, month, day)).otherwise(F.format_string("%s-%02d", year, month))
    return F.when(d["year"].isNull(), free).when(year.isNotNull(), whole)


def own_doi(a: Column) -> Column:
    """The article's own DOI: among its ids, else a location that isn't marked invalid; never from its references."""
    dois = lambda xs: F.array_compact(F.transform(F.filter(xs, lambda x: (x["kind"] == "doi") & (F.coalesce(x["valid"], F.lit("Y")) != "N")), lambda x: text.doi_bare(x["value"])))
    return F.coalesce(F.try_element_at(dois(a["article_ids"]), F.lit(1)), F.try_element_at(dois(a["locations"]), F.lit(1)))


def parsed(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """Records of replies (qid, payload), and a row with an error for each reply that can't be read, from one pass."""
    error = F.when(F.col("articles").isNull(), "unreadable article response").alias("error")
    x = articles(replies, payload).select("qid", error, F.posexplode_outer("articles").alias("pos", "a"))
    a = F.col("a")
    r = x.where("error is not null or (a.pmid is not null and a.title is not null)").select(
        "qid", "error", "pos", a["title"].alias("title"), people(a).alias("authors"), sectioned(a).alias("abstract"), F.coalesce(a["journal"], a["journal_short"]).alias("journal"),
        F.coalesce(partial_date(a["printed"]), partial_date(a["online"])).alias("publication_date"), own_doi(a).alias("doi"), a["pmid"].alias("source_id"), F.format_string(ADDRESS, a["pmid"]).alias("url"),
    )
    return with_provenance(r.withColumn("source", F.lit(NAME)))


def parse(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """Records of replies (qid, payload): qid, pos and the fields of a paper; articles without id or title are skipped."""
    return parsed(replies, payload).where("error is null").drop("error")


#: What ends a record in a file, and what begins one.
RECORD_END, RECORD_START = "</PubmedArticle>", r"(?s)^.*(<PubmedArticle[\s>])"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Articles of XML files of any size: file, block, at, error and the fields of a paper; (block, at) is the order in a file.

    Files (UTF-8) are split at the ends of records, so one file is many tasks,
    and each record is parsed by itself. One that is broken or cut off is a row
    with an error; a file that declares entities, wherever that stands, is one
    row with an error and no records. What lies between records is skipped.
    """
    lines = spark.read.option("lineSep", RECORD_END).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    start = F.length(F.regexp_extract("value", RECORD_START, 0)) - F.length(F.regexp_extract("value", RECORD_START, 1))
    declares = F.contains("value", F.lit("<!ENTITY"))
    bad = lines.where(declares).select("file").distinct()
    # the last start before an end: text in front of it belongs to no record
    records = lines.where(F.col("value").rlike(RECORD_START)).join(bad, "file", "left_anti").select("file", "block", "at", F.concat(F.lit("<PubmedArticleSet>"), F.substring("value", start + 1, F.length("value")), F.lit(RECORD_END + "</PubmedArticleSet>")).alias("payload"))
    got = parsed(records.select(F.struct("file", "block", "at").alias("qid"), "payload"))
    out = got.select("qid.file", "qid.block", "qid.at", *[c for c in got.columns if c not in ("qid", "pos")])
    return out.unionByName(bad.select("file", F.lit("the document declares entities").alias("error")), allowMissingColumns=True)


def id_lists(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """(qid, pos, pmid, error) of search replies; a reply that isn't a list of ids gives one row with an error."""
    v = F.try_parse_json(F.col(payload))
    result = of_type(v, "$.esearchresult", "OBJECT")
    error = F.when(F.try_variant_get(v, "$.esearchresult", "variant").isNull(), "unexpected search response").when(result.isNull() | F.try_variant_get(result, "$.ERROR", "variant").isNotNull(), "search request was rejected")
    listed = F.try_variant_get(result, "$.idlist", "variant")
    error = F.coalesce(error, F.when(listed.isNotNull() & array_at(result, "$.idlist").isNull(), F.lit("unexpected search response")))
    ids = F.when(error.isNull(), F.transform(array_at(result, "$.idlist"), lambda x: F.try_variant_get(x, "$", "string")))
    return replies.select("qid", error.alias("error"), F.posexplode_outer(ids).alias("pos", "pmid"))


class PubMed(Source):
    """Search replies and article replies from a snapshot (qid, payload each)."""

    name = NAME

    def __init__(self, searches: DataFrame, fetched: DataFrame, most: int = 20):
        self.searches, self.fetched, self.most = searches, fetched, most

    @classmethod
    def of(cls, searches: DataFrame, fetched: DataFrame, settings: Settings) -> PubMed:
        return cls(searches, fetched, settings.pubmed_limit)

    def answers(self, questions: DataFrame) -> DataFrame:
        """Articles in the order of the id lists, ids without article left out; rejected searches and unreadable replies as errors."""
        ids = id_lists(self.searches.join(questions.select("qid"), "qid", "left_semi"))
        wanted = ids.where(F.col("pmid").isNotNull() & (F.col("pos") < self.most)).select("qid", F.col("pos").alias("_pos"), F.col("pmid").alias("source_id"))
        mine = self.fetched.join(wanted.select("qid").distinct(), "qid", "left_semi")
        got = parsed(mine).join(wanted, ["qid", "source_id"], "left").where("_pos is not null or error is not null").withColumn("pos", F.col("_pos")).drop("_pos")
        return with_positions(got.unionByName(ids.where("error is not null").select("qid", "error"), allowMissingColumns=True), self.most)

    def search(self, questions: DataFrame) -> DataFrame:
        return self.answers(questions).where("error is null").drop("error")

    def failures(self, questions: DataFrame) -> DataFrame:
        return self.answers(questions).where("error is not null").select("qid", "error")


__all__ = ["PubMed", "parse", "id_lists", "string_at"]
