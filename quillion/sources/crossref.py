"""Records of the works service: JSON read as VARIANT, field by field, with type guards.

A mistyped field is absent and a mistyped record is skipped; only a reply that
isn't a successful listing is an error. A declared schema would coerce numbers
to text and lose whole listings to one bad element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.config import Settings
from quillion.functions import text
from quillion.sources.base import Source, with_positions, with_provenance

NAME = "crossref"
#: Date fields by preference, and the fields that a request selects.
ARTICLE_TYPE = "journal-article"
DATE_FIELDS = ("issued", "published", "published-print", "published-online")
SELECTED = ("DOI", "title", "author", "abstract", "container-title", "URL", *DATE_FIELDS)


def of_type(v: Column, path: str, kind: str) -> Column:
    """The value at a path if its VARIANT type is ``kind``, else null."""
    got = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(got).startswith(kind), got)


def string_at(v: Column, path: str = "$") -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def array_at(v: Column, path: str) -> Column:
    return F.try_variant_get(of_type(v, path, "ARRAY"), "$", "array<variant>")


def first_text(v: Column, path: str) -> Column:
    """The first text with content of a list, or of a bare value."""
    got = F.coalesce(F.transform(array_at(v, path), lambda x: string_at(x)), F.array(string_at(v, path)))
    return F.try_element_at(F.array_compact(text.plain_texts(got)), F.lit(1))


def authors(v: Column) -> Column:
    """Organisations by name; persons as given and family name, as far as there."""
    people = F.filter(array_at(v, "$.author"), lambda a: F.schema_of_variant(a).startswith("OBJECT"))
    part = lambda f: text.plain_texts(F.transform(people, lambda a: string_at(a, f"$.{f}")))
    names = F.zip_with(part("name"), F.zip_with(part("given"), part("family"), lambda g, f: F.nullif(F.concat_ws(" ", g, f), F.lit(""))), lambda n, p: F.coalesce(n, p))
    return F.coalesce(F.array_compact(names), F.array().cast("array<string>"))


def abstract(markup: Column) -> Column:
    """Clean lines: section titles become labels, paragraphs lines, other tags go."""
    tag = r"(?i)<\s*{}(?:\s[^<>]*)?>"
    m = F.regexp_replace(markup, tag.format("jats:title"), "\n")
    m = F.regexp_replace(m, tag.format("/jats:title"), ": ")
    m = F.regexp_replace(m, tag.format("/jats:p"), "\n")
    lines = F.filter(text.plain_texts(F.split(m, "\n")), lambda x: x.isNotNull() & ~x.rlike("^[: ]*$"))
    lines = F.when(F.regexp_replace(F.lower(F.try_element_at(lines, F.lit(1))), ":+$", "") == "abstract", F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
    joined = F.array_join(lines, "\n")
    return text.nonempty(F.when(F.lower(F.substring(joined, 1, 10)) == "abstract: ", F.substring(joined, F.lit(11), F.length(joined))).otherwise(joined))


def partial_date(v: Column, path: str) -> Column:
    """Year, month and day as far as they are integers within range; nothing beyond the first that isn't."""
    outer = array_at(v, f"$['{path}']['date-parts']")
    inner = F.try_element_at(outer, F.lit(1))
    parts = F.try_variant_get(F.when(F.schema_of_variant(inner).startswith("ARRAY"), inner), "$", "array<variant>")

    def number(i: int, low: int, high: int) -> Column:
        p = F.try_element_at(parts, F.lit(i))
        n = F.when(F.schema_of_variant(p) == "BIGINT", F.try_variant_get(p, "$", "bigint"))
        return F.when(n.between(low, high), n)

    y, m, d = number(1, 1000, 9999), number(2, 1, 12), number(3, 1, 31)
    return F.when(d.isNotNull() & m.isNotNull() & y.isNotNull(), F.format_string("%d-%02d-%02d", y, m, d)).when(m.isNotNull() & y.isNotNull(), F.format_string("%d-%02d", y, m)).when(y.isNotNull(), y.cast("string"))


def web_link(c: Column) -> Column:
    return F.when(F.lower(text.strip(c)).rlike("^https?://"), text.strip(c))


def rejected(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """Replies that aren't successful listings."""
    v = F.try_parse_json(F.col(payload))
    good = (string_at(v, "$.status") == "ok") & array_at(v, "$.message.items").isNotNull()
    return replies.where(~F.coalesce(good, F.lit(False)))


def parse(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """Records of replies (qid, payload): qid, pos and the fields of a paper.

    Works without DOI or title, and elements that aren't objects, are skipped.
    """
    v = F.try_parse_json(F.col(payload))
    items = replies.where(F.coalesce(string_at(v, "$.status") == "ok", F.lit(False))).select("qid", F.posexplode(array_at(v, "$.message.items")).alias("pos", "w"))
    w = F.col("w")
    r = items.where(F.schema_of_variant("w").startswith("OBJECT")).select(
        "qid", "pos", text.doi_bare(string_at(w, "$.DOI")).alias("doi"), first_text(w, "$.title").alias("title"), authors(w).alias("authors"),
        abstract(string_at(w, "$.abstract")).alias("abstract"), first_text(w, "$['container-title']").alias("journal"),
        F.coalesce(*[partial_date(w, f) for f in DATE_FIELDS]).alias("publication_date"), web_link(string_at(w, "$.URL")).alias("url"),
    )
    return with_provenance(r.where("doi is not null and title is not null").withColumns({"source": F.lit(NAME), "source_id": F.col("doi")}))


class Crossref(Source):
    """Replies from a snapshot (qid, payload).

    Where the snapshot has the fields of works as columns (``items`` with ``type``), ask ``works`` instead.
    """

    name = NAME

    def __init__(self, replies: DataFrame, rows: int = 20):
        self.replies, self.rows = replies, rows

    @classmethod
    def of(cls, replies: DataFrame, settings: Settings) -> Crossref:
        return cls(replies, settings.crossref_limit)

    def _mine(self, questions: DataFrame) -> DataFrame:
        return self.replies.join(questions.select("qid"), "qid", "left_semi")

    def search(self, questions: DataFrame) -> DataFrame:
        """Records of the replies that are listings; the others are in ``failures``."""
        return with_positions(parse(self._mine(questions)), self.rows)

    def failures(self, questions: DataFrame) -> DataFrame:
        return rejected(self._mine(questions)).select("qid", F.lit("unexpected search response").alias("error"))


def works(table: DataFrame, rows: int = 20) -> DataFrame:
    """Replies (qid, payload) from a table of works (qid, pos, type and the fields of a work as JSON text or columns).

    Only articles of journals are asked for, the fields in ``SELECTED`` and the
    first ``rows`` of a question; filter and projection reach the scan.
    """
    have = [c for c in SELECTED if c in table.columns]
    some = table.where(F.col("type") == ARTICLE_TYPE).select("qid", "pos", *[F.col(f"`{c}`") for c in have])
    w = Window.partitionBy("qid").orderBy("pos")
    some = some.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows)
    items = F.transform(F.array_sort(F.collect_list(F.struct("_r", F.to_json(F.struct(*[F.col(f"`{c}`") for c in have])).alias("j")))), lambda x: x["j"])
    return some.groupBy("qid").agg(F.concat(F.lit('{"status":"ok","message":{"items":['), F.array_join(items, ","), F.lit("]}}")).alias("payload"))
