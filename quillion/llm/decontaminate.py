"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of benchmark items: every run of ``window`` words, or
the whole item where it has fewer. Patterns of one length share a table of
block shifts (a block is up to three words): at each position the block that
ends there says how far the search may jump without passing the end of any
pattern. A shift of zero leads to the bucket of patterns with that suffix
block, narrowed by prefix block, and word-by-word comparison confirms.

Scale: documents are scanned once where they lie, without a shuffle. Patterns
are broadcast in chunks of at most ``CHUNK_WORDS`` words, released when their
pass is over. For a larger benchmark the rows are numbered and written once;
each chunk's pass then reads their texts alone and writes what it hit, and one
join by number brings the hits of all passes to their rows.

Defined results: a null or wordless text has no words and no hits; items that
are null, wordless or without id take no part; equal item ids count once;
every input row gives one output row, so repeated rows repeat; an empty
benchmark leaves everything clean; texts of any length are searched whole;
windows that several items share are hits of each, spans that touch are one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm.common import arrow_map, columns, free
from quillion.session import cut, delete

WINDOW, CHUNK_WORDS, BLOCK = 10, 100_000, 3

#: A-Z become a-z, bytes outside 0-9 a-z 0x80-0xFF become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = {"_n_words": T.LongType(), "_spans": SPANS, "_item_ids": T.ArrayType(T.StringType())}


def words(raw: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs of digits, ASCII letters and non-ASCII."""
    return raw.translate(_TABLE).split() if raw else []


class WuManber:
    """Search for patterns (tuples of words), all of one length."""

    def __init__(self, length: int, patterns: dict[tuple, set]):
        self.length, self.block = length, min(BLOCK, length)
        self.longest = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = {}
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.longest), length - end)
            self.buckets.setdefault(p[-self.block :], {}).setdefault(p[: self.block], []).append((p, items))

    def find(self, ws: list[bytes]) -> Iterator[tuple[int, set]]:
        """(start, items) of each occurrence, from left to right."""
        m, b, shift, longest, n = self.length, self.block, self.shift.get, self.longest, len(ws)
        end = m
        while end <= n:
            key = tuple(ws[end - b : end])
            jump = shift(key, longest)
            if jump:
                end += jump
                continue
            start = end - m
            for p, items in self.buckets[key].get(tuple(ws[start : start + b]), ()):
                if p == tuple(ws[start:end]):
                    yield start, items
            end += 1


def matchers(items: Iterable[tuple[str, list[bytes]]], window: int) -> list[WuManber]:
    """One matcher for each length of pattern among the items."""
    by: dict[int, dict[tuple, set]] = {}
    for item, ws in items:
        m = min(window, len(ws))
        for i in range(len(ws) - m + 1 if m else 0):
            by.setdefault(m, {}).setdefault(tuple(ws[i : i + m]), set()).add(item)
    return [WuManber(m, p) for m, p in sorted(by.items())]


def search(ws: list[bytes], found_by: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """Disjoint spans of words inside occurrences, and the items that occur."""
    hits, items = [], set()
    for matcher in found_by:
        for start, which in matcher.find(ws):
            hits.append((start, start + matcher.length))
            items |= which
    return merged(hits), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def chunks(items: DataFrame, id_col: str, text_col: str, window: int, most: int = CHUNK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in chunks of at most ``most`` words; a longer item is split with overlap."""
    part, held = [], 0
    rows = items.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    for item, raw in rows.toLocalIterator():
        ws = words(bytes(raw))
        for i in range(0, max(1, len(ws) - window + 1), most):
            piece = ws[i : i + most + window - 1]
            if held and held + len(piece) > most:
                yield part
                part, held = [], 0
            if piece:
                part.append((item, piece))
                held += len(piece)
    yield part


def annotate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, chunk_words: int = CHUNK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` and as the last three _n_words, _spans and _item_ids (underscores behind names that are taken).

    _spans are disjoint, sorted ranges of word positions inside occurrences of
    any window; _item_ids the sorted ids of the items with occurring windows.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    carried = list(dict.fromkeys([*keep, text_col]))
    names = [free(c, carried) for c in ADDED]
    added = [T.StructField(n, k) for n, k in zip(names, ADDED.values(), strict=True)]
    df = columns(docs, carried)
    parts = chunks(items, item_id, item_text, window, chunk_words)
    part = next(parts)
    after = next(parts, None)
    if after is None:
        known = spark.sparkContext.broadcast(part)
        return arrow_map(df, _scan(known, window, text_col, keep, names), T.StructType([*[df.schema[c] for c in keep], *added]))
    row = free("_row", [*carried, *names])
    df, numbered = cut(df.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    texts, hits, schema = columns(df, [row, text_col]), [], T.StructType([df.schema[row], *added])
    while part is not None:
        known = spark.sparkContext.broadcast(part)
        found = arrow_map(texts, _scan(known, window, text_col, [row], names), schema)
        # the first pass counts the words of every row, the others give rows with hits
        hits.append(cut(found if not hits else found.where(F.size(names[2]) > 0), "decontaminate-hits"))
        known.unpersist()
        part, after = after, next(parts, None)
    every = hits[0][0]
    for h, _ in hits[1:]:
        every = every.unionByName(h)
    words_, spans, ids = names
    each = every.groupBy(row).agg(F.max(words_).alias(words_), F.flatten(F.collect_list(spans)).alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_list(ids)))).alias(ids))

    def whole(b: pa.RecordBatch) -> dict:
        found = [[{"start": s, "end": e} for s, e in merged((x["start"], x["end"]) for x in all_)] for all_ in b.column(spans).to_pylist()]
        return {row: b.column(row), words_: b.column(words_), spans: found, ids: b.column(ids)}

    out, _ = cut(columns(df.join(arrow_map(columns(each, [row, *names]), whole, schema), row), [*keep, *names]), "decontaminated")
    for path in (numbered, *(p for _, p in hits)):
        delete(spark, path)
    return out


def _scan(known, window: int, text_col: str, cols: list[str], names: list[str]):
    state: dict = {}

    def scan(b: pa.RecordBatch) -> dict:
        if "by" not in state:
            state["by"] = matchers(known.value, window)
        n, spans, ids = [], [], []
        for raw in b.column(text_col).cast(pa.binary()).to_pylist():
            ws = words(raw)
            found, items = search(ws, state["by"])
            n.append(len(ws))
            spans.append([{"start": s, "end": e} for s, e in found])
            ids.append(sorted(items))
        return {c: b.column(c) for c in cols} | dict(zip(names, (n, spans, ids), strict=True))

    return scan


def digest(annotated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``annotate``."""
    words, spans, ids = annotated.columns[-3:]
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return annotated.select(
        id_col,
        F.col(words).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """Rows of ``docs`` in which no benchmark window occurs, with their columns."""
    found = annotate(docs, items, **kw)
    return columns(found.where(F.size(found.columns[-2]) == 0), docs.columns)


def brute(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, int, str]:
    """What ``digest`` gives for one text, by comparing every window everywhere (for tests)."""
    ws = words(None if text is None else text.encode())
    hit, ids = set(), set()
    for item, t in items:
        iw = words(None if t is None else t.encode())
        m = min(window, len(iw))
        for i in range(len(iw) - m + 1 if m else 0):
            for j in range(len(ws) - m + 1):
                if ws[j : j + m] == iw[i : i + m]:
                    hit.update(range(j, j + m))
                    ids.add(str(item))
    return len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillion.session import read

    return digest(annotate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"]))


#: The same by joining windows as strings.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bl AS (SELECT item, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
bi AS (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bl),
bw AS (SELECT DISTINCT item, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s FROM bi),
ms AS (SELECT DISTINCT m FROM bl),
di AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m),
dw AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s FROM di),
h AS (SELECT doc_id, dw.m AS m, i, item FROM dw JOIN bw ON dw.m = bw.m AND dw.s = bw.s),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM h),
np AS (SELECT doc_id, count(*) AS n FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(np.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(np.n, 0) > 0 AS contaminated
FROM d LEFT JOIN np ON np.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
