"""URL filters: ordered rules first, then a list of blocked domains and addresses as a Bloom filter cascade.

A url's keys are its host, each parent domain of the host, and host with path.
It is on the list if any of them is. The key universe is every key of every url
of the corpus, with the listed keys: the filters are built for it, so they
answer for it without error, and no page is ever joined with the list.

Level 1 encodes the listed keys; level 2 the other keys that level 1 lets
through by mistake; level 3 the listed keys that level 2 lets through; and so
on until a level lets nothing through. The first level a key fails tells: at an
odd level it isn't listed, at an even level it is. The first level's rate of
mistakes is sqrt(1/2) listed/others, that of all later ones 1/2, so each set is
about half as large as the last but one, and the levels together take some
1.44 log2(others/listed) + 5 bits a listed key.

Keys are distinct 128-bit hashes, one exchange with a combiner before it, and
stay in tables of the shared folder; a level is built by one job (bits set in
each task, or-ed by an aggregation) and tested by the next. When at most
``FEW`` keys are left the driver builds the rest. Filters are broadcast: a
universe whose filters would take over ``MOST_BITS`` is cut into shards by hash,
each with a cascade of its own, and each shard's pass over the keys holds one.

Defined results: a null url or one without ``://`` has an empty host and path,
no rule and no key, so it is allowed; A-Z is lower-cased in hosts, ports and
user names stay where they are; a host of over 253 characters is no domain name
and has no parent domains; whole urls are read however long; of equally long
rules that fit the first in the alphabet wins; equal rules agree or the
first one holds; null listed keys are none, repeated ones count once; repeated
rows repeat; other columns pass through whatever their names (what is added
takes underscores); an empty table gives an empty one, an empty list allows
what no rule blocks.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion.llm.common import free, small_batches
from quillion.session import cut, delete, read

#: Bits of one shard's cascade, bytes of a piece of a level, keys that the driver finishes, characters of the longest domain name.
MOST_BITS, PIECE, FEW, LONGEST_HOST = 1 << 28, 4096, 1 << 12, 253
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit number for each."""
    h = (h ^ (h >> np.uint64(30))) * MIX[1]
    h = (h ^ (h >> np.uint64(27))) * MIX[2]
    return h ^ (h >> np.uint64(31))


@dataclass
class Level:
    """A Bloom filter: ``hashes`` bits of ``bits`` for each key, in a way of its own for each ``depth``."""

    depth: int
    hashes: int
    size: int
    bits: np.ndarray = field(repr=False)

    @staticmethod
    def empty(depth: int, keys: int, rate: float) -> Level:
        hashes = max(1, round(-math.log2(rate)))
        # the size at which so many hashes let through the rate
        size = max(64, math.ceil(-hashes * keys / math.log1p(-(rate ** (1 / hashes)))))
        return Level(depth, hashes, size, np.zeros(math.ceil(size / (8 * PIECE)) * PIECE, np.uint8))

    def places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            salt = np.uint64(self.depth) * MIX[0]
            a, b = mixed(h1.view(np.uint64) + salt), mixed(h2.view(np.uint64) ^ salt) | np.uint64(1)
            for k in range(self.hashes):
                yield (a + np.uint64(k) * b) % np.uint64(self.size)

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for at in self.places(h1, h2):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7), dtype=np.uint8, casting="unsafe"))

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for at in self.places(h1, h2):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys are listed: exact for the keys that the levels were built for."""
    out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
    for level in levels:
        ok = level.passes(h1[open_], h2[open_])
        out[open_[~ok]] = level.depth % 2 == 0
        open_ = open_[ok]
    out[open_] = len(levels) % 2 == 1
    return out


def first_rate(members: int, others: int) -> float:
    return min(0.5, math.sqrt(0.5) * members / others) if others else 0.5


def finished(levels: list[Level], a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> list[Level]:
    """The levels that are left, for few keys: a is what the next level encodes, b what it must not let through."""
    levels = list(levels)
    while len(a[0]) and (len(b[0]) or not levels):
        level = Level.empty(len(levels) + 1, len(a[0]), 0.5 if levels else first_rate(len(a[0]), len(b[0])))
        level.add(*a)
        levels.append(level)
        through = level.passes(*b)
        a, b = (b[0][through], b[1][through]), a
    return levels


def _built(keys: DataFrame, level: Level) -> Level:
    """The level with the bits of all keys: each task sets its own, one aggregation joins them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Level(level.depth, level.hashes, level.size, np.zeros(pieces * PIECE, np.uint8))
        for b in batches:
            if b.num_rows:
                mine.add(b.column("h1").to_numpy(), b.column("h2").to_numpy())
        for k in np.flatnonzero(mine.bits.reshape(-1, PIECE).any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([mine.bits[k * PIECE : (k + 1) * PIECE].tobytes()])], ["piece", "bits"])

    pieces = len(level.bits) // PIECE
    level, whole = Level(level.depth, level.hashes, level.size, np.zeros(0, np.uint8)), np.zeros((pieces, PIECE), np.uint8)
    for r in keys.select("h1", "h2").mapInArrow(run, "piece long, bits binary").groupBy("piece").agg(F.bitmap_or_agg("bits").alias("bits")).collect():  # at most MOST_BITS in all
        whole[r["piece"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return Level(level.depth, level.hashes, level.size, whole.ravel())


def _through(keys: DataFrame, level: Level) -> tuple[DataFrame, str]:
    """The keys that the level lets through, as a table."""
    spark = keys.sparkSession
    known = spark.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(known.value.passes(b.column("h1").to_numpy(), b.column("h2").to_numpy())))

    out = cut(keys.mapInArrow(run, keys.schema), "url-level")
    known.unpersist()
    return out


def _pair(keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = keys.select("h1", "h2").collect()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def cascade(keys: DataFrame, few: int = FEW) -> list[Level]:
    """The levels for distinct keys (h1, h2, listed), a table that can be read again."""
    small_batches(keys.sparkSession)
    counts = {r["listed"]: r["count"] for r in keys.groupBy("listed").count().collect()}
    a, b, n, m = keys.where("listed"), keys.where("NOT listed"), counts.get(True, 0), counts.get(False, 0)
    levels: list[Level] = []
    paths: list[str] = []
    while n + m > few and n and (m or not levels):
        levels.append(_built(a, Level.empty(len(levels) + 1, n, 0.5 if levels else first_rate(n, m))))
        through, path = _through(b, levels[-1])
        paths.append(path)
        a, b, n, m = through, a, through.count(), n
    if n and (m or not levels):
        levels = finished(levels, _pair(a), _pair(b))
    for p in paths:
        delete(keys.sparkSession, p)
    return levels


def shards_of(members: int, others: int, most_bits: int = MOST_BITS) -> int:
    bits = members * (1.45 * max(1.0, -math.log2(first_rate(max(1, members), others))) + 6)
    return max(1, math.ceil(bits / most_bits))


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def url_keys(host: Column, path: Column) -> Column:
    """Host, parent domains (of domain names), host with path."""
    labels = F.split(host, r"\.")
    domains = F.when(F.length(host) <= LONGEST_HOST, F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).otherwise(F.array(host))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, F.array(F.concat(host, path)))))


def hashes(keys: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of each key."""
    return F.transform(keys, lambda k: F.xxhash64(k)), F.transform(keys, lambda k: F.xxhash64(F.lit("second"), k))


def universe(keys: DataFrame, list_: DataFrame) -> DataFrame:
    """Distinct keys (h1, h2, listed) of the corpus (h1 and h2, arrays) and of the list (key)."""
    seen = keys.select(F.explode(F.arrays_zip("h1", "h2")).alias("k")).select("k.h1", "k.h2", F.lit(False).alias("listed"))
    one = list_.select(F.col(list_.columns[0]).cast("string").alias("key")).where(F.col("key").isNotNull())
    given = one.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), F.lit(True).alias("listed"))
    return seen.unionByName(given).groupBy("h1", "h2").agg(F.max("listed").alias("listed"))


def _member(spark: SparkSession, levels: list[Level]):
    """A function of two arrays of hashes: is any key listed?"""
    known = spark.sparkContext.broadcast(levels)

    @F.arrow_udf("boolean")
    def member(h1: pa.Array, h2: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(h1.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        hit = listed(known.value, h1.flatten().to_numpy(zero_copy_only=False), h2.flatten().to_numpy(zero_copy_only=False))
        total = np.concatenate([[0], np.cumsum(hit)])
        return pa.array(total[ends[1:]] > total[ends[:-1]])

    return member


def filter_urls(pages: DataFrame, list_: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", few: int = FEW, most_bits: int = MOST_BITS) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``list_`` has a column of blocked keys: domains (with all subdomains) or
    host and path. ``rules`` are (allow or block, host and path prefix).
    """
    spark = pages.sparkSession
    names = [free(n, pages.columns) for n in ("host", "path", "rule", "verdict")]
    t = pages.toDF(*[f"c{k}" for k in range(len(pages.columns))])
    host, path = host_path(F.col(f"c{pages.columns.index(url_col)}"))
    t = t.withColumns({"host": host, "path": path})
    h1, h2 = hashes(url_keys(F.col("host"), F.col("path")))
    t = t.withColumns({"h1": h1, "h2": h2})
    keys, kept = cut(universe(t, list_), "url-keys")
    counts = {r["listed"]: r["count"] for r in keys.groupBy("listed").count().collect()}
    n = shards_of(counts.get(True, 0), counts.get(False, 0), most_bits)
    shard = lambda h: F.pmod(F.hash(h), F.lit(n))

    def of(k: int) -> Column:
        """The pairs of hashes of a url's keys that lie in shard k."""
        pairs = F.arrays_zip("h1", "h2")
        return F.filter(pairs, lambda z: shard(z["h1"]) == k) if n > 1 else pairs

    hit = F.lit(False)
    for k in range(n):
        levels = cascade(keys.where(shard(F.col("h1")) == k), few)
        hit = hit | _member(spark, levels)(F.transform(of(k), lambda z: z["h1"]), F.transform(of(k), lambda z: z["h2"]))
    delete(spark, kept)
    ordered = sorted(dict(reversed([(text, verdict) for verdict, text in rules])).items(), key=lambda r: (-len(r[0]), r[0]))
    fits = lambda text: ((F.col("host") == (at := text.partition("/"))[0]) | F.endswith(F.col("host"), F.lit("." + at[0]))) & F.startswith(F.col("path"), F.lit(at[1] + at[2]))
    first = lambda pick: F.coalesce(*[F.when(fits(r[0]), F.lit(r[pick])) for r in ordered], F.lit(None).cast("string"))
    t = t.withColumns({"rule": first(0), "ruled": first(1), "hit": hit})
    out = t.withColumn("verdict", F.coalesce("ruled", F.when(F.col("hit"), "block").otherwise("allow")))
    return out.select(*[f"c{k}" for k in range(len(pages.columns))], "host", "path", "rule", "verdict").toDF(*pages.columns, *names)


#: Rules of the query, and names of domains that it blocks under any parent.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
BLOCKED = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def named_domains(pages: DataFrame, names: list[str], url_col: str = "url") -> DataFrame:
    """The corpus's domains whose first label is one of ``names``."""
    host, _ = host_path(F.col(url_col))
    return pages.select(host.alias("host")).distinct().select(F.explode(url_keys(F.col("host"), F.lit(""))).alias("key")).where(F.split("key", r"\.")[0].isin(names)).distinct()


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    out = filter_urls(pages, named_domains(pages, BLOCKED), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


OP13_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), r(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')
), f AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM u) JOIN r ON ('.' || host LIKE '%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY page_id
)
SELECT u.page_id, host, path, f.rule,
       coalesce(f.verdict, CASE WHEN len(list_intersect(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f USING (page_id)
"""
