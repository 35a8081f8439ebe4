"""Vector code compression: product codes by Lloyd's rounds with Elkan's bounds.

Components become integers, vectors are cut into consecutive parts, and each
part position has a codebook of at most 256 entries. A round assigns every
part to its nearest entry and moves each entry to the floor of its parts' mean.
All distances are squared in integers, so ties are ties and the lower index
has them whatever the order of work.

Elkan's method: for each part a table in the shared folder keeps its entry, an
upper bound of the distance to it and a lower bound of the distance to every
entry. The next round adds an entry's movement to upper bounds and takes it off
lower bounds; a part is left alone when its upper bound is under half the
distance of its entry to any other one, and an entry is compared only when
neither its lower bound nor half its distance to the part's entry exceeds the
upper bound. Both tests are strict and bounds are rounded outwards, so no entry
at an equal distance is skipped.

A lower bound is kept as one of ``STEPS`` multiples of its part's upper bound,
rounded down: half a byte an entry, as exact values would take 32 times a
vector's own size. Two such tables lie in the shared folder at a time.

Sums and counts are added up in each task before they are shuffled: a row for
each entry and task. The driver holds the codebooks, whose size is that of 256
vectors; they are the only thing that is broadcast.

Defined results: vectors that are null, empty or hold null or non-finite
components are dropped, as are those of another length than most; magnitudes
over 2**40 count as that; lengths that can't be divided give the first parts
one component more; repeated rows count as often as they are there; of rows
with one id the smallest vector is its entry; rows without id are coded but
aren't entries (without any id there is no codebook and no row); an error
beyond the range of long is its largest value; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion.llm.common import arrow_map, columns, free, small_batches
from quillion.llm.vectors import LIMIT, exact, integers, matrix
from quillion.session import cut, delete, read

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Multiples of the upper bound that a lower bound is rounded down to.
STEPS = np.array([0, 1.0, 1.03, 1.06, 1.1, 1.15, 1.2, 1.26, 1.33, 1.42, 1.54, 1.7, 1.95, 2.3, 2.9, 4.0])
#: Relative room that outward rounding leaves for the errors of floating point.
ROOM = 1e-12
LONG = (1 << 63) - 1


def bounds_of(d: int, parts: int) -> list[tuple[int, int]]:
    """Where each part begins and ends."""
    ends = np.cumsum([len(p) for p in np.array_split(np.arange(d), parts)])
    return [(int(e - n), int(e)) for e, n in zip(ends, np.diff([0, *ends]), strict=True)]


def above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + ROOM)


def below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - ROOM)


def all_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each of c, exact."""
    kind = exact(2 * int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))), x.shape[1])
    if kind is np.float64:
        a, b = x.astype(kind), c.astype(kind)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    a, b = x.astype(kind), c.astype(kind)
    return np.array([((b - row) ** 2).sum(1) for row in a], dtype=kind).reshape(len(a), len(b))


def pair_distances(x: np.ndarray, c: np.ndarray, rows: np.ndarray | None = None, entries: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of x[rows] to c[entries] (all of both without them), one by one, exact."""
    kind = exact(2 * int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))), x.shape[1])
    a, b = x.astype(kind), c.astype(kind)
    gap = (a if rows is None else a[rows]) - (b if entries is None else b[entries])
    if kind is object:
        return (gap * gap).sum(1) if x.shape[1] else np.zeros(len(gap), np.int64)
    return np.einsum("ij,ij->i", gap, gap).astype(np.int64)


def packed(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Lower bounds as steps, two to a byte."""
    step = np.searchsorted(STEPS, lower / np.maximum(upper, 1)[:, None], side="right") - 1
    step = np.maximum(step, 0).astype(np.uint8)
    if step.shape[1] % 2:
        step = np.pad(step, ((0, 0), (0, 1)))
    return step[:, ::2] | step[:, 1::2] << 4


def unpacked(data: np.ndarray, upper: np.ndarray, entries: int) -> np.ndarray:
    step = np.stack([data & 15, data >> 4], 2).reshape(len(data), -1)[:, :entries]
    return STEPS[step] * np.maximum(upper, 1)[:, None]


class Moved:
    """What a pass needs to know of one part's codebook: entries, half distances among them, how far each has moved."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None) -> None:
        self.entries = entries
        self.half = below(all_distances(entries, entries)) / 2
        np.fill_diagonal(self.half, np.inf)
        self.nearest = self.half.min(1)
        self.moved = np.zeros(len(entries)) if before is None else above(pair_distances(entries, before))


def first_pass(x: np.ndarray, book: Moved) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, upper, lower, squared distance) of each row, from all distances."""
    d = all_distances(x, book.entries)
    code = d.argmin(1)
    best = d[np.arange(len(x)), code]
    return code, above(best), below(d), best


def next_pass(x: np.ndarray, book: Moved, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """As first_pass, comparing only what the bounds don't exclude; counts the distances taken. Squared distances are right for all rows in the last pass only."""
    upper = (upper + book.moved[code]) * (1 + ROOM)
    lower = np.maximum(lower - book.moved - ROOM * (lower + book.moved), 0)
    open_ = np.flatnonzero(~(upper < book.nearest[code]))
    own = np.arange(len(x)) if last else open_
    exact_own = pair_distances(x, book.entries, own, code[own])
    best = np.zeros(len(x), exact_own.dtype)
    best[own] = exact_own
    upper[own] = above(exact_own)
    was, rows = code[open_], np.arange(len(open_))
    may = (lower[open_] <= upper[open_][:, None]) & (book.half[was] <= upper[open_][:, None])
    r, j = np.nonzero(may)
    d = pair_distances(x, book.entries, open_[r], j)
    lower[open_[r], j] = below(d)
    lower[open_, was] = below(best[open_])
    table = np.full(may.shape, LONG, np.result_type(d, best) if d.dtype != object and best.dtype != object else object)
    if table.dtype == object:
        table[:] = 1 << 200
    table[r, j] = d
    table[rows, was] = best[open_]
    code = code.copy()
    code[open_] = table.argmin(1) if len(open_) else was
    best = best.astype(table.dtype)
    best[open_] = table[rows, code[open_]]
    upper[open_] = above(best[open_])
    return code, upper, lower, best, len(own) + len(r)


def assigned(rows: DataFrame, books: list[np.ndarray], before: list[np.ndarray] | None, last: bool = False) -> DataFrame:
    """One assignment of every part: a table with codes, upper, lower (error in the last one) beside the columns of ``rows``.

    ``rows`` without codes get all distances; with them, those that bounds leave open.
    """
    spark = rows.sparkSession
    carried = [c for c in rows.columns if c not in ("codes", "upper", "lower", "taken")]
    started = "codes" in rows.columns
    known = spark.sparkContext.broadcast([Moved(b, before[p] if before else None) for p, b in enumerate(books)])
    entries = len(books[0])
    width = (entries + 1) // 2
    cuts = bounds_of(sum(b.shape[1] for b in books), len(books))

    def step(b: pa.RecordBatch) -> dict[str, list]:
        x, n = matrix(b.column("vec")), b.num_rows
        codes, uppers, lowers, error, taken = np.empty((n, len(cuts)), np.uint8), np.empty((n, len(cuts))), np.empty((n, len(cuts), width), np.uint8), np.zeros(n, object), 0
        if started:
            fixed = lambda name, kind: np.frombuffer(b"".join(b.column(name).to_pylist()), kind).reshape(n, len(cuts), -1)
            old_codes, old_uppers, old_lowers = fixed("codes", np.uint8)[:, :, 0], fixed("upper", np.float64)[:, :, 0], fixed("lower", np.uint8)
        for p, (a, z) in enumerate(cuts):
            if started:
                lower = unpacked(old_lowers[:, p], old_uppers[:, p], entries)
                code, upper, lower, best, count = next_pass(x[:, a:z], known.value[p], old_codes[:, p].astype(np.int64), old_uppers[:, p], lower, last)
            else:
                code, upper, lower, best = first_pass(x[:, a:z], known.value[p])
                count = n * entries
            codes[:, p], uppers[:, p], taken = code, upper, taken + count
            error += best.astype(object)
            if not last:
                lowers[:, p] = packed(lower, upper)
        out = {c: b.column(c) for c in carried}
        out["codes"] = [c.tobytes() for c in codes]
        if last:
            return out | {"error": [min(int(e), LONG) for e in error]}
        return out | {"upper": [u.tobytes() for u in uppers], "lower": [v.tobytes() for v in lowers], "taken": [taken] + [0] * (n - 1)}

    if last:
        carried = [c for c in carried if c != "vec"]
    more = "codes binary, error long" if last else "codes binary, upper binary, lower binary, taken long"
    schema = columns(rows, carried).schema
    for f in more.split(", "):
        schema = schema.add(*f.split())
    return arrow_map(rows, step, schema)


def sums(rows: DataFrame, parts: int, entries: int, d: int) -> list[list[tuple[int, list[int]] | None]]:
    """For each part and entry: how many parts it has, and their componentwise sums (None: unused).

    Each task adds up what it reads; one aggregation adds up the tasks' rows.
    """
    cuts = bounds_of(d, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), [np.zeros((entries, z - a), np.int64) for a, z in cuts]
        for b in batches:
            if b.num_rows:
                x, codes = matrix(b.column("vec")), np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(b.num_rows, parts).astype(np.int64)
                for p, (a, z) in enumerate(cuts):
                    count[p * entries : (p + 1) * entries] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(total[p], codes[:, p], x[:, a:z])
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([[int(count[s]), *total[s // entries][s % entries].tolist()] for s in used], pa.list_(pa.int64()))], ["slot", "sums"])

    small_batches(rows.sparkSession)
    found = rows.select("vec", "codes").mapInArrow(run, "slot long, sums array<long>").select("slot", F.posexplode("sums")).groupBy("slot", "pos").agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("s"))
    out: list[list] = [[None] * entries for _ in range(parts)]
    for r in sorted(found.collect()):  # a row for each component of each entry
        p, e = divmod(r["slot"], entries)
        if r["pos"] == 0:
            out[p][e] = (int(r["s"]), [])
        else:
            out[p][e][1].append(int(r["s"]))
    return out


def seeds(rows: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the smallest ids."""
    ids = [r["id"] for r in rows.select("id").where(F.col("id").isNotNull()).distinct().orderBy("id").limit(entries).collect()]
    found = rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("vec").alias("vec")).orderBy("id").collect() if ids else []
    return np.array([r["vec"] for r in found], np.int64)


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, trace: list | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks): for each kept row its id, the columns ``keep``, codes (binary, a byte a part) and error.

    ``trace``, if given, receives the number of distances that each pass but the last took.
    """
    spark = vectors.sparkSession
    rows, path = cut(integers(vectors, scale, id_col, vec_col, keep), "code-vectors", compression="zstd")
    first = seeds(rows, entries)
    names = [*keep, free("codes", [id_col, *keep]), free("error", [id_col, *keep])]
    if not len(first):
        out = rows.limit(0).select("id", *[f"c{k}" for k in range(len(keep))], F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error"))
        return out.toDF(id_col, *names), []
    d = first.shape[1]
    books, before, had = [first[:, a:z] for a, z in bounds_of(d, parts)], None, path
    for _ in range(rounds):
        rows, path = cut(assigned(rows, books, before), "code-bounds", compression="zstd")
        delete(spark, had)
        had = path
        if trace is not None:
            trace.append(rows.agg(F.sum("taken")).first()[0])
        found = sums(rows, parts, len(first), d)
        before, books = books, [np.array([[s // f[0] for s in f[1]] if (f := found[p][e]) else old[e].tolist() for e in range(len(old))], np.int64).reshape(old.shape) for p, old in enumerate(books)]
    out, _ = cut(assigned(rows, books, before, last=True), "codes")
    delete(spark, had)
    return out.select("id", *[f"c{k}" for k in range(len(keep))], "codes", "error").toDF(id_col, *names), books


def decode(codes: DataFrame, books: list[np.ndarray], codes_col: str = "codes", scale: int = SCALE) -> DataFrame:
    """``codes`` with decoded (array of double): each part's entry, scaled back to the middle of its floors."""
    tables = [F.array(*[F.array(*[F.lit((int(v) + 0.5) / scale) for v in e]) for e in b]) for b in books]
    at = lambda p: F.conv(F.hex(F.substring(F.col(codes_col), p + 1, 1)), 16, 10).cast("int")
    return codes.withColumn(free("decoded", codes.columns), F.flatten(F.array(*[F.get(t, at(p)) for p, t in enumerate(tables)])))


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def op11_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(read(spark, sf_dir, "embeddings"), keep=("label",))
    sums_ = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("s")).select(F.col("label").alias("l"), F.least("s", F.lit(LONG).cast("decimal(30,0)")).cast("long").alias("label_error"))
    return coded.join(sums_, F.col("label").eqNullSafe(F.col("l"))).select(F.col("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Lloyd's rounds written out: every distance in every round."""
    w = [
        f"""x AS MATERIALIZED (
  SELECT r, vec_id, label, part, list_transform(list_slice(v, part * (len(v) // {PARTS}) + 1, (part + 1) * (len(v) // {PARTS})), lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS q
  FROM (SELECT row_number() OVER () AS r, vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0), (SELECT unnest(range({PARTS})) AS part)
)""",
        f"b0 AS MATERIALIZED (SELECT part, e - 1 AS e, q FROM (SELECT part, q, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS e FROM x) WHERE e <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        w.append(
            f"""a{k} AS MATERIALIZED (
  SELECT r, part, min(d * {ENTRIES} + e) // {ENTRIES} AS d, min(d * {ENTRIES} + e) % {ENTRIES} AS e
  FROM (SELECT r, x.part, e, CAST(list_sum(list_transform(list_zip(x.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x JOIN b{k} b USING (part)) GROUP BY r, part
)"""
        )
        if k < ROUNDS:
            w.append(
                f"""b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.e, coalesce(m.q, b.q) AS q FROM b{k} b LEFT JOIN (
    SELECT part, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS q
    FROM (SELECT part, e, i, sum(v) AS s, count(*) AS n FROM (SELECT a.part, a.e, unnest(x.q) AS v, generate_subscripts(x.q, 1) AS i FROM a{k} a JOIN x USING (r, part)) GROUP BY part, e, i) GROUP BY part, e
  ) m USING (part, e)
)"""
            )
    return (
        "WITH "
        + ",\n".join(w)
        + f""",
c AS (
  SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', a.e), '' ORDER BY part) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM a{ROUNDS} a JOIN x USING (r, part) GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, e, i)) FROM (SELECT part, e, unnest(q) AS v, generate_subscripts(q, 1) AS i FROM b{ROUNDS})) AS codebooks_sha256
FROM c
"""
    )


OP11_SQL = _sql()
