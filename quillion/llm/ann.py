"""Approximate nearest neighbours by learned partitions.

Fitting uses at most ``SAMPLE`` distinct vectors (smallest hashes of their
ids): their exact neighbour graph is split into balanced parts that cut few
edges (seeded by recursive bisection, improved by moves along edges within a
size limit); a small classifier, trained by gradient steps in numpy, then
learns to tell a vector's part, and the parts of its neighbours.

Every vector is indexed in the part the classifier finds most probable; a query
goes to the most probable parts, as many as found ``TARGET`` of the nearest
neighbours of an eighth of the sample that was not fitted on, and the exact cosine, in double
precision, ranks what is there. Parts are dealt into blocks of about
``BLOCK_ROWS`` candidates and queries into blocks of ``BLOCK_QUERIES``, so a
task's memory is bounded whatever the size of a part; each task returns the k
best for each of its queries, which one aggregation by query merges.

Equal vectors are indexed once with their ``k + 1`` smallest ids: more of them
can't be among the k nearest of any query, ties going to the smaller id, so a
vector that a third of all rows share costs no more than another.

Broadcast are the classifier's weights: parts times dimensions, both bounded.

Defined results: vectors that are null, zero, of another length than most, or
hold a null or non-finite component take no part; repeated ids count once; a
query has fewer than k rows only if there are fewer candidates in all, as one
whose parts hold too few goes on to the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm.common import small_batches
from quillion.session import cut, delete, read

NEAREST, SAMPLE, DEGREE, TARGET, LEAST_PARTS, MOST_PARTS, ROWS_PER_PART = 5, 8192, 10, 0.96, 8, 256, 2048
BLOCK_ROWS, BLOCK_QUERIES, HIDDEN, EPOCHS = 8192, 2048, 64, 30


def graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Indices of the ``degree`` nearest other rows of each row (unit rows), by blocks."""
    out = np.empty((len(x), degree), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        out[at : at + len(s)] = np.argpartition(-s, degree - 1, 1)[:, :degree]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """A part for each vertex of the neighbour graph: sizes within ``slack`` of equal, few edges cut."""
    rng = np.random.default_rng(seed)
    n = len(x)
    part = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:  # halves along the main direction of what is to be split
        idx, first, k = todo.pop()
        if k == 1:
            part[idx] = first
            continue
        y = x[idx] - x[idx].mean(0)
        v = rng.normal(size=x.shape[1])
        for _ in range(8):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) + 1e-12
        order = np.argsort(y @ v, kind="stable")
        a = k // 2
        half = len(idx) * a // k
        todo += [(idx[order[:half]], first, a), (idx[order[half:]], first + a, k - a)]
    limit = int(np.ceil(slack * n / parts))
    src = np.concatenate([np.repeat(np.arange(n), near.shape[1]), near.ravel()])
    dst = np.concatenate([near.ravel(), np.repeat(np.arange(n), near.shape[1])])
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    starts = np.searchsorted(src, np.arange(n + 1))
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[dst[starts[i] : starts[i + 1]]], minlength=parts)
            here = part[i]
            votes = np.where((size < limit) | (np.arange(parts) == here), votes, -1)
            to = int(votes.argmax())
            if votes[to] > votes[here]:
                part[i] = to
                size[here] -= 1
                size[to] += 1
                moved += 1
        if moved < n // 200:
            break
    return part


def train_router(x: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 3) -> list[np.ndarray]:
    """Weights of a classifier with one hidden layer: targets are the parts of a vector and of its neighbours."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    target = np.zeros((n, parts))
    target[np.arange(n), part] += 1
    np.add.at(target, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1 / near.shape[1])
    target /= target.sum(1, keepdims=True)
    w = [rng.normal(0, np.sqrt(2 / d), (d, hidden)) * np.sqrt(d), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(n), max(1, n // 256)):
            h = np.maximum(x[batch] @ w[0] + w[1], 0)
            p = softmax(h @ w[2] + w[3])
            dz = (p - target[batch]) / len(batch)
            dh = (dz @ w[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((x[batch].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def routed(x: np.ndarray, w: list[np.ndarray]) -> np.ndarray:
    """Parts of each row, most probable first."""
    z = np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]
    return np.argsort(-z, 1, kind="stable")


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vec (array of double) of the rows that take part, ids once."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") > 0))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.where(F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda c: c != 0))
    size = v.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = size[0]["d"] if size else 0
    return v.where(F.size("vec") == d).groupBy("id").agg(F.min("vec").alias("vec"))


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)


def fit(distinct: DataFrame, total: int, sample: int = SAMPLE, k: int = NEAREST, target: float = TARGET) -> tuple[list[np.ndarray], int]:
    """The router's weights and how many parts to probe, from at most ``sample`` of ``distinct`` (ids, vec)."""
    rows = distinct.select(F.element_at("ids", 1).alias("id"), "vec").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    x = unit([r["vec"] for r in rows]) if rows else np.zeros((0, 1))
    test, x = x[::8], np.delete(x, np.s_[::8], 0)
    parts = min(MOST_PARTS, max(LEAST_PARTS, total // ROWS_PER_PART), len(x) // 16)
    if parts < 2:
        return [np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1
    near = graph(x, min(DEGREE, len(x) - 1))
    weights = train_router(x, near, balanced_parts(x, near, parts), parts)
    home, order = routed(x, weights)[:, 0], routed(test, weights)
    best = np.argsort(-(test @ x.T), 1)[:, :k]
    # for each neighbour, the place of its part in the query's order
    place = np.argsort(order, 1)[np.arange(len(test))[:, None], home[best]]
    found = np.array([(place < n).mean() for n in range(1, parts + 1)])
    return weights, int(np.argmax(found >= target)) + 1


def _assigned(df: DataFrame, weights: list[np.ndarray], probes: int) -> DataFrame:
    """``df`` with the ``probes`` most probable parts of each vec."""
    spark = df.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast(weights)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(b.column("vec").to_pylist())
                parts = routed(x, known.value)[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(parts), pa.list_(pa.int32()))], [*b.schema.names, "parts"])

    return df.mapInArrow(rows, T.StructType([*df.schema.fields, T.StructField("parts", T.ArrayType(T.IntegerType()))]))


def block_search(t: pa.Table, k: int) -> pa.Table:
    """The k nearest of one block's candidates for each of its queries.

    Scores of the best are computed anew, one pair at a time in one order, so
    that they don't depend on the block.
    """
    side = t.column("side").to_numpy()
    q, c = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
    out: dict[str, list] = {"query": [], "nearest": []}
    if q.num_rows and c.num_rows:
        qv, cv = np.array(q.column("vec").to_pylist(), np.float64), np.array(c.column("vec").to_pylist(), np.float64)
        qu, cu = unit(qv), unit(cv)
        cids = c.column("ids").to_pylist()
        first = np.array([i[0] for i in cids])
        for i, (qid, s) in enumerate(zip(q.column("ids").to_pylist(), qu @ cu.T, strict=True)):
            some = np.argpartition(-s, k)[: k + 1] if len(s) > k + 1 else np.arange(len(s))
            some = np.flatnonzero(s >= s[some].min() - 1e-12)  # ties stay
            exact = cosines(qv[i], cv[some])
            best: list[tuple[float, int]] = []
            for j in np.lexsort((first[some], -exact)):
                best += [(float(exact[j]), v) for v in cids[some[j]]]
                if len(best) > 2 * k and exact[j] < best[k][0]:
                    break
            best.sort(key=lambda b: (-b[0], b[1]))
            out["query"].append(qid[0])
            out["nearest"].append([{"score": a, "id": v} for a, v in best[: k + 1]])
    return pa.table(out, schema=pa.schema([("query", pa.int64()), ("nearest", pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())])))]))


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of q with each row of c, in double precision."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        got = (c * q).sum(1) / (np.sqrt((c * c).sum(1)) * np.sqrt((q * q).sum()))
    odd = ~np.isfinite(got)
    if odd.any():  # lengths out of range: scale first
        got[odd] = (unit(c[odd]) * unit([q])).sum(1)
    return np.clip(got, -1, 1)


def _order(x, y):
    """Nearest first, ties to the smaller id."""
    return F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)


def probed(asked: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """(query, nearest): the k + 1 best of ``placed`` (vec, ids, part) for each of ``asked`` (vec, ids, parts)."""
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    loads = asked.select(F.explode("parts").alias("part")).groupBy("part").agg(F.count("*").alias("m"))
    plan = sizes.join(loads, "part").select("part", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("cb"), F.ceil(F.col("m") / BLOCK_QUERIES).cast("int").alias("qb"))
    plan = F.broadcast(plan)  # a row for each part, at most MOST_PARTS
    h = F.xxhash64(F.element_at("ids", 1))
    cand = placed.join(plan, "part").select("part", F.pmod(h, F.col("cb")).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), F.lit(1).alias("side"), "ids", "vec")
    ask = asked.select("vec", "ids", F.explode("parts").alias("part")).join(plan, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("cb") - 1)).alias("c"), F.pmod(h, F.col("qb")).cast("int").alias("q"), F.lit(0).alias("side"), "ids", "vec")
    small_batches(placed.sparkSession)
    found = cand.unionByName(ask).groupBy("part", "c", "q").applyInArrow(lambda t: block_search(t, k), "query long, nearest array<struct<score:double,id:long>>")
    return found.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("nearest")), _order), 1, k + 1).alias("nearest"))


def search(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEAREST, every: int = 50, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """The k nearest other rows of each query: query_id, rank, vec_id, score.

    Without ``queries`` (a column of ids) those are the rows whose id is divisible by ``every``.
    """
    paths: list[str] = []
    rows, path = cut(usable(vectors, id_col, vec_col), "vectors")
    lasting = [path]
    # equal vectors: their k + 1 smallest ids. Salted, then merged.
    ids = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32)))
    least = lambda c: F.slice(F.sort_array(c), 1, k + 1)
    ranked = ids.withColumn("r", F.row_number().over(Window.partitionBy("vec", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    distinct = ranked.groupBy("vec").agg(least(F.collect_list("id")).alias("ids"))
    distinct, path = cut(distinct, "distinct")
    paths.append(path)
    n_ids = rows.count()
    weights, probes = fit(distinct, distinct.count(), sample, k, target)
    placed, path = cut(_assigned(distinct, weights, 1).select("vec", "ids", F.element_at("parts", 1).alias("part")), "placed")
    paths.append(path)

    chosen = rows.where(F.col("id") % every == 0) if queries is None else rows.join(queries.select(F.col(queries.columns[0]).cast("long").alias("id")).distinct(), "id", "left_semi")
    # each vector is searched once for all queries that have it
    asked = chosen.groupBy("vec").agg(F.min("id").alias("lead"))
    asked, path = cut(_assigned(asked.select("vec", F.array("lead").alias("ids")), weights, probes), "asked")
    lasting.append(path)

    merged, path = cut(probed(asked, placed, k), "nearest")
    paths.append(path)
    # queries whose parts hold too few candidates search the parts that are left
    most = min(k + 1, n_ids)
    few, path = cut(asked.join(merged.where(F.size("nearest") >= most).select(F.col("query").alias("q")), F.element_at("ids", 1) == F.col("q"), "left_anti"), "few")
    paths.append(path)
    if not few.isEmpty():
        parts = F.array(*[F.lit(r["part"]) for r in placed.select("part").distinct().orderBy("part").collect()])  # at most MOST_PARTS
        rest = few.select("vec", "ids", F.array_except(parts, "parts").alias("parts"))
        again = probed(rest, placed, k).withColumnRenamed("nearest", "more")
        merged, path = cut(merged.join(again, "query", "full").select("query", F.slice(F.array_sort(F.concat(*[F.coalesce(c, F.array().cast("array<struct<score:double,id:bigint>>")) for c in ("nearest", "more")]), _order), 1, k + 1).alias("nearest")), "nearest")
        paths.append(path)
    lead = chosen.join(asked.select("vec", F.element_at("ids", 1).alias("query")), "vec").select(F.col("id").alias("query_id"), "query")
    own = lead.join(merged, "query").select("query_id", F.slice(F.filter("nearest", lambda x: x["id"] != F.col("query_id")), 1, k).alias("nearest"))
    own, _ = cut(own, "neighbours")  # k rows a query: all that the caller's frame reads
    for path in [*paths, *lasting]:
        delete(vectors.sparkSession, path)
    return own.select("query_id", F.posexplode("nearest").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))
