"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors, one for each hashed word, pair of
neighbouring words and character n-gram; a softmax layer gives its classes.
Vectors and layer are trained together by stochastic gradient descent in numpy
(steps scaled for each bucket by its past gradients).

Training rows: at most ``PER_CLASS`` labelled documents of each label (those
with the smallest hashes of their ids, never held-out ones; of rows with one id
the first text), featurised on the executors into at most ``MOST_BUCKETS``
counts each, so what reaches the driver is bounded. The labels' true proportions, counted over the whole table, weigh the
two classes. Scoring covers every whole text where it lies, without a shuffle;
as averaging and layer are linear, a bucket needs one number then, and the
broadcast table has 2**BITS of them.

Defined results: null and empty texts have no features and score the bias
alone; repeated rows repeat; other columns pass through, whatever their names; conflicting labels of one id count as the larger;
where labels of one kind are missing, every score is ``fallback``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm.common import arrow_map, columns, free, held_out_id
from quillion.llm.features import blocks, code_points, mix, run_hashes, runs
from quillion.session import read

BITS, DIM, PER_CLASS, EPOCHS, RATE, THRESHOLD = 16, 8, 2000, 10, 0.3, 0.3
#: Buckets of one training text that reach the driver (8 bytes each): its most frequent ones. Scoring has no such bound.
MOST_BUCKETS = 8192
NGRAMS = (3, 4)
#: Odd multipliers, one for each place of an n-gram.
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def buckets(parts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(part, bucket) of every feature of every part."""
    x, starts = code_points(parts)
    space = (x == 32) | ((x >= 9) & (x <= 13))
    s, e = runs(~space)
    if not len(s):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shift = np.uint64(64 - bits)
    h = run_hashes(x, s, e)
    owner = np.searchsorted(starts, s, "right") - 1
    at, got = [owner], [h >> shift]
    same_part = owner[1:] == owner[:-1]
    pair = np.where(h[1:] == h[:-1], np.uint64(1), h[:-1] * _MULTIPLIERS[1] + h[1:])
    at.append(owner[1:][same_part])
    got.append(mix(pair[same_part]) >> shift)
    y = np.where(space, 32, x).astype(np.uint64)
    char_owner = np.searchsorted(starts, np.arange(len(x)), "right") - 1
    for n in NGRAMS:
        m = len(x) - n + 1
        if m <= 0:
            continue
        inner = np.ones(m, bool)
        total = np.full(m, np.uint64(n))
        for k in range(n):
            total += y[k : k + m] * _MULTIPLIERS[k]
            if 0 < k < n - 1:
                inner &= ~space[k : k + m]
        begin = np.flatnonzero(inner)
        at.append(char_owner[begin + 1])
        got.append(mix(total[begin]) >> shift)
    return np.concatenate(at), np.concatenate(got).astype(np.int64)


def featurise(labelled: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, label and the packed buckets and counts of each text."""
    schema = T.StructType([labelled.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def fn(b: pa.RecordBatch) -> dict:
        ids, counts = [], []
        for t in b.column(text_col).to_pylist():
            tally = np.zeros(1 << BITS, np.int64)
            for _, parts in blocks([t]):
                tally += np.bincount(buckets(parts)[1], minlength=1 << BITS)
            at = np.flatnonzero(tally)
            if len(at) > MOST_BUCKETS:
                at = np.sort(at[np.argsort(-tally[at], kind="stable")[:MOST_BUCKETS]])
            ids.append(at.astype(np.uint32).tobytes())
            counts.append(tally[at].astype(np.float32).tobytes())
        return {"doc_id": b.column("doc_id"), "label": b.column("label"), "ids": ids, "counts": counts}

    return arrow_map(labelled.select("doc_id", "label", text_col), fn, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled rows of each class with their texts, and the classes' true counts."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out_id()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picks = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    # two times per_class ids at most, so the broadcast is bounded; one text an id, so the rows are as well
    some = columns(docs, ["doc_id", text_col]).join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id")
    return some.groupBy("doc_id", "label").agg(F.min(F.col(text_col)).alias(text_col)), totals


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], totals: dict[int, int], bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """Score table of a model for ``rows`` of (buckets, counts, label): one number a bucket, and the bias.

    Per document: hidden = weighted mean of bucket vectors, p = softmax(hidden W + b).
    """
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << bits, dim))
    layer, bias = rng.normal(0, 0.1, (dim, 2)), np.zeros(2)
    emb_sq, layer_sq, bias_sq = np.full(1 << bits, 1e-8), np.full((dim, 2), 1e-8), np.full(2, 1e-8)
    n = {c: max(1, sum(r[2] == c for r in rows)) for c in (0, 1)}
    share = {c: totals.get(c, n[c]) / max(1, sum(totals.values())) for c in (0, 1)}
    weight = {c: share[c] * len(rows) / n[c] for c in (0, 1)}
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            at, counts, y = rows[i]
            if not len(at):
                continue
            w = counts / counts.sum()
            vectors = emb[at]
            hidden = w @ vectors
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= weight[y]
            back = layer @ p
            grad = np.outer(hidden, p)
            layer_sq += grad**2
            bias_sq += p**2
            emb_sq[at] += w**2 * (back @ back) / dim
            emb[at] = vectors - step * np.outer(w / np.sqrt(emb_sq[at]), back)
            layer -= step * grad / np.sqrt(layer_sq)
            bias -= step * p / np.sqrt(bias_sq)
    return emb @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, text_col: str = "text") -> tuple[np.ndarray, float] | None:
    sample, totals = labelled_sample(docs, labels, label, per_class, text_col)
    if len(totals) < 2:
        return None
    got = sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["counts"]), r["label"]) for r in featurise(sample, text_col).toLocalIterator()), key=lambda r: r[:3])
    rows = [(np.frombuffer(i, np.uint32), np.frombuffer(c, np.float32), y) for _, i, c, y in got]
    return train(rows, totals) if len({r[2] for r in rows}) == 2 else None


def score_texts(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
    for which, parts in blocks(texts):
        owner, got = buckets(parts)
        index = np.asarray(which)[owner]
        sums += np.bincount(index, table[got], len(texts))
        counts += np.bincount(index, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(sums / np.maximum(counts, 1) + bias, -60, 60)))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, keep: list[str] | None = None, text_col: str = "text", fallback: float = 0.5) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) and as the last one ``_score``, the probability of label 1 (underscores behind the name if it is taken)."""
    keep = docs.columns if keep is None else keep
    df, name = columns(docs, [*keep, text_col]), free("_score", keep)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def fn(b: pa.RecordBatch) -> dict:
        texts = b.column(text_col).to_pylist()
        got = np.full(len(texts), fallback) if known.value is None else score_texts(texts, *known.value)
        return {c: b.column(c) for c in keep} | {name: pa.array(got)}

    return arrow_map(df, fn, T.StructType([*[df.schema[c] for c in keep], T.StructField(name, T.DoubleType())]))


def good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``, with their columns."""
    scored = score(docs, fit(docs, labels))
    return columns(scored.where(F.col(scored.columns[-1]) >= threshold), docs.columns)


def decided(scored: DataFrame, threshold: float) -> DataFrame:
    """The contract's columns from ``score``."""
    s = F.col(scored.columns[-1])
    return scored.select("doc_id", held_out_id().alias("held_out"), s.alias("score"), (s >= threshold).cast("int").alias("predicted"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return decided(score(docs, fit(docs, read(spark, sf_dir, "labels")), keep=["doc_id"]), THRESHOLD)
