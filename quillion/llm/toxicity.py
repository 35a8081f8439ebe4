"""Toxicity: a classifier regularised by counterfactuals.

Features are which hashed words occur in a text (lower case, letters and
digits). Identity terms are told by the word, not by its bucket: each has a
bucket of its own that no other word shares, and so do the pairs of a term and
its neighbour in the sentence, among the others' buckets. A logistic layer is
trained on labelled documents; in every sentence of a training document that
names a group the identity term is swapped for another of its kind, and for a
neutral word, and the squared change of the sentence's logit is penalised, so
that terms for groups carry no weight of their own and neutral mentions are
left alone. Without such sentences nothing is penalised.

Training rows: at most ``PER_CLASS`` labelled documents of each label, never
held-out ones, whose distinct word buckets (not texts) reach the driver, and of
near copies among them the first; words
take part when their document frequencies differ between the labels by at least
``SCREEN`` standard errors and they occur in ``LEAST_SHARE`` of one label's
rows, and rarer ones when they differ by ``CERTAIN``. Scoring covers every whole text where it lies,
without a shuffle; what is broadcast is at most 2**BITS weights.

Defined results: null and empty texts score the bias alone; repeated rows
repeat; other columns pass through, whatever their names; conflicting labels of one id count as the larger; where labels of one
kind are missing, every score is ``fallback``.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm.common import arrow_map, columns, free
from quillion.llm.features import blocks, code_points, mix, run_hashes, runs
from quillion.llm.quality import decided, labelled_sample
from quillion.session import read

BITS, PER_CLASS, SCREEN, CERTAIN, LEAST_DOCS, LEAST_SHARE = 18, 4000, 4.0, 6.0, 3, 0.015
SWAP_WEIGHT, RIDGE, STEPS, RATE, THRESHOLD = 10.0, 2e-5, 600, 0.2, 0.5

#: Share of the loss of each label, whatever their counts.
LABEL_WEIGHTS = (0.65, 0.35)

#: Identity terms, by kind; a term may be swapped for any other of its kind.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "hispanic", "latino"), ("african", "european", "american", "arab", "chinese", "mexican", "indian"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual"), ("transgender", "cisgender"),
    ("old", "young"), ("elderly", "teenage"), ("immigrants", "natives"), ("immigrant", "native"), ("deaf", "blind", "disabled"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"), ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
)

#: Swaps of one training text that are learnt from at most.
MOST_SWAPS = 256
#: Characters that end a sentence.
ENDERS = np.frombuffer(".!?\n".encode("utf-32-le"), np.uint32)

_WORDS: dict[str, np.ndarray] = {}


def _word_table() -> np.ndarray:
    """For each code point of the first plane (and one for all others), if it belongs to words."""
    if "in" not in _WORDS:
        _WORDS["in"] = np.fromiter((unicodedata.category(chr(c))[0] in "LNM" for c in range(1 << 16)), bool, 1 << 16)
    return _WORDS["in"]


def identity() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the identity terms, and the number of each."""
    if "terms" not in _WORDS:
        terms = [t for kind in IDENTITY_TERMS for t in kind]
        x, starts = code_points(terms)
        h = run_hashes(x, starts, starts + np.array([len(t) for t in terms]))
        order = np.argsort(h)
        _WORDS["terms"], _WORDS["numbers"] = h[order], order
    return _WORDS["terms"], _WORDS["numbers"]


def words(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, hash, sentence, number of the identity term or -1) of each word of each part."""
    x, starts = code_points([p.lower() for p in parts])
    inside = _word_table()[np.minimum(x, (1 << 16) - 1)]
    inside[0] = inside[-1] = False
    s, e = runs(inside)
    if not len(s):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.isin(x, ENDERS)
    ends[starts[1:] - 1] = True  # parts are sentences' ends, too
    h, (terms, numbers) = run_hashes(x, s, e), identity()
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return np.searchsorted(starts, s, "right") - 1, h, np.cumsum(ends)[s], np.where(terms[at] == h, numbers[at], -1)


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of hashes, none of them an identity term's."""
    kept = len(identity()[0])
    return (kept + (h >> np.uint64(64 - bits)) % np.uint64((1 << bits) - kept)).astype(np.int64)


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two words in a row."""
    with np.errstate(over="ignore"):
        return mix(first * np.uint64(3) + second)


def word_buckets(parts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(part, bucket) of each word of each part: an identity term has one of its own, and each pair of it and its neighbour in the sentence another."""
    owner, h, sentence, term = words(parts)
    if not len(h):
        return owner, owner
    got = np.where(term >= 0, term, bucket(h, bits))
    both = np.flatnonzero(((term[1:] >= 0) | (term[:-1] >= 0)) & (sentence[1:] == sentence[:-1]))
    return np.concatenate([owner, owner[both]]), np.concatenate([got, bucket(pair(h[both], h[both + 1]), bits)])


def sentence_swaps(text: str | None, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets that go, buckets that come) when the identity term of a sentence becomes the next of its kind, and when it becomes a neutral word.

    One pair for each sentence, term and replacement; all that the term has in the sentence is replaced.
    """
    out = []
    flat = [t for kind in IDENTITY_TERMS for t in kind]
    terms, numbers = identity()
    hash_of = {int(n): h for n, h in zip(numbers, terms, strict=True)}
    for _, parts in blocks([text]):
        _, h, sentence, term = words(parts)
        places: dict[tuple[int, int], list[int]] = {}
        for p in np.flatnonzero(term >= 0).tolist():
            places.setdefault((int(sentence[p]), int(term[p])), []).append(p)
        for (_, t), at in places.items():
            near = [(p + d, d) for p in at for d in (-1, 1) if 0 <= p + d < len(h) and sentence[p + d] == sentence[p]]
            with_ = lambda x, near=near, h=h: [pair(h[q : q + 1], np.array([x])) if d < 0 else pair(np.array([x]), h[q : q + 1]) for q, d in near]
            pairs = lambda x, with_=with_: bucket(np.concatenate(w), bits) if (w := with_(x)) else np.empty(0, np.int64)
            kind = next(k for k in IDENTITY_TERMS if flat[t] in k)
            other = flat.index(kind[(kind.index(flat[t]) + 1) % len(kind)])
            gone = np.unique(np.append(pairs(hash_of[t]), t))
            out += [(gone, np.unique(np.append(pairs(hash_of[other]), other))), (gone, np.empty(0, np.int64))]
    return out


def present(texts: list[str | None], bits: int = BITS) -> list[np.ndarray]:
    """Distinct word buckets of each text, sorted."""
    pairs = [np.empty(0, np.int64)]
    for which, parts in blocks(texts):
        owner, got = word_buckets(parts, bits)
        pairs.append(np.unique((np.asarray(which, np.int64)[owner] << bits) | got) if len(owner) else owner)
    both = np.unique(np.concatenate(pairs))
    cuts = np.searchsorted(both, np.arange(1, len(texts)) << bits)
    return [p & ((1 << bits) - 1) for p in np.split(both, cuts)]


def swaps(bits: int = BITS) -> list[tuple[int, ...]]:
    """Buckets of the identity terms, by kind."""
    return [tuple(int(b[0]) for b in present(list(kind), bits)) for kind in IDENTITY_TERMS]


def counterfactuals(rows: list[np.ndarray], kinds: list[tuple[int, ...]]) -> list[tuple[int, np.ndarray]]:
    """For each row and each identity term in it: the row with the next term of its kind instead, and with a neutral word."""
    out = []
    for i, r in enumerate(rows):
        have = set(r.tolist())
        for kind in kinds:
            for k, term in enumerate(kind):
                if term in have:
                    for other in ({kind[(k + 1) % len(kind)]}, set()):  # neutral words have no feature
                        out.append((i, np.fromiter(sorted((have - {term}) | other), np.int64)))
    return out


def distinct(rows: list[np.ndarray], y: np.ndarray, alike: float = 0.6, bands: int = 10, width: int = 4, seed: int = 11) -> np.ndarray:
    """Positions of training rows without near copies of earlier ones of the same label.

    Copies would make every word of what they copy look frequent. A row is
    compared with the first row of each of its buckets (bands of minimum hashes).
    """
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 2**63, (bands * width, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    first: dict[tuple, int] = {}
    keep = []
    for i, r in enumerate(rows):
        if not len(r):
            keep.append(i)
            continue
        low = ((r.astype(np.uint64) + np.uint64(1)) * odd).min(1).reshape(bands, width)
        seen = [first.setdefault((int(y[i]), b, *low[b].tolist()), i) for b in range(bands)]
        same = ((j, np.intersect1d(r, rows[j], assume_unique=True).size) for j in {*seen} - {i})
        if not any(n >= alike * (len(r) + len(rows[j]) - n) for j, n in same):
            keep.append(i)
    return np.array(keep, np.int64)


def screen(rows: list[np.ndarray], y: np.ndarray, kinds: list[tuple[int, ...]], bits: int = BITS, least: float = SCREEN) -> np.ndarray:
    """Buckets that take part: those whose frequencies differ by label, and all identity terms."""
    df = [np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == c]), minlength=1 << bits) for c in (0, 1)]
    n = [max(1, int((y == c).sum())) for c in (0, 1)]
    p = (df[0] + df[1] + 1) / (n[0] + n[1] + 2)
    z = (df[1] / n[1] - df[0] / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
    often = np.where(z > 0, df[1] >= LEAST_SHARE * n[1], df[0] >= LEAST_SHARE * n[0])
    some = (np.abs(z) >= least) & (df[0] + df[1] >= LEAST_DOCS) & (often | (np.abs(z) >= CERTAIN))
    some[[t for k in kinds for t in k]] = True
    return np.flatnonzero(some)


def train(rows: list[np.ndarray], y: np.ndarray, swap_weight: float = SWAP_WEIGHT, ridge: float = RIDGE, steps: int = STEPS, bits: int = BITS, kinds: list[tuple[int, ...]] | None = None, swapped: list[list[tuple[np.ndarray, np.ndarray]]] | None = None) -> tuple[np.ndarray, float]:
    """Weights by bucket, and the bias, by Adam on the weighted, penalised log loss.

    ``swapped`` has what the swaps in each row's sentences change; without it whole rows are swapped.
    """
    kinds = swaps(bits) if kinds is None else kinds
    some = distinct(rows, y)
    rows, y = [rows[i] for i in some], y[some]
    changes = None if swapped is None else [c for i in some for c in swapped[i]]
    use = screen(rows, y, kinds, bits)
    if changes:  # pairs that hold a term take part as the terms do
        use = np.union1d(use, np.concatenate([b for c in changes for b in c]))
    place = np.full(1 << bits, -1)
    place[use] = np.arange(len(use))

    def entries(some: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the ones of a sparse matrix."""
        at = place[np.concatenate(some)] if some else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(some)), [len(r) for r in some])
        return row[at >= 0], at[at >= 0]

    n, k = len(rows), len(use)
    row, col = entries(rows)
    other = [(rows[i], r) for i, r in counterfactuals(rows, kinds)] if changes is None else changes
    new, was = entries([r for _, r in other]), entries([r for r, _ in other])
    crow, ccol = np.concatenate([new[0], was[0]]), np.concatenate([new[1], was[1]])
    csign = np.repeat([1.0, -1.0], [len(new[0]), len(was[0])])
    per_row = np.array([w / max(1, (y == c).sum()) for c, w in enumerate(LABEL_WEIGHTS)])[y]
    w, b = np.zeros(k), 0.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        err = (1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n) + b, -30, 30))) - y) * per_row
        g = np.bincount(col, err[row], k) + 2 * ridge * w
        if other:
            change = np.bincount(crow, csign * w[ccol], len(other))
            g += 2 * swap_weight / len(other) * np.bincount(ccol, csign * change[crow], k)
        grad = np.append(g, err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    table = np.zeros(1 << bits)
    table[use] = w
    return table, float(b)


def featurise(labelled: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, label, the packed buckets of each text, and what the swaps in its sentences change."""
    swap = T.ArrayType(T.StructType([T.StructField("gone", T.ArrayType(T.LongType())), T.StructField("come", T.ArrayType(T.LongType()))]))
    schema = T.StructType([labelled.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("swaps", swap)])

    def fn(b: pa.RecordBatch) -> dict:
        texts = b.column(text_col).to_pylist()
        changes = [[{"gone": g.tolist(), "come": c.tolist()} for g, c in sentence_swaps(t)[:MOST_SWAPS]] for t in texts]
        return {"doc_id": b.column("doc_id"), "label": b.column("label"), "ids": [r.astype(np.uint32).tobytes() for r in present(texts)], "swaps": changes}

    return arrow_map(labelled.select("doc_id", "label", text_col), fn, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, text_col: str = "text", swap_weight: float = SWAP_WEIGHT) -> tuple[np.ndarray, float] | None:
    sample, totals = labelled_sample(docs, labels, label, per_class, text_col)
    if len(totals) < 2:
        return None
    got = sorted(((r["doc_id"], bytes(r["ids"]), r["label"], r["swaps"]) for r in featurise(sample, text_col).toLocalIterator()), key=lambda r: r[:2])
    y = np.array([r[2] for r in got], np.int64)
    changes = [[(np.array(c["gone"], np.int64), np.array(c["come"], np.int64)) for c in r[3]] for r in got]
    return train([np.frombuffer(r[1], np.uint32).astype(np.int64) for r in got], y, swap_weight, swapped=changes) if len({*y.tolist()}) == 2 else None


def score_texts(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1: each weighted word of a text counts once."""
    bits = int(len(table)).bit_length() - 1
    pairs = [np.empty(0, np.int64)]
    for which, parts in blocks(texts):
        owner, got = word_buckets(parts, bits)
        some = np.flatnonzero(table[got])
        pairs.append((np.asarray(which, np.int64)[owner[some]] << bits) | got[some])
    both = np.unique(np.concatenate(pairs))
    z = np.bincount(both >> bits, table[both & ((1 << bits) - 1)], len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, keep: list[str] | None = None, text_col: str = "text", fallback: float = 0.0) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) and as the last one ``_score``, the probability of label 1 (underscores behind the name if it is taken)."""
    keep = docs.columns if keep is None else keep
    df, name = columns(docs, [*keep, text_col]), free("_score", keep)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def fn(b: pa.RecordBatch) -> dict:
        texts = b.column(text_col).to_pylist()
        got = np.full(len(texts), fallback) if known.value is None else score_texts(texts, *known.value)
        return {c: b.column(c) for c in keep} | {name: pa.array(got)}

    return arrow_map(df, fn, T.StructType([*[df.schema[c] for c in keep], T.StructField(name, T.DoubleType())]))


def harmless(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with their columns."""
    scored = score(docs, fit(docs, labels))
    return columns(scored.where(F.col(scored.columns[-1]) < threshold), docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return decided(score(docs, fit(docs, read(spark, sf_dir, "labels")), keep=["doc_id"]), THRESHOLD)
