"""MinHash near-duplicates from bottom-k sketches under one hash function.

A document's set is its distinct five-word shingles, hashed to 64 bits. Its
sketch is the ``K`` smallest hashes; the ``M`` smallest are its retained
values, from which inverted lists are built. Documents with equal sets are one
class and go on as one representative.

Candidates. For a pair at or over the threshold each of the M smallest hashes
of the union is shared with probability 0.75 or more, so that the pair shares
fewer than ``DROP + 1`` of them with a probability under 4e-6. In any one order
of all values the first shared value of a pair that shares DROP + 1 has DROP
shared values after it, so every document may leave out its DROP most frequent
retained values and the pair still meets in a list: passages that very many
documents share drop out, without a cap.

Links are wanted for components only, so lists are not turned into all pairs:

1. star: each member of a list is paired with the list's first member;
   the union sketch of a pair estimates its similarity, full sets confirm it;
   connected components follow from the confirmed links.
2. rest: only pairs between different components remain. Lists of at most
   ``SHORT`` members give their pairs, filtered and confirmed as before. Longer
   lists are dealt into blocks of about ``BLOCK_ROWS`` members and pairs of
   blocks are compared exactly on full sets, as products of incidence
   matrices, each in a task of its own that returns at most one link for two
   members; blocks of one component are not compared with each other. That way
   is exact for lists of any length.

Components come from repeated minimum labels with pointer jumping; each round
is a table in the shared folder, so a lost executor costs one round at most.
Joins on hot values or labels are plain joins between exchanged tables, which
adaptive execution splits.

Defined results: documents without words (or text) have the empty set, link
with nothing and are kept; fewer than five words count as one shingle; rows
that share an id are one document; a null id has a null component and is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm.common import arrow_map, columns, small_batches
from quillion.llm.features import _P, BLOCK, _tables, mix, runs
from quillion.session import cut, delete, read

WORDS, PERCENT = 5, 75
K, M, DROP = 32, 16, 3
#: Of a full union sketch, the least shared share that goes on to be confirmed:
#: a pair at the threshold shares less with a probability under 2e-6.
LEAST_SHARED = 11
SHORT, BLOCK_ROWS = 64, 1024
#: Ids that may be broadcast (8 bytes each); more are joined.
BROADCAST_IDS = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACES = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_ALL = (1 << 64) - 1


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a lower-cased text, block by block of bounded size."""
    up, down = _tables()
    out, carry, carried = [], 0, 0
    for at in range(0, len(raw), BLOCK):
        x = np.frombuffer(raw, np.uint8, min(BLOCK, len(raw) - at), at)
        inside = np.zeros(len(x) + 2, bool)
        np.logical_not(_SPACE[x], out=inside[1:-1])
        s, e = runs(inside)
        s, e = s - 1, e - 1
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=sums[1:])
        h, n = (sums[e] - sums[s]) * down[s], (e - s).astype(np.uint64)
        if carried:
            if len(s) and s[0] == 0:
                h[0] = (carry + pow(_P, carried, 1 << 64) * int(h[0])) & _ALL
                n[0] += np.uint64(carried)
            else:
                h, n, s, e = np.insert(h, 0, np.uint64(carry)), np.insert(n, 0, np.uint64(carried)), np.insert(s, 0, 0), np.insert(e, 0, 0)
            carry = carried = 0
        if len(e) and e[-1] == len(x) and at + BLOCK < len(raw):
            carry, carried, h, n = int(h[-1]), int(n[-1]), h[:-1], n[:-1]
        out.append(mix(h + n))
    if carried:
        out.append(mix(np.array([(carry + carried) & _ALL], np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(raw: bytes | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes (non-negative int64) of a UTF-8 text."""
    w = word_hashes(raw.lower()) if raw else np.empty(0, np.uint64)
    if not len(w):
        return np.empty(0, np.int64)
    m = max(1, len(w) - size + 1)
    total = np.full(m, np.uint64(min(len(w), size)))
    for k in range(min(len(w), size)):
        total += mix(w[k : k + m]) * _PLACES[k % 5] if k < 5 else mix(w[k : k + m] + np.uint64(k))
    return np.unique((mix(total) >> np.uint64(1)).astype(np.int64))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """id, n (set size), digest (of the set; null if empty) and sketch (K smallest) of every row."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def fn(b: pa.RecordBatch) -> dict:
        n, digest, sketch = [], [], []
        for raw in b.column(text_col).cast(pa.binary()).to_pylist():
            s = shingle_set(raw, size)
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sketch.append(s[:K])
        return {"id": b.column(id_col), "n": n, "digest": digest, "sketch": sketch}

    return arrow_map(docs.select(id_col, text_col), fn, schema)


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """id and packed shingle set of the documents in ``ids`` (one column, id)."""
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    some = some.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")

    def fn(b: pa.RecordBatch) -> dict:
        return {"id": b.column("id"), "set": [shingle_set(raw, size).tobytes() for raw in b.column("text").cast(pa.binary()).to_pylist()]}

    return arrow_map(some, fn, T.StructType([some.schema["id"], T.StructField("set", T.BinaryType())]))


def alike(n1, n2, percent: int):
    """Set sizes that allow the threshold."""
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose union sketch allows the threshold."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}"))
    df = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    df = df.withColumn("u", union)
    shared = F.size(F.array_intersect(F.array_intersect("u", "sa"), F.col("sb")))
    enough = F.when(F.size("u") < K, shared * 100 >= F.size("u") * percent).otherwise(shared >= LEAST_SHARED)
    return df.where(enough).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"s{c}"))
    df = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")

    def fn(b: pa.RecordBatch) -> dict:
        keep = []
        for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            p, q = (p, q) if len(p) <= len(q) else (q, p)
            both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(q) else 0
            keep.append(both * 100 >= (len(p) + len(q) - both) * percent)
        return {"a": b.column("a"), "b": b.column("b"), "ok": keep}

    out = T.StructType([df.schema["a"], df.schema["b"], T.StructField("ok", T.BooleanType())])
    return arrow_map(df, fn, out).where("ok").select("a", "b")


def components(links: DataFrame, temporary: list[str]) -> DataFrame:
    """(id, comp) of every id in ``links`` (a, b): comp is the smallest id it is connected with."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    both, path = cut(both, "edges")
    temporary.append(path)
    label, path = cut(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("comp").alias("m"))
        step = label.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        step, mid = cut(step, "labels")
        jump = step.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        after, new = cut(step.join(jump, "comp").select("id", "was", F.col("further").alias("comp")), "labels")
        changed = not after.where(F.col("was") != F.col("comp")).isEmpty()
        delete(label.sparkSession, path)
        delete(label.sparkSession, mid)
        label, path = after.select("id", "comp"), new
        if not changed:
            temporary.append(path)
            return label


def block_links(members: DataFrame, percent: int, temporary: list[str]) -> DataFrame:
    """Links (a, b) between members (v, id, comp, set) of long lists, across components.

    Members of a list are dealt into blocks: a component with more than a
    block of members has blocks of its own, the others share blocks by
    component; members of a block have sets of about one size. Every two blocks
    whose sizes allow the threshold, except of one component, meet in one task.
    """
    # sets of classes that aren't neighbours differ in size by more than the threshold allows
    size = F.floor(F.log(F.octet_length("set") / 8) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    members = members.withColumn("size", size)
    counts = members.groupBy("v", "size", "comp").agg(F.count("*").alias("of_comp"))
    own = F.col("of_comp") > BLOCK_ROWS
    rest = counts.groupBy("v", "size").agg(F.sum(F.when(own, 0).otherwise(F.col("of_comp"))).alias("of_rest"))
    deal = counts.join(rest, ["v", "size"]).select(
        "v", "size", "comp", own.alias("own"),
        F.ceil(F.when(own, F.col("of_comp")).otherwise(F.col("of_rest")) / BLOCK_ROWS).cast("int").alias("deals"),
    )
    deal, path = cut(deal, "deal")
    temporary.append(path)
    spread = F.pmod(F.when(F.col("own"), F.xxhash64("id")).otherwise(F.xxhash64("comp")), F.greatest(F.col("deals"), F.lit(1)))
    named = lambda k: F.concat_ws("/", F.col("size").cast("string"), F.when(F.col("own"), F.concat(F.lit("c"), F.col("comp").cast("string"))).otherwise("r"), k.cast("string"))
    dealt = members.join(deal, ["v", "size", "comp"]).select("v", named(spread).alias("block"), "id", "comp", "set")
    dealt, path = cut(dealt, "dealt")
    temporary.append(path)
    # a list has as many blocks as thousands of members: few rows for each list
    blocks = deal.select("v", "size", "own", "comp", F.explode(F.sequence(F.lit(0), F.greatest(F.col("deals"), F.lit(1)) - 1)).alias("k"))
    blocks = blocks.select("v", "size", F.when(F.col("own"), F.col("comp")).alias("pure"), named(F.col("k")).alias("block")).distinct()
    blocks, path = cut(blocks, "blocks")
    temporary.append(path)
    left = blocks.select("v", F.col("size").alias("z1"), F.col("pure").alias("p1"), F.col("block").alias("b1"))
    right = blocks.select("v", F.col("size").alias("z2"), F.col("pure").alias("p2"), F.col("block").alias("b2"))
    tasks = left.join(right, "v").where((F.col("b1") <= F.col("b2")) & (F.abs(F.col("z1") - F.col("z2")) <= 1) & ~(F.col("p1").eqNullSafe(F.col("p2")) & F.col("p1").isNotNull()))
    tasks, path = cut(tasks.select("v", "b1", "b2"), "tasks")
    temporary.append(path)
    one = dealt.join(tasks.withColumnRenamed("b1", "block"), ["v", "block"]).select("v", F.col("block").alias("b1"), "b2", F.lit(0).alias("side"), "id", "comp", "set")
    two = dealt.join(tasks.where("b1 <> b2").withColumnRenamed("b2", "block"), ["v", "block"]).select("v", "b1", F.col("block").alias("b2"), F.lit(1).alias("side"), "id", "comp", "set")
    small_batches(members.sparkSession)

    def compare(t: pa.Table) -> pa.Table:
        ids, comps = t.column("id").combine_chunks(), np.unique(np.array(t.column("comp").to_pylist()), return_inverse=True)[1]
        found = np.array([*exact_links([np.frombuffer(s, np.int64) for s in t.column("set").to_pylist()], comps, t.column("side").to_numpy(), percent)], np.int64).reshape(-1, 2)
        return pa.table({"a": ids.take(pa.array(found[:, 0])), "b": ids.take(pa.array(found[:, 1]))})

    kind = members.schema["id"].dataType
    return one.unionByName(two).groupBy("v", "b1", "b2").applyInArrow(compare, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).distinct()


def incidence(sets: list[np.ndarray], cols: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(cols)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(cols, s)
        at = at[(at < len(cols)) & (cols[np.minimum(at, len(cols) - 1)] == s)] if len(cols) else at[:0]
        out[i, at] = 1
    return out


def overlaps(one: list[np.ndarray], two: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections of sets of ``one`` and ``two``, exact, by blocks of values."""
    u1 = np.unique(np.concatenate(one)) if one else np.empty(0, np.int64)
    u2 = np.unique(np.concatenate(two)) if two else np.empty(0, np.int64)
    cols, out = np.intersect1d(u1, u2, assume_unique=True), np.zeros((len(one), len(two)), np.float32)
    for at in range(0, len(cols), width):
        out += incidence(one, cols[at : at + width]) @ incidence(two, cols[at : at + width]).T
    return out


def exact_links(sets: list[np.ndarray], comps: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of positions at or over the threshold, enough to connect what they connect.

    Pairs of one component are left out; between sides if there are two, else
    within the one side. Sketches rule out rows that can have no partner.
    """
    rows = np.flatnonzero(side == 0)
    others = np.flatnonzero(side == 1) if (side == 1).any() else rows
    size = np.array([len(s) for s in sets], np.float64)

    def may(r, c, over, least):
        n1, n2 = size[r][:, None], size[c][None, :]
        ok = (comps[r][:, None] != comps[c][None, :]) & (np.minimum(n1, n2) * 100 >= np.maximum(n1, n2) * percent)
        return ok & (over >= least(n1, n2))

    rough = may(rows, others, overlaps([sets[i][:K] for i in rows], [sets[i][:K] for i in others]), lambda n1, n2: np.minimum(LEAST_SHARED, np.ceil(np.maximum(n1, n2) * percent / 100)))
    rows, others = rows[rough.any(1)], others[rough.any(0)]
    if not len(rows):
        return []
    # both = p/(100+p) * (n1+n2) at the threshold
    good = may(rows, others, overlaps([sets[i] for i in rows], [sets[i] for i in others]), lambda n1, n2: np.ceil((n1 + n2) * percent / (100 + percent) - 1e-9))
    root = {int(c): int(c) for c in np.unique(comps)}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i, j in np.argwhere(good):
        p, q = find(int(comps[rows[i]])), find(int(comps[others[j]]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(rows[i]), int(others[j])))
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles, component_id and kept."""
    spark, temporary = docs.sparkSession, []
    sk, _ = cut(sketches(docs, id_col, text_col, size), "sketches")
    known = sk.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    first = known.groupBy("digest").agg(F.min(F.struct("id", "n", "sketch")).alias("r"))
    reps, path = cut(first.select("digest", "r.id", "r.n", "r.sketch"), "reps")
    temporary.append(path)

    postings = reps.select("id", "n", F.explode(F.slice("sketch", 1, M)).alias("v"))
    often, path = cut(postings.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "often")
    temporary.append(path)
    # a set of fewer than M values is retained whole: at the threshold it shares 3/4 of them, rounded up
    drop = F.least(F.lit(DROP), F.ceil(F.least(F.col("n"), F.lit(M)) * percent / 100).cast("int") - 1)
    by_doc = postings.join(often, "v").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("vs"))
    kept = by_doc.select("id", "n", F.explode(F.slice("vs", F.lit(1), F.greatest(F.size("vs") - drop, F.lit(0)))).alias("x")).select(F.col("x.v").alias("v"), "id", "n")
    kept, path = cut(kept, "kept")
    temporary.append(path)
    lists, path = cut(kept.groupBy("v").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("lead")).where("c > 1").select("v", "c", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n")), "lists")
    temporary.append(path)

    star = kept.join(lists, "v").where((F.col("id") != F.col("lead")) & alike(F.col("n"), F.col("lead_n"), percent)).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    near, path = cut(estimated(star, reps, percent), "star")
    temporary.append(path)
    ids = lambda df: df.select(F.col("a").alias("id")).union(df.select(F.col("b").alias("id"))).distinct()
    sets, sets_path = cut(full_sets(docs, ids(near), id_col, text_col, size), "sets")
    links, links_path = cut(confirmed(near, sets, percent), "links")
    temporary.append(links_path)
    delete(spark, sets_path)
    label = components(links, temporary)

    # members of lists in which components still differ
    placed = kept.join(label, "id", "left").select("v", "id", "n", F.coalesce("comp", "id").alias("comp"))
    placed, path = cut(placed, "placed")
    temporary.append(path)
    open_lists = placed.groupBy("v").agg(F.count("*").alias("c"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("v", "c")
    open_lists, path = cut(open_lists, "open")
    temporary.append(path)
    short = placed.join(open_lists.where(F.col("c") <= SHORT).select("v"), "v")
    other = F.filter("ms", lambda m: (m["id"] > F.col("m.id")) & (m["comp"] != F.col("m.comp")) & alike(m["n"], F.col("m.n"), percent))
    pairs = short.groupBy("v").agg(F.collect_list(F.struct("id", "n", "comp")).alias("ms")).select("ms", F.explode("ms").alias("m")).select(F.col("m.id").alias("a"), F.explode(other).alias("o")).select("a", F.col("o.id").alias("b")).distinct()
    rest, path = cut(estimated(pairs, reps, percent), "rest")
    temporary.append(path)
    long = placed.join(open_lists.where(F.col("c") > SHORT).select("v"), "v")
    long, path = cut(long, "long")
    temporary.append(path)
    sets, sets_path = cut(full_sets(docs, ids(rest).union(long.select("id")).distinct(), id_col, text_col, size), "sets")
    temporary.append(sets_path)
    more = confirmed(rest, sets, percent)
    if not long.isEmpty():
        more = more.unionByName(block_links(long.join(sets, "id").select("v", "id", "comp", "set"), percent, temporary))
    more, path = cut(more, "more")
    temporary.append(path)
    if not more.isEmpty():
        label = components(links.unionByName(more), temporary)
    # every class takes its representative's component, every row its class's
    of_class, _ = cut(reps.select("digest", "id").join(label, "id", "left").select("digest", F.coalesce("comp", "id").alias("comp")), "classes")
    for path in temporary:
        delete(spark, path)
    rows = sk.select("id", "n", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """Rows of ``docs`` that their near-duplicates keep, with their columns; of rows with one id, all."""
    gone = classes(docs, id_col, **kw).where(~F.col("kept")).select(id_col).distinct()
    return columns(docs.join(gone, id_col, "left_anti"), docs.columns)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
