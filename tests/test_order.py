"""Order within one hot group: positions and order statistics of bounded tasks."""

import random

from pyspark.sql import functions as F

from quillion.operators import order, ranking
from quillion.session import delete


def test_positions_equal_a_sort_and_split_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(k, "hot" if k % 20 else f"g{k % 7}" if k % 60 else None, rng.randint(0, 40), rng.choice([None, 1.5, -2.0])) for k in range(6000)]
    df = spark.createDataFrame(rows, "id long, g string, a int, b double").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, path = order.positions(df, ["g"], [(F.col("a"), True), (F.col("b"), False), F.col("id")])
        want, at = {}, {}
        for i, g, a, b in sorted(rows, key=lambda r: (str(r[1]), -r[2], r[3] is not None, r[3] or 0, r[0])):
            at[g] = at.get(g, 0) + 1
            want[i] = at[g]
        assert {r["id"]: r["position"] for r in got.collect()} == want and got.columns == [*df.columns, "position"]
        sizes = [r["n"] for r in spark.read.parquet(path).groupBy(F.shiftright("_at", 33)).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * 6000 / len(sizes)  # the hot group is in every range
        delete(spark, path)
        some = df.where("id % 100 = 0").select("id")
        few, path = order.positions(df, ["g"], [(F.col("a"), True), (F.col("b"), False), F.col("id")], "rank", some)
        assert {r["id"]: r["rank"] for r in few.collect()} == {i: p for i, p in want.items() if i % 100 == 0}
        delete(spark, path)
        none, path = order.positions(df.limit(0), ["g"], [F.col("id")])
        assert none.count() == 0
        delete(spark, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_large_rankings_equal_small_ones(spark):
    rng = random.Random(1)
    rows = [("q" if k % 9 else "r", f"p{k}", rng.choice([0.0, 0.5, 0.25]), rng.choice([None, "", "text"]), rng.choice(["2020", None, "2021-02-03", "bad"])) for k in range(500)]
    p = spark.createDataFrame(rows, "qid string, id string, rank_score double, abstract string, publication_date string")
    want = {r["id"]: r["rank"] for r in ranking.ranked(p).collect()}
    got, path = ranking.ranked_large(p)
    assert {r["id"]: r["rank"] for r in got.collect()} == want
    delete(spark, path)


def test_bins_hold_about_equally_many_values_whatever_their_distribution(spark):
    """One outlier, heavy tails and many equal values: no bin has over 2/1024 of a group's distinct values."""
    values = [("outlier", float(k)) for k in range(20_000)] + [("outlier", 1e300)] + [("tail", 2.0 ** (k / 20)) for k in range(20_000)] + [("few", 1.0), ("few", 2.0)]
    counted = spark.createDataFrame(values, "g string, _v double").withColumn("_c", F.lit(1).cast("long"))
    placed = order.binned(counted, ["g"])
    worst = {r["g"]: (r["m"], r["n"]) for r in placed.groupBy("g", "_bin").agg(F.count("*").alias("c")).groupBy("g").agg(F.max("c").alias("m"), F.sum("c").alias("n")).collect()}
    assert all(m <= max(1, 2 * n / order.BINS) for m, n in worst.values())
    ordered = placed.groupBy("g", "_bin").agg(F.min("_v").alias("a"), F.max("_v").alias("z")).orderBy("g", "_bin").collect()
    assert all(x["g"] != y["g"] or x["z"] < y["a"] for x, y in zip(ordered, ordered[1:], strict=False))


def test_values_at_places_of_skewed_groups(spark):
    rng = random.Random(7)
    rows = [("a", rng.paretovariate(0.3)) for _ in range(3000)] + [("a", 5.0)] * 2000 + [("b", float(k)) for k in range(7)] + [("c", None), (None, 3.0)]
    v = spark.createDataFrame(rows, "g string, v double")
    n = F.col("n")
    got = {r["g"]: (r["first"], r["p95"], r["last"]) for r in order.values_at(v.where("g is not null"), ["g"], "v", {"first": F.lit(0), "p95": F.floor(0.95 * (n - 1)), "last": n - 1}).collect()}
    for g in ("a", "b"):
        s = sorted(x for k, x in rows if k == g)
        assert got[g] == (s[0], s[int(0.95 * (len(s) - 1))], s[-1])
    assert set(got) == {"a", "b"}
