"""Order within groups of any size: positions, and values at given places, without a task that sorts a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.session import cut

#: Bins of a group's values.
BINS = 1024


def positions(df: DataFrame, by: list[str], order: list[Column], name: str = "position", only: DataFrame | None = None) -> tuple[DataFrame, str]:
    """``df`` with ``name``: each row's place, from 1, in the order of its group, and the folder that holds what the frame reads.

    Rows go into ranges of (group, order), whose ends Spark samples, so a group
    of any size is many ranges. Sorted within its range, a row's place is its
    number in the range, less the group's first there, plus the group's rows in
    earlier ranges: a few numbers for each range and group. With ``only`` (some
    columns of df) just those rows are returned; the others are counted.
    """
    keyed = df.withColumns({f"_k{i}": c for i, c in enumerate(_plain(order))})
    keys = [_directed(c, f"_k{i}") for i, c in enumerate(order)]
    ranged = keyed.repartitionByRange(*by, *keys).sortWithinPartitions(*by, *keys).drop(*[f"_k{i}" for i in range(len(order))])
    # partition number times 2**33, plus the row's number in it; settled once written
    t, path = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_at", 33).alias("_part")
    g = t.groupBy(*by, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    g = g.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    g = g.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_part").alias("_g_part"), "_first", "_before")
    some = t if only is None else t.join(only, only.columns, "left_semi")
    same = F.shiftright("_at", 33) == F.col("_g_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    out = some.join(g, same).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
    return out.drop("_at", "_first", "_before", "_g_part", *[f"_g_{c}" for c in by]), path


def _plain(order: list[Column | tuple[Column, bool]]) -> list[Column]:
    return [c[0] if isinstance(c, tuple) else c for c in order]


def _directed(c, name: str) -> Column:
    return F.col(name).desc() if isinstance(c, tuple) and c[1] else F.col(name).asc()


def binned(counted: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """``counted`` (by, _v, _c; a row for each distinct value) with _bin, ascending with _v: about ``bins`` of equally many values a group, whatever their distribution."""
    fine = max(1, round(bins**0.5))
    coarse = -(-bins // fine)
    n = coarse * fine
    shares = F.array(*[F.lit(k / n) for k in range(1, n)])
    # summaries of tasks merge; the accuracy is an eighth of a bin
    cuts = counted.groupBy(*by).agg(F.percentile_approx("_v", shares, 8 * n).alias("_s"))
    # every fine-th cut finds the coarse bin, the cuts within it the fine one
    wide = F.array(*[F.get("_s", F.lit(k - 1)) for k in range(fine, n, fine)])
    below = lambda cs: F.size(F.filter(cs, lambda c: c < F.col("_v")))
    placed = counted.join(cuts.withColumn("_w", wide), by).withColumn("_b", below(F.col("_w")))
    return placed.select(*by, "_v", "_c", (F.col("_b") * fine + below(F.slice("_s", F.col("_b") * fine + 1, F.lit(fine - 1)))).alias("_bin"))


def values_at(rows: DataFrame, by: list[str], value: str, places: dict[str, Column], bins: int = BINS) -> DataFrame:
    """Per group: the values at places (from 0, given by the group's size ``n``) of its sorted values, exactly.

    Equal values are counted first, then the bins of distinct values; the bins'
    exact counts tell which ones hold a place, and only those are looked into.
    """
    v = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    counted = v.groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    placed = binned(counted, by, bins)
    sizes = counted.groupBy(*by).agg(F.sum("_c").alias("n"))
    wanted = sizes.select(*by, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), c.cast("long").alias("at")) for name, c in places.items()])).alias("w")).select(*by, "w.*")
    before = lambda keys, order: F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = placed.groupBy(*by, "_bin").agg(F.sum("_c").alias("_c")).withColumn("_first", before(by, "_bin"))
    inside = (F.col("at") >= F.col("_first")) & (F.col("at") < F.col("_first") + F.col("_c"))
    some = whole.join(wanted, by).where(inside).select(*by, "_bin", "_first").distinct()
    hit = placed.join(some, [*by, "_bin"]).withColumn("_first", F.col("_first") + before([*by, "_bin"], "_v")).join(wanted, by).where(inside)
    return hit.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in places])
