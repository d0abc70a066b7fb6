"""Building blocks that stay distributed whatever the size of one group.

Nothing here sorts or collects a whole group in one task: quantiles come from bounded
histograms that are refined around the wanted ranks, and top-n works in two levels.
Whether a small side is broadcast is left to the engine's run-time planning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caselight.functions.expr import same

SALTS = 32
#: Rows of a part that ``dealt`` makes at most.
PART_ROWS = 500_000
#: Histogram sizes: buckets per e-fold of the first level, equal parts of the second.
PER_EFOLD, PARTS = 256, 1 << 16


def top_n_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int,
    rank: str = "rank", salts: int = SALTS,
) -> DataFrame:
    """The first n rows of every group, ranked from 1; ``order`` must be total.

    Rows are first ranked in sub-groups of tasks, then the survivors per group. Spark
    applies the limit of both windows before their shuffles, so a task sends at most
    n rows per group and the last window sees at most n * salts rows of a hot group.
    Any division into sub-groups gives the same result.
    """
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", F.spark_partition_id() % salts)
        .withColumn(rank, F.row_number().over(inner)).filter(F.col(rank) <= n)
        .drop("_salt", rank)
        .withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= n)
    )


def dealt(df: DataFrame, most: int = PART_ROWS) -> DataFrame:
    """``df`` in even parts of about ``most`` rows, at least one per core; as it is if no part is
    larger. A scan can't split the row groups of a file, and later steps keep its parts."""
    sizes = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    largest, rows = sizes.agg(F.max("n"), F.sum("n")).first()
    if (largest or 0) <= most:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)))


def _first_level(v: Column) -> Column:
    """A monotone bucket number, relative to the value's size; a few hundred thousand at most."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v) * F.lit(1e6)) * F.lit(float(PER_EFOLD))).cast("long")


def _second_level(v: Column, low: Column, high: Column) -> Column:
    """Equal parts between the least and the greatest value of a first-level bucket."""
    share = F.try_divide(v - low, high - low)
    return F.coalesce(F.floor(share * F.lit(float(PARTS))).cast("long"), F.lit(0).cast("long"))


def quantiles(
    df: DataFrame, keys: list[str], value: Column, probs: list[float], name: str = "quantiles",
    few_groups: bool = False,
) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per group, as an array column.

    First pass: counts, least and greatest value per bucket of a relative scale, combined
    before the shuffle; they tell which buckets hold the wanted ranks. Second pass: only the
    rows of those buckets, counted in equal parts between the bucket's own least and greatest
    value, so values that lie close together (epoch seconds, 100 to 101) spread as well. Third
    pass: the distinct values of the parts that hold the ranks. No group and no bucket is ever
    collected or sorted whole, and the result equals a full sort.

    ``few_groups`` tells that the caller bounds the number of groups, such as a list of
    features; then, as without keys, the few buckets wanted are given to every task.
    """
    given = F.broadcast if few_groups or not keys else lambda side: side
    ks = [f"_k{i}" for i in range(len(keys))]
    vals = (
        df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], value.cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .withColumn("_b", _first_level(F.col("_v")))
    )
    if not ks:
        ks, vals = ["_k0"], vals.withColumn("_k0", F.lit(0))
    ts = [f"_t{k}" for k in ks]
    in_group = same([F.col(k) for k in ks], [F.col(t) for t in ts])

    wanted = F.array(*[F.lit(float(p)) for p in probs])
    ends = lambda p: [f(p * (F.col("_total") - 1)).cast("long") for f in (F.floor, F.ceil)]
    ranks = F.array_distinct(F.flatten(F.transform(wanted, lambda p: F.array(*ends(p)))))
    here = F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_cum")))

    by_bucket = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    first = (
        vals.groupBy(*ks, "_b").agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        .withColumn("_cum", F.sum("_c").over(by_bucket))
        .withColumn("_total", F.sum("_c").over(Window.partitionBy(*ks)))
        .withColumn("_before", F.col("_cum") - F.col("_c")).filter(here)
        .select(*[F.col(k).alias(t) for k, t in zip(ks, ts)], F.col("_b").alias("_tb"), "_low", "_high", "_before", "_total")
    )
    inner = (
        vals.join(given(first), in_group & (F.col("_b") == F.col("_tb"))).drop(*ts, "_tb")
        .withColumn("_p", _second_level(F.col("_v"), F.col("_low"), F.col("_high")))
    )
    by_part = Window.partitionBy(*ks, "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    second = (
        inner.groupBy(*ks, "_b", "_before", "_total", "_p").agg(F.count("*").alias("_c"))
        .withColumn("_cum", F.col("_before") + F.sum("_c").over(by_part))
        .withColumn("_before", F.col("_cum") - F.col("_c")).filter(here)
        .select(*[F.col(k).alias(t) for k, t in zip(ks, ts)], F.col("_b").alias("_tb"), F.col("_p").alias("_tp"), F.col("_before").alias("_start"))
    )
    by_value = Window.partitionBy(*ks, "_b", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        inner.drop("_before").join(given(second), in_group & (F.col("_b") == F.col("_tb")) & (F.col("_p") == F.col("_tp")))
        .groupBy(*ks, "_b", "_p", "_start", "_total", "_v").agg(F.count("*").alias("_c"))
        .withColumn("_cum", F.col("_start") + F.sum("_c").over(by_value))
        .withColumn("_before", F.col("_cum") - F.col("_c"))
        .withColumn("_hit", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_cum"))))
        .filter(F.size("_hit") > 0)
        .groupBy(*ks, "_total")
        .agg(F.map_from_entries(F.flatten(F.collect_list(
            F.transform("_hit", lambda r: F.struct(r, F.col("_v")))))).alias("_m"))
    )

    def interpolated(p: Column) -> Column:
        at = p * (F.col("_total") - 1)
        lo, hi = (F.element_at("_m", r) for r in ends(p))
        return lo + (hi - lo) * (at - F.floor(at))

    return picked.select(
        *[F.col(a).alias(k) for k, a in zip(keys, ks)],
        F.transform(wanted, interpolated).alias(name),
    )


def first_by_time(
    df: DataFrame, keys: list[str], values: dict[str, Column], aggs: list[Column] | None = None,
    time: str = "created_at", ident: str = "ticket_id",
) -> DataFrame:
    """Per group: plain aggregates and the earliest non-null of every value.

    One hash aggregate yields ``aggs`` and the earliest time of each value, a plain
    long; only the rows at these times reach the second step, ties going to the
    smallest identifier. Wide text is never sorted and is read once.
    """
    rows = df.withColumns({"_at": F.unix_micros(time), **{f"_v_{n}": v for n, v in values.items()}})
    facts = rows.groupBy(*keys).agg(
        *(aggs or []),
        *[F.min(F.when(F.col(f"_v_{n}").isNotNull(), F.col("_at"))).alias(f"_t_{n}") for n in values])
    ks = [f"_f{i}" for i in range(len(keys))]
    times = facts.select(
        *[F.col(k).alias(a) for k, a in zip(keys, ks)], *[f"_t_{n}" for n in values])
    hit = F.lit(False)
    for n in values:
        hit = hit | (F.col("_at") == F.col(f"_t_{n}"))

    def earliest(n: str) -> Column:
        here = F.col(f"_v_{n}").isNotNull() & (F.col("_at") == F.col(f"_t_{n}"))
        return F.min_by(f"_v_{n}", F.when(here, F.col(ident))).alias(n)

    picked = (
        rows.select(*keys, "_at", ident, *[f"_v_{n}" for n in values])
        .join(times, same([F.col(k) for k in keys], [F.col(a) for a in ks]) & hit)
        .groupBy(*ks).agg(*[earliest(n) for n in values])
    )
    cond = same([F.col(k) for k in keys], [F.col(a) for a in ks])
    return facts.join(picked, cond, "left").drop(*ks, *[f"_t_{n}" for n in values])
