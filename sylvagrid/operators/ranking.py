"""Exact order statistics that never put a whole group into one task.

The built-in exact `percentile` keeps every distinct value of a group in one
hash map, and a window ordered over a group sorts it in one task. The functions
here take one path for tables of any size:

1. a few splitters from a mergeable quantile sketch cut the value axis into parts,
   whatever the groups look like; the number of parts follows the counted rows,
   so that both the parts and the rows of one part stay few;
2. the rows of each group and part are counted before they move, which gives the
   rank at which every part starts;
3. only the rows of the parts that hold a wanted rank move. Equal values are
   counted first, again before the shuffle, and each part is ordered by itself.

The table of counts is small and staged, so its size is known when it is joined
back: no other row of the table is shuffled. Group keys travel as one struct, in
which nulls equal each other, so a null key is a group like any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.functions.noise import uniform
from sylvagrid.session import stage


def part_levels(rows: int) -> int:
    """log2 of the number of value parts: a little under the square root of the rows."""
    return math.ceil(0.4 * math.log2(rows)) + 1 if rows > 1 else 0


# tasks that merge the sketches of the scan before the last one does
MERGES = 64
# rows that a task orders at once, about; more rows go to more tasks, so that the memory of one stays as it is
TASK_ROWS = 250_000


def tasks_for(rows: int) -> int:
    """Number to deal `rows` out to. A constant key must not be among what they are dealt by: Spark drops it from windows, not from the deal."""
    return max(1, math.ceil(rows / TASK_ROWS))


def splitters(df: DataFrame, value: str, parts: int) -> DataFrame:
    """One staged row: `parts` - 1 values that cut the rows into about equal parts; null where there are none.

    Sketches are merged in two levels, so that the last task gets MERGES of them, however many tasks scan.
    They are staged, as every scan that follows has to cut alike.
    """
    v = F.col(value).cast("double")
    size = F.lit(max(200, min(65_535, 4 * parts)))
    salted = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("_s"))
    merged = salted.agg(F.kll_sketch_agg_double(v, size).alias("_k")).agg(F.kll_merge_agg_double("_k").alias("_k"), F.count("_k").alias("_n"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_k", shares))
    return stage(merged.select(cuts.alias("cuts")), "splitters")


def with_place(df: DataFrame, name: str, cuts: Column, value: Column, levels: int, below: bool = False) -> DataFrame:
    """Add `name`, how many of the ordered `cuts` (fewer than 2**levels) are at most the value, or with `below` less than it.

    A binary search: one small projection per level, which whole-stage code
    generation compiles into a few array reads.
    """
    out = df.withColumn(name, F.lit(0))
    for level in reversed(range(levels)):
        step = 2**level
        cut = F.get(cuts, F.col(name) + (step - 1))
        out = out.withColumn(name, F.col(name) + F.when(cut < value if below else cut <= value, step).otherwise(0))
    return out


def with_value_part(df: DataFrame, value: str, levels: int, edge: bool = False) -> DataFrame:
    """Add `_part`, the number of the value part (0-based) a row falls into.

    With `edge` also `_edge`, whether the value is the splitter its part starts at. Whatever many rows
    share is a splitter, so the rows of a part beside its edge are few, ties or not.

    The splitters are one row of 2**levels - 1 numbers, read as a scalar subquery,
    and each row finds its part by binary search. The sketch need not be accurate,
    since the parts are counted afterwards.
    """
    if not levels:
        out = df.withColumn("_part", F.lit(0))
        return out.withColumn("_edge", F.lit(False)) if edge else out
    cuts = splitters(df, value, 2**levels).scalar()
    out = with_place(df, "_part", cuts, F.col(value), levels)
    if edge:
        out = out.withColumn("_edge", F.coalesce(F.get(cuts, F.col("_part") - 1) == F.col(value), F.lit(False)))
    return out


def group_key(keys: Sequence[str]) -> Column:
    """The keys as one struct; a single group without keys."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_"))


def _start(total: str) -> Column:
    """Sum of `total` over the parts before this one in its group."""
    before = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(before), F.lit(0))


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], weights: Sequence[str], levels: int | None = None
) -> DataFrame:
    """Add `<w>_run` (inclusive running sum by `order`) and `<w>_all` (group sum).

    Rows must be unique by (keys, order); the first column of `order` is numeric.
    Sums are built in two levels: part totals, a window over the few parts of a
    group, and a window inside a part, whose tasks follow the counted rows.
    """
    order = [order] if isinstance(order, str) else list(order)
    staged = stage(df, "running")
    rows = staged.count()
    levels = part_levels(rows) if levels is None else levels
    cut = with_value_part(staged.withColumn("_key", group_key(keys)), order[0], levels)
    per = cut.groupBy("_key", "_part").agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    group = W.partitionBy("_key")
    per = per.select(
        "_key",
        "_part",
        *[_start(f"_{w}").alias(f"_{w}_start") for w in weights],
        *[F.sum(f"_{w}").over(group).alias(f"{w}_all") for w in weights],
    )
    inside = W.partitionBy("_key", "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        cut.join(stage(per, "parts"), ["_key", "_part"])
        .repartition(tasks_for(rows), *(["_key"] if keys else []), "_part")
        .withColumns({f"{w}_run": F.col(f"_{w}_start") + F.sum(w).over(inside) for w in weights})
        .drop("_key", "_part", *[f"_{w}_start" for w in weights])
    )


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: dict[str, float | Column],
    levels: int | None = None,
    lower: bool = False,
    staged: bool = False,
) -> DataFrame:
    """Exact percentiles per group, linearly interpolated between ranks.

    `wanted` maps output names to fractions (numbers, or key columns that hold the
    fraction of a group). With `lower` the result is the order statistic at
    ceil(p * n) instead (a value that occurs in the data). Null values are ignored.
    The values are staged, unless the caller says that `df` is cheap to scan again.
    """
    keys = list(keys)
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    if not staged:
        values = stage(values, "values")
    levels = part_levels(values.count()) if levels is None else levels
    cut = with_value_part(values.withColumn("_key", group_key(keys)), "_v", levels).drop(*keys)

    def position(p):
        f = p if isinstance(p, Column) else F.lit(float(p))
        if lower:
            # a hair below, so that a product that should be whole is not rounded up
            return F.greatest(F.ceil(f * F.col("_all") - 1e-9) - 1, F.lit(0)).cast("double")
        return (F.col("_all") - 1) * f

    def holds(rank):
        return (F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_m"))

    per = (
        cut.groupBy("_key", "_part")
        .agg(F.count(F.lit(1)).alias("_m"))
        .withColumn("_all", F.sum("_m").over(W.partitionBy("_key")))
        .withColumn("_start", _start("_m"))
    )
    if keys:
        per = per.select("*", "_key.*")
    hit = F.lit(False)
    for p in wanted.values():
        hit = hit | holds(F.floor(position(p))) | holds(F.ceil(position(p)))
    near = stage(per.where(hit).select("_key", "_part", "_all", "_start"), "parts")
    inside = W.partitionBy("_key", "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (
        cut.join(near, ["_key", "_part"])
        .groupBy("_key", "_part", "_v")
        .agg(F.count(F.lit(1)).alias("_n"), F.first("_start").alias("_start"), F.first("_all").alias("_all"))
        .withColumn("_end", F.col("_start") + F.sum("_n").over(inside))
    )
    if keys:
        ranked = ranked.select("*", "_key.*")
    aggs = [F.first("_all").alias("_all")]
    for i, p in enumerate(wanted.values()):
        aggs.append(F.min(F.when(F.col("_end") > F.floor(position(p)), F.col("_v"))).alias(f"_lo{i}"))
        aggs.append(F.min(F.when(F.col("_end") > F.ceil(position(p)), F.col("_v"))).alias(f"_hi{i}"))
    picked = ranked.groupBy("_key").agg(*aggs)
    if keys:
        picked = picked.select("*", "_key.*")
    out = []
    for i, (name, p) in enumerate(wanted.items()):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * (position(p) - F.floor(position(p)))).alias(name))
    return picked.select(*keys, *out)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], staged: bool = False) -> DataFrame:
    """(keys, cuts): percentiles as in `exact_percentiles`, for many `shares`, as one array per group.

    A part is staged with the wanted ranks that it holds, so that a value is compared with these alone.
    """
    keys = list(keys)
    values = df.where(F.col(value).isNotNull()).select(group_key(keys).alias("_key"), F.col(value).alias("_v"))
    if not staged:
        values = stage(values, "values")
    cut = with_value_part(values, "_v", part_levels(values.count()))
    per = (
        cut.groupBy("_key", "_part")
        .agg(F.count(F.lit(1)).alias("_m"))
        .withColumn("_all", F.sum("_m").over(W.partitionBy("_key")))
        .withColumn("_start", _start("_m"))
    )
    wanted = F.array(*[F.lit(float(p)) for p in shares])

    def position(p):
        return (F.col("_all") - 1) * p

    ranks = F.flatten(F.array(F.transform(wanted, lambda p: F.floor(position(p))), F.transform(wanted, lambda p: F.ceil(position(p)))))
    held = F.filter(F.array_distinct(ranks), lambda r: (F.col("_start") <= r) & (r < F.col("_start") + F.col("_m")))
    near = stage(per.withColumn("_ranks", held).where(F.size("_ranks") > 0), "parts")
    inside = W.partitionBy("_key", "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = cut.join(near.select("_key", "_part"), ["_key", "_part"]).groupBy("_key", "_part", "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = counted.withColumn("_end", F.sum("_n").over(inside)).join(near, ["_key", "_part"])
    end = F.col("_start") + F.col("_end")
    mine = F.filter("_ranks", lambda r: (end - F.col("_n") <= r) & (r < end))
    found = placed.where(F.size(mine) > 0).select("_key", "_all", "_v", F.explode(mine).alias("_rank"))
    at = F.map_from_entries(F.collect_list(F.struct("_rank", "_v")))
    found = found.groupBy("_key").agg(F.first("_all").alias("_all"), at.alias("_at"))

    def between(p):
        lo, hi = F.col("_at")[F.floor(position(p))], F.col("_at")[F.ceil(position(p))]
        return lo + (hi - lo) * (position(p) - F.floor(position(p)))

    return found.select(*[F.col("_key")[k].alias(k) for k in keys], F.transform(wanted, between).alias("cuts"))


def exact_percentiles_of(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], wanted: dict[str, float], staged: bool = False
) -> DataFrame:
    """`exact_percentiles` of several columns at once, as `<name>_<column>`.

    The columns are staged side by side; they are stacked in the scans that follow.
    """
    keys = list(keys)
    wide = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values])
    wide = wide if staged else stage(wide, "values")
    long = wide.unpivot(keys, list(values), "_col", "_val")
    got = exact_percentiles(long, [*keys, "_col"], "_val", wanted, staged=True)
    aggs = [F.max(F.when(F.col("_col") == v, F.col(name))).alias(f"{name}_{v}") for v in values for name in wanted]
    out = got.groupBy(group_key(keys).alias("_key")).agg(*aggs)
    return out.select("_key.*", *[c for c in out.columns if c != "_key"]) if keys else out.drop("_key")


def sample_exact(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], size: int, seed: int, levels: int | None = None
) -> DataFrame:
    """Exactly `size` rows per group (all rows of smaller groups), without replacement.

    Rows are ranked by a hash of their identity, which `ids` make unique in a group.
    Only the identities are staged: equal ranges of the hash are parts of equal size,
    counting them finds the one with the cut, and ordering that one gives the last
    identity of the sample. Rows up to it are kept where they are read.
    """
    keys, ids = list(keys), list(ids)
    tag = {"_key": group_key(keys), "_u": uniform(seed, *keys, *ids)}
    who = F.struct("_u", *ids)
    slim = stage(df.withColumns(tag).select("_key", who.alias("_who")), "identities")
    levels = part_levels(slim.count()) if levels is None else levels
    slim = slim.withColumn("_part", F.floor(F.col("_who._u") * 2**levels))
    per = slim.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_m")).withColumn("_start", _start("_m"))
    cut = per.where((F.col("_start") < size) & (F.col("_start") + F.col("_m") >= size)).select("_key", "_part", "_start")
    rank = F.col("_start") + F.row_number().over(W.partitionBy("_key", "_part").orderBy("_who"))
    last = slim.join(stage(cut, "parts"), ["_key", "_part"]).withColumn("_rank", rank).where(F.col("_rank") == size)
    last = stage(last.select("_key", F.col("_who").alias("_last")), "cuts")
    kept = df.withColumns(tag).join(last, "_key", "left").where(F.col("_last").isNull() | (who <= F.col("_last")))
    return kept.drop("_key", "_u", "_last")
