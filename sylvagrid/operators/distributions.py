"""Distribution summaries and two-sample tests over whole columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.operators.ranking import exact_percentiles, group_key, part_levels, tasks_for, with_value_part
from sylvagrid.session import stage


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """mean, population std, median, quartiles, min and max per group."""
    df = stage(df.select(*keys, value), "summary")
    moments = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    order = exact_percentiles(df, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, staged=True)
    return moments.join(order, list(keys))


def kolmogorov_p(distance: Column, n1: Column, n2: Column, terms: int = 8) -> Column:
    """Asymptotic two-sided p-value of l = d sqrt(n1 n2 / (n1 + n2)).

    Two series of the same function, each used where a few terms exhaust it: the
    alternating one, 2 sum (-1)^(k-1) exp(-2 k^2 l^2), for large l; its theta form,
    1 - sqrt(2 pi) / l sum exp(-(2k-1)^2 pi^2 / (8 l^2)), below; 1 at 0.
    """
    scaled = n1 * n2 / (n1 + n2) * distance * distance

    def series(term):
        return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, k: acc + term(k))

    far = 2.0 * series(lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * k * k * scaled))
    odd = math.pi * math.pi / 8.0
    near = 1.0 - math.sqrt(2.0 * math.pi) / F.sqrt(scaled) * series(lambda k: F.exp(-(2 * k - 1) * (2 * k - 1) * odd / scaled))
    p = F.when(scaled <= 0, F.lit(1.0)).when(scaled < 1.18 * 1.18, near).otherwise(far)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def ks_consecutive(values: DataFrame, keys: Sequence[str], year: str, value: str, staged: bool = False) -> DataFrame:
    """Kolmogorov-Smirnov distance between consecutive years of each group.

    Values are compared as doubles; NaN comes after all numbers and null after NaN. Rows are counted by value
    part, those equal to the splitter a part starts at by themselves, which gives the distance behind every
    splitter and at the end of every part. Inside a part it stays below what the part's counts allow, so only
    the rows of the parts that can exceed the largest of these distances move, and are ordered part by part.
    The values are staged, unless the caller says that `values` is cheap to scan again.
    """
    v = F.col("_v")
    slim = values.select(group_key(keys).alias("_key"), F.col(year).alias("_year"), F.col(value).cast("double").alias("_v"))
    if not staged:
        slim = stage(slim, "values")
    levels = part_levels(slim.count())
    # NaN and null are parts of one value each
    odd = F.when(v.isNull(), 2**levels + 1).when(F.isnan(v), 2**levels)
    cut = with_value_part(slim, "_v", levels, edge=True).withColumns(
        {"_edge": F.col("_edge") | odd.isNotNull(), "_part": F.coalesce(odd, "_part")}
    )
    counts = cut.groupBy("_key", "_year", "_part").agg(F.count_if("_edge").alias("_e"), F.count_if(~F.col("_edge")).alias("_r"))
    counts = stage(counts, "parts")
    years = counts.agg(F.array_sort(F.collect_set("_year"))).scalar()
    # a year is the first of one pair and the second of the one before
    at = F.array_position("_years", F.col("_year")).cast("int")
    first = F.struct(F.col("_year").alias("year1"), F.get("_years", at).alias("year2"), F.lit(1).alias("side"))
    second = F.struct(F.get("_years", at - 2).alias("year1"), F.col("_year").alias("year2"), F.lit(2).alias("side"))
    sides = (
        counts.withColumn("_years", years)
        .select("_key", "_part", "_e", "_r", F.explode(F.array(first, second)).alias("_s"))
        .select("_key", "_part", "_e", "_r", "_s.*")
        .where("year1 IS NOT NULL AND year2 IS NOT NULL")
    )
    group = ["_key", "year1", "year2"]

    def of(side, count):
        return F.sum(F.when(F.col("side") == side, F.col(count)).otherwise(0))

    def apart(a, b):
        return F.try_divide(F.col(a), F.col("n1")) - F.try_divide(F.col(b), F.col("n2"))

    whole = W.partitionBy(*group)
    upto = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    per = sides.groupBy(*group, "_part").agg(*[of(s, c).alias(f"{c}{s}") for s in (1, 2) for c in ("_e", "_r")])
    for s in (1, 2):
        rows = F.col(f"_e{s}") + F.col(f"_r{s}")
        per = per.withColumns({f"n{s}": F.sum(rows).over(whole), f"_end{s}": F.sum(rows).over(upto)})
        per = per.withColumn(f"_at{s}", F.col(f"_end{s}") - F.col(f"_r{s}"))
    per = per.withColumns(
        {
            "ks_statistic": F.greatest(F.abs(apart("_at1", "_at2")), F.abs(apart("_end1", "_end2"))),
            "_most": F.greatest(apart("_end1", "_at2"), -apart("_at1", "_end2")),
        }
    )
    per = stage(per.withColumn("_least", F.max("ks_statistic").over(whole)), "pairs")
    near = per.where("_most > _least")
    moved = near.agg(F.sum(F.col("_r1") + F.col("_r2"))).first()[0] or 0
    both = F.explode(F.array(*[F.struct(F.col(f"year{s}").alias("_year"), F.lit(s).alias("_side")) for s in (1, 2)]))
    near = near.select(*group, F.col("_part").alias("_in"), "n1", "n2", "_at1", "_at2", both.alias("_s")).select("*", "_s.*").drop("_s")
    # no filter on `_edge`: it would be pushed below the levels of the search, each of which it would repeat
    within = F.when(F.col("_edge"), -1 - F.col("_part")).otherwise(F.col("_part")).alias("_in")
    inside = W.partitionBy(*group, "_in").orderBy("_v").rangeBetween(W.unboundedPreceding, W.currentRow)
    run = (
        cut.select("_key", "_year", within, "_v")
        .join(near, ["_key", "_year", "_in"])
        .repartition(tasks_for(moved), *(group if keys else group[1:]), "_in")
        .withColumns({f"_at{s}": F.col(f"_at{s}") + F.count_if(F.col("_side") == s).over(inside) for s in (1, 2)})
        .select(*group, F.abs(apart("_at1", "_at2")).alias("ks_statistic"), "n1", "n2")
    )
    d = (
        per.select(run.columns)
        .unionAll(run)
        .groupBy(*group)
        .agg(F.max("ks_statistic").alias("ks_statistic"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
        .select(*[F.col("_key")[k].alias(k) for k in keys], *group[1:], "ks_statistic", "n1", "n2")
    )
    return d.withColumn("p_value", kolmogorov_p(F.col("ks_statistic"), F.col("n1"), F.col("n2")))
