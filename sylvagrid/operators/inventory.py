"""Forest-inventory tables: plot totals, wood density, tiers, parameter lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvagrid.operators.ranking import exact_percentiles


def plot_totals(rows: DataFrame, keys: Sequence[str], complete: bool = False) -> DataFrame:
    """Summed AGB and BGB per plot; a plot without any BGB sums to 0.

    With `complete`, plots with a tree that lacks AGB are left out: the trees without
    are counted beside the sums, in the same aggregate.
    """
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("agb", "bgb")]
    if not complete:
        return rows.groupBy(*keys).agg(*sums)
    totals = rows.groupBy(*keys).agg(*sums, F.count_if(F.col("agb").isNull()).alias("_lacking"))
    return totals.where("_lacking = 0").drop("_lacking")


def wood_density(species: DataFrame, densities: DataFrame) -> DataFrame:
    """code -> density: mean of the species if listed, else of its genus, else of all.

    `species(code, binomial)`, `densities(binomial, density)`. A listed species
    whose densities are all null stays null. The density table is reduced to one
    row per species and per genus before it is joined.
    """
    genus = F.substring_index("binomial", " ", 1)
    by_species = densities.groupBy("binomial").agg(F.avg("density").alias("_s"), F.lit(True).alias("_in_s"))
    by_genus = densities.groupBy(genus.alias("_g")).agg(F.avg("density").alias("_gd"), F.lit(True).alias("_in_g"))
    overall = densities.agg(F.avg("density")).scalar()
    level = F.when(F.col("_in_s"), "species").when(F.col("_in_g"), "genus").otherwise("all")
    return (
        species.withColumn("_g", genus)
        .join(by_species, "binomial", "left")
        .join(by_genus, "_g", "left")
        .select(
            "code",
            level.alias("level"),
            F.when(F.col("_in_s"), F.col("_s")).when(F.col("_in_g"), F.col("_gd")).otherwise(overall).alias("density"),
        )
    )


def stack_tiers(rows: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """Every row once for General (tier 0) and once per tier it has a name in."""
    parts = [F.struct(F.lit(0).alias("tier"), F.lit("General").alias("tier_name"))]
    parts += [F.struct(F.lit(i).alias("tier"), F.col(t).alias("tier_name")) for i, t in enumerate(tiers, 1)]
    return (
        rows.withColumn("_t", F.explode(F.array(*parts)))
        .where("_t.tier_name IS NOT NULL")
        .select("*", "_t.tier", "_t.tier_name")
        .drop("_t")
    )


def iqr_bounds(rows: DataFrame, keys: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    """Per group the fence [Q1 - k IQR, Q3 + k IQR]."""
    q = exact_percentiles(rows, keys, value, {"_q1": 0.25, "_q3": 0.75})
    spread = k * (F.col("_q3") - F.col("_q1"))
    return q.select(*keys, (F.col("_q1") - spread).alias("fence_low"), (F.col("_q3") + spread).alias("fence_high"))


def iqr_filter(rows: DataFrame, keys: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    fenced = rows.join(iqr_bounds(rows, keys, value, k), list(keys))
    return fenced.where(F.col(value).between(F.col("fence_low"), F.col("fence_high")))


def groups_of_at_least(rows: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Rows of groups with enough members; counted by aggregation, not by a window."""
    enough = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return rows.join(enough, list(keys), "left_semi")


def tier_chain(types: DataFrame, parents: DataFrame) -> DataFrame:
    """(type_name, tier, tier_name): the lookups tried for a type, most specific first.

    The climb stops at the first missing parent and goes to General; the
    treeless type asks General only.
    """
    chain = ["type_name", "genus", "family", "clade"]
    known = types.join(parents, F.col("type_name") == F.col("name"), "left")
    general = F.struct(F.lit(0).alias("tier"), F.lit("General").alias("tier_name"))
    reached = F.col("type_name") != "No arbolado"
    steps = []
    for tier, col in zip((4, 3, 2, 1), chain):
        reached = reached & F.col(col).isNotNull()
        steps.append(F.when(reached, F.struct(F.lit(tier).alias("tier"), F.col(col).alias("tier_name"))))
    return known.select("type_name", F.explode(F.array_compact(F.array(*steps, general))).alias("t")).select(
        "type_name", "t.tier", "t.tier_name"
    )


def resolve_parameters(chain: DataFrame, fitted: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    """Per type the parameters of the most specific tier that has them, else 0."""
    found = (
        chain.join(fitted, ["tier", "tier_name"], "left")
        .groupBy("type_name")
        .agg(
            F.max_by(F.struct("tier", *columns), F.when(F.col(columns[0]).isNotNull(), F.col("tier"))).alias("p")
        )
    )
    return found.select(
        "type_name",
        F.col("p.tier").alias(f"{prefix}_tier"),
        *[F.coalesce(F.col(f"p.{c}"), F.lit(0.0)).alias(f"{prefix}_{c}") for c in columns],
    )


def first_per_id(files: DataFrame, ids: Sequence[str], order: str, keep: Sequence[str]) -> DataFrame:
    """First file of every id; a map-side combined min_by instead of a ranking window."""
    return (
        files.groupBy(*ids)
        .agg(F.min_by(F.struct(order, *keep), F.struct(order, *keep)).alias("s"))
        .select(*ids, f"s.{order}", *[f"s.{k}" for k in keep])
    )


def validate_columns(df: DataFrame, table: str, required: Sequence[str]) -> DataFrame:
    """(table, column, present, rows, nulls, min, max) in one pass over the table."""
    present = [c for c in required if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in present:
        aggs += [
            F.count_if(F.col(c).isNull()).alias(f"_null_{c}"),
            F.min(c).cast("double").alias(f"_min_{c}"),
            F.max(c).cast("double").alias(f"_max_{c}"),
        ]
    entries = []
    for c in required:
        has = c in present
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(has).alias("present"),
                (F.col(f"_null_{c}") if has else F.lit(None).cast("bigint")).alias("n_null"),
                (F.col(f"_min_{c}") if has else F.lit(None).cast("double")).alias("min_value"),
                (F.col(f"_max_{c}") if has else F.lit(None).cast("double")).alias("max_value"),
            )
        )
    return df.agg(*aggs).select(
        F.lit(table).alias("table_name"), F.col("_rows").alias("n_rows"), F.inline(F.array(*entries))
    )
