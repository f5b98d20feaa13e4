"""Sources and sinks: delimited text, two-schema tables, polygon layers, result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagrid.operators.spatial import valid_polygons


def read_codes(spark: SparkSession, path: str, code: str, schema: str, sep: str = ";") -> DataFrame:
    """Delimited text with a declared schema; incomplete rows are dropped, the code becomes an integer."""
    table = spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)
    return table.dropna().withColumn(code, F.col(code).cast("int"))


def read_two_schemas(direct: DataFrame, volumes: DataFrame, density: DataFrame) -> DataFrame:
    """Rows with reported biomass united with rows that report stem and branch volume.

    Volumes become AGB through the wood density of the species; they carry no BGB.
    """
    reported = direct.withColumnsRenamed({"ba": "agb", "br": "bgb"})
    derived = (
        volumes.join(density.select(F.col("code").alias("especie"), "density"), "especie", "left")
        .withColumn("agb", (F.col("vcc") + F.col("vle")) * F.col("density"))
        .drop("vcc", "vle", "density", "especie")
    )
    return reported.unionByName(derived, allowMissingColumns=True)


def unite_layers(layers: Sequence[DataFrame], label: str, default: str, ident: str, size: float) -> DataFrame:
    """Polygon layers with and without the label column; polygons with broken rings or a crossing outline are left out.

    `ident` names a polygon in all layers, `size` is that of the buckets in which its edges are compared.
    """
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return valid_polygons(out, ident, size).withColumn(label, F.coalesce(F.col(label), F.lit(default)))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> str:
    """Parquet below `by` folders. Rows of a folder come from few tasks, so files stay large."""
    df.repartition(*[F.col(c) for c in by]).write.mode("errorifexists").partitionBy(*by).parquet(path)
    return path


def write_skewed(df: DataFrame, path: str, by: Sequence[str], spread: str, files: int) -> str:
    """As write_partitioned, but a folder's rows are spread over up to `files` tasks by `spread`."""
    salt = F.pmod(F.xxhash64(spread), F.lit(files))
    df.repartition(*[F.col(c) for c in by], salt).write.mode("errorifexists").partitionBy(*by).parquet(path)
    return path


def write_table(df: DataFrame, path: str) -> str:
    """A result table as one CSV file with a header (results are summaries of bounded size)."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)
    return path


def write_layer(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> str:
    """A cell layer bucketed and sorted by its key.

    Layers of one grid written with the same bucket count join on the key without
    a shuffle, which is how the static layers (types, land cover) should meet the
    annual ones.
    """
    writer = df.write.mode("errorifexists").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return table
