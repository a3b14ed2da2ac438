"""The aircraft registry: reading it, choosing a release, checking its size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a published registry and ours.
REGISTRY_COLUMNS = {
    "aircraft_registration": "registration", "aircraft_country": "country", "aircraft_type_code": "type_code",
    "type_description": "type_description", "type_icao_class": "type_icao_class", "model": "model",
    "aircraft_manufacturer_icao": "manufacturer_icao", "manufacturer_name": "manufacturer_name",
    "operator_name": "operator_name",
}
REGISTRY_FLAGS = {"faa_pia": "pia", "faa_ladd": "ladd", "military": "military"}


def read_registry(spark: SparkSession, path, fmt: str = "parquet", key: str = "icao") -> DataFrame:
    """Registry rows with our column names; integer flags become booleans, missing columns null."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return normalize_registry(reader.load(path), key)


def normalize_registry(raw: DataFrame, key: str = "icao") -> DataFrame:
    def column(name, kind):
        return F.col(name).cast(kind) if name in raw.columns else F.lit(None).cast(kind)

    return raw.select(
        F.upper(F.trim(F.col(key).cast("string"))).alias("icao"),
        *[column(old, "string").alias(new) for old, new in REGISTRY_COLUMNS.items()],
        *[(column(old, "long") != 0).alias(new) for old, new in REGISTRY_FLAGS.items()],
    )


def latest_release(files: DataFrame, path: str = "path", extension: str = "sqlite") -> DataFrame:
    """The newest release among file names ``<name>_<year>.<quarter>.w<week>_r<revision>``.

    One row; names that do not parse are dropped.
    """
    pattern = r"^(?:.*/)?[^/]*_(\d{4})\.([1-4])\.w(\d{2})_r(\d+)\." + extension + "$"
    named = files.where(F.col(path).rlike(pattern))
    parts = [F.regexp_extract(F.col(path), pattern, i + 1).cast("int") for i in range(4)]
    version = F.struct(*[p.alias(n) for p, n in zip(parts, ("year", "quarter", "week", "revision"))])
    best = named.select(F.col(path).alias("path"), version.alias("version")).agg(
        F.max_by("path", "version").alias("path"), F.max("version").alias("version"))
    return best.where("path IS NOT NULL").select("path", "version.*")


def check_registry(df: DataFrame, expected: int) -> DataFrame:
    """One row: the row count, the published count, and whether they match."""
    out = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("expected", F.lit(expected).cast("long"))
    return out.withColumn("matches", F.col("n_rows") == F.col("expected"))
