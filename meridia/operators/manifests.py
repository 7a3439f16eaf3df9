"""Manifests of written products, and the contract that they must keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.sources.files import file_ledger

MANIFEST = "role string, artifact_class string, version int, files long, bytes long, sha256 string, feature_count long"


def output_manifest(spark: SparkSession, artifacts: dict[str, tuple[str, str, int]]) -> DataFrame:
    """A row for each role of artifacts (role to path of a Parquet table, class and version): files, bytes, the SHA-256 of the files' digests in
    order of name, and rows. Files are read a task at a time; of each only a row goes on."""

    def one(role: str, path: str, kind: str, version: int) -> DataFrame:
        files = file_ledger(spark, path).where("name LIKE '%.parquet'")
        whole = files.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "sha256"))), lambda f: f["sha256"]), ""), 256).alias("sha256"))
        rows = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("feature_count"))
        return whole.crossJoin(rows).select(F.lit(role).alias("role"), F.lit(kind).alias("artifact_class"), F.lit(version).alias("version"), "files", "bytes", "sha256", "feature_count")  # one row each

    return reduce(DataFrame.unionByName, [one(role, *spec) for role, spec in artifacts.items()])


def contract_errors(manifest: DataFrame, roles: DataFrame, required: list[str], legacy: list[str], versions: tuple[int, ...], links: dict[str, DataFrame] | None = None) -> DataFrame:
    """(role, error): required fields that are null or not there, legacy ones that are, unknown versions, roles (a column of that name) without a row or
    with several, and for each column of links values that its table's only column does not have."""
    have = {c.lower() for c in manifest.columns}
    tests = [F.when(F.col(c).isNull() if c.lower() in have else F.lit(True), f"missing {c}") for c in required]
    tests += [F.when(F.col(c).isNotNull(), f"legacy {c}") for c in legacy if c.lower() in have]
    tests += [F.when(~F.coalesce(F.col("version").isin(*versions), F.lit(False)), "unknown version")]
    errors = [manifest.select("role", F.explode(F.array_compact(F.array(*tests))).alias("error"))]
    counts = roles.select("role").distinct().join(manifest.groupBy("role").agg(F.count(F.lit(1)).alias("n")), "role", "left")
    errors.append(counts.where("n IS NULL OR n > 1").select("role", F.when(F.col("n").isNull(), "no row").otherwise("several rows").alias("error")))
    for column, table in (links or {}).items():
        known = table.select(F.col(table.columns[0]).alias(column)).distinct()
        errors.append(manifest.where(F.col(column).isNotNull()).join(known, column, "left_anti").select("role", F.lit(f"dangling {column}").alias("error")))
    return reduce(DataFrame.unionByName, errors)
