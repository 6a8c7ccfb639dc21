"""Sinks: canonical JSONL, sharded Parquet with manifests, releases, checked on the way back in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(rows: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Rows as JSON lines in order, over as many files as there are ranges; (n, fingerprint) of the lines."""
    lines = rows.select(*order, F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)
    return fingerprint(lines, F.col("value"))


def fingerprint(rows: DataFrame, value: Column) -> DataFrame:
    """(n, fingerprint) whatever the order: exact sums of two halves of each row's sha256."""
    digest = F.sha2(value, 256)
    halves = [F.sum(F.conv(F.substr(digest, F.lit(1 + 15 * k), F.lit(15)), 16, 10).cast("decimal(38,0)")) for k in range(2)]
    return rows.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", *(F.coalesce(h, F.lit(0)).cast("string") for h in halves)), 256).alias("fingerprint"))


def shards(rows: DataFrame, path: str, rows_per_file: int = 50_000, by: str | None = None) -> DataFrame:
    """Zstd Parquet of bounded files, partitioned if asked; the manifest: file, rows, by."""
    writer = rows.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(by) if by else writer).parquet(path)
    back = rows.sparkSession.read.parquet(path)
    keys = [F.col("_metadata.file_name").alias("file"), *([F.col(by)] if by else [])]
    return back.groupBy(*keys).agg(F.count("*").alias("rows"))


def verify(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, problem): files that are missing, extra or of another row count than the manifest's; none if all is well."""
    there = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("found"))
    joined = manifest.select("file", F.col("rows").alias("expected")).join(there, "file", "full")
    problem = F.when(F.col("found").isNull(), "MISSING").when(F.col("expected").isNull(), "EXTRA").when(F.col("found") != F.col("expected"), "ROWS")
    return joined.select("file", problem.alias("problem")).where("problem is not null")


def release(rows: DataFrame, licences: DataFrame, path: str, forbidden_splits: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of sources whose licence permits it, partitioned by source: (manifest by source, sources left out).

    ``licences``: source, license, permitted.
    """
    joined = rows.join(licences, "source", "left")
    permitted = F.coalesce(F.col("permitted"), F.lit(False))
    if forbidden_splits and "split" in rows.columns:
        permitted = permitted & ~F.col("split").isin(*forbidden_splits)
    joined.where(permitted).select(*rows.columns, "license").write.mode("overwrite").partitionBy("source").option("compression", "zstd").parquet(path)
    manifest = rows.sparkSession.read.parquet(path).groupBy("source", "license").agg(F.count("*").alias("rows"))
    return manifest, joined.where(~permitted).groupBy("source").agg(F.count("*").alias("rows"))


def without_source(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A release without one source: its partition is never read."""
    return spark.read.parquet(path).where(F.col("source") != source)
