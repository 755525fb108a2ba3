"""Stage tables: parquet in folders by exchange, with a one-row summary beside the data."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.review import table_fingerprint


def shared_folder(spark) -> str:
    """The cluster's shared folder; a temporary one only where none is set and driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.conf.get("spark.master").partition("[")[0] != "local":
        raise ValueError("stage tables need a folder that all executors share: set spark.checkpoint.dir")
    return folder or tempfile.mkdtemp(prefix="tidemark-")


def write_table(df: DataFrame, path: str, name: str, formula_version: str, partition: str = "exchange") -> None:
    """Write the data and its fingerprint.

    Folders by exchange, not by instrument: ten thousand instruments would make as many
    small folders; inside a folder rows are ordered by instrument so that file statistics
    prune a single one. Tasks take ranges of (folder, instrument, date), so an instrument of
    very many rows is split by date.
    """
    order = [c for c in ("ticker", "date", "prediction_date") if c in df.columns]
    df.repartitionByRange(partition, *order).sortWithinPartitions(partition, *order).write.mode("overwrite").partitionBy(
        partition).parquet(f"{path}/data")
    saved = df.sparkSession.read.parquet(f"{path}/data")
    table_fingerprint(saved.select(*df.columns), formula_version, name).write.mode("overwrite").json(f"{path}/summary")


def read_table(spark, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/data")
    missing = [c for c in columns or () if c not in df.columns]
    if missing:
        raise ValueError(f"table at {path} lacks columns {missing}")
    return df.select(*columns) if columns else df


MANIFEST = "sequence long, version string, table_name string, formula_version string, partition string"


def partition_fingerprints(df: DataFrame, partition: str) -> DataFrame:
    """(part, row_count, content_hash) per value of the partition column; null is a value."""
    columns = sorted(df.columns)
    return df.groupBy(F.col(partition).cast("string").alias("part")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.xxhash64(*columns).cast("decimal(28,0)")).cast("decimal(38,0)").alias("content_hash"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """All finished versions of a stage table; none where nothing was written."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in (absent.getCondition() or ""):
            raise
        return spark.createDataFrame([], MANIFEST)


def write_version(df: DataFrame, path: str, name: str, formula_version: str, partition: str = "exchange") -> str:
    """Write a new version beside the old ones and then point the manifest at it; returns the version.

    Data and fingerprints lie in a folder of their own before the manifest's one line is appended, so a
    write that dies leaves the last finished version in use.
    """
    spark, version = df.sparkSession, uuid4().hex[:12]
    order = [c for c in ("ticker", "date", "prediction_date") if c in df.columns]
    folder = f"{path}/versions/{version}"
    df.repartitionByRange(partition, *order).sortWithinPartitions(partition, *order).write.partitionBy(partition).parquet(f"{folder}/data")
    saved = spark.read.schema(df.schema).parquet(f"{folder}/data").select(*df.columns)
    partition_fingerprints(saved, partition).write.parquet(f"{folder}/fingerprints")
    last = manifest(spark, path).agg(F.max("sequence")).collect()[0][0]
    spark.createDataFrame([(0 if last is None else last + 1, version, name, formula_version, partition)], MANIFEST).coalesce(
        1).write.mode("append").json(f"{path}/manifest")
    return version


def current_version(spark: SparkSession, path: str, formula_version: str | None = None) -> Row:
    """The manifest line of the version in use; refused if it was built by another formula."""
    line = manifest(spark, path).orderBy(F.desc("sequence"), F.desc("version")).first()
    if line is None:
        raise ValueError(f"no finished version at {path}")
    if formula_version is not None and line["formula_version"] != formula_version:
        raise ValueError(f"table at {path} was built by formula {line['formula_version']}, not {formula_version}")
    return line


def read_version(spark: SparkSession, path: str, schema: StructType | str, formula_version: str | None = None,
                 version: str | None = None) -> DataFrame:
    """The version in use, or a named one."""
    version = version or current_version(spark, path, formula_version)["version"]
    return spark.read.schema(schema).parquet(f"{path}/versions/{version}/data")


def stale_parts(spark: SparkSession, path: str, source: DataFrame) -> DataFrame:
    """(part, reason) of the partitions in which `source` differs from the version in use: only these need a rebuild."""
    line = current_version(spark, path)
    saved = spark.read.parquet(f"{path}/versions/{line['version']}/fingerprints")
    now = partition_fingerprints(source, line["partition"])
    a, b = saved.alias("a"), now.alias("b")
    both = a.join(b, F.col("a.part").eqNullSafe(F.col("b.part")), "full")
    reason = F.when(F.col("a.row_count").isNull(), "new").when(F.col("b.row_count").isNull(), "gone").when(
        (F.col("a.row_count") != F.col("b.row_count")) | (F.col("a.content_hash") != F.col("b.content_hash")), "content")
    return both.select(F.coalesce("a.part", "b.part").alias("part"), reason.alias("reason")).where("reason IS NOT NULL")


SUMMARY_SCHEMA = "table_name string, formula_version string, columns string, row_count long, content_hash decimal(38,0)"


def read_summary(spark, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY_SCHEMA).json(f"{path}/summary")


def require_version(summary: DataFrame, formula_version: str) -> DataFrame:
    """Rows of tables built with another formula version; empty when reuse is allowed."""
    return summary.where(F.col("formula_version") != formula_version)


def read_bars(spark, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Landed provider bars with normalized column names."""
    from tidemark.operators.bars import normalize_provider_columns

    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if schema:
        reader = reader.schema(schema)
    return normalize_provider_columns(reader.load(path))
