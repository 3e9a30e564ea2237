"""Sinks: Parquet tables, JSON lines, schema evolution and upserts as rewrites of the partitions touched."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import latest


def write_views(wide_by_threshold: DataFrame, path: str) -> None:
    wide_by_threshold.write.mode("overwrite").partitionBy("threshold_dbps").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def prepared_for_warehouse(bars: DataFrame, columns: list[str]) -> DataFrame:
    """Only known columns, absent ones as NULL, and 0 for missing inter-bar numbers."""
    kept = bars.select(*(F.col(c) if c in bars.columns else F.lit(None).cast("double").alias(c) for c in columns))
    return kept.fillna(0.0, [c for c in columns if c.startswith("lookback_")])


def with_columns_added(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Schema evolution: columns that are absent, as (type, default)."""
    return df.withColumns({n: F.lit(default).cast(kind) for n, (kind, default) in columns.items() if n not in df.columns})


def upsert(spark: SparkSession, path: str, fresh: DataFrame, keys: list[str], version: str, out: str) -> None:
    """Write the newest row of each key of the table at ``path`` and ``fresh`` together to ``out``."""
    latest(spark.read.parquet(path).unionByName(fresh, allowMissingColumns=True), keys, version).write.mode("overwrite").parquet(out)
