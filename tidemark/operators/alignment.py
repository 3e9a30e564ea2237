"""Alignment of frames by position, and deterministic samples."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def from_tail(df: DataFrame, name: str = "from_end") -> DataFrame:
    """Adds each row's distance from the end of its series, 0 at the last."""
    last = Window.partitionBy("series_id").orderBy(F.desc("seq"))
    return df.withColumn(name, F.row_number().over(last).cast("long") - 1)


def joined_from_tail(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with the label as far from the end of their series as they are; what leads the shorter side goes."""
    tailed = from_tail(labels).drop("seq")
    return from_tail(rows).join(tailed, ["series_id", "from_end"])


def stacked(frames: dict[str, DataFrame]) -> DataFrame:
    """Frames of (series_id, seq, value) side by side, a column for each name; a missing place is NULL."""
    out = None
    for name, df in frames.items():
        part = df.select("series_id", "seq", F.col("value").alias(name))
        out = part if out is None else out.join(part, ["series_id", "seq"], "full")
    return out


def subsample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, those whose keyed hashes are least: the same rows whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
