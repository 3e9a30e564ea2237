"""The long feature table: filters, views, names, validation and suppression.

Canonical columns: series_id, bar_index, threshold_dbps, lookback, feature, value, valid, computed_at,
nav_hash. Wide, dense and nested forms are views; analysis stays on the long table, where filters reach the
scan and no column list has to be known.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from .bars import nav_hash
from .rolling import CODES, long_features, rolling_features

KEYS = ("series_id", "bar_index", "threshold_dbps", "lookback", "feature")
COLUMNS = (*KEYS, "value", "valid", "computed_at", "nav_hash")
# How a wide column is named, and the patterns suppressed by default.
NAME = r"^ith_rb(\d+)_lb(\d+)_(.+)$"
SUPPRESSED = (
    ("ith_rb25_lb*_*", "redundant", "Highly correlated with rb1000 equivalents"),
    ("ith_rb50_lb*_*", "redundant", "Highly correlated with rb1000 equivalents"),
    ("ith_rb100_lb*_*", "redundant", "Highly correlated with rb1000 equivalents"),
    ("ith_rb250_lb*_*", "redundant", "Highly correlated with rb1000 equivalents"),
    ("ith_rb500_lb*_*", "redundant", "Highly correlated with rb1000 equivalents"),
    ("ith_*_lb20_*", "unstable", "High variance in walk-forward validation"),
    ("*_intermediate_*", "debug", "Diagnostic features, not for ML"),
)


class FeatureStore:
    """A long feature frame with filters and views; every method returns a frame or a store, none collects rows."""

    def __init__(self, df: DataFrame):
        missing = set(KEYS + ("value",)) - set(df.columns)
        if missing:
            raise ValueError(f"missing columns: {sorted(missing)}")
        self.df = df if "valid" in df.columns else df.withColumn("valid", F.col("value").isNotNull() & ~F.isnan("value"))

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> "FeatureStore":
        return cls(spark.read.parquet(path))

    @classmethod
    def from_wide(cls, wide: DataFrame, series: str = "series_id", bar: str = "bar_index", threshold: int | None = None) -> "FeatureStore":
        """Unpivot the columns whose names parse; others are left out."""
        parsed = {c: m for c in wide.columns if (m := re.match(NAME, c)) and (threshold is None or int(m[1]) == threshold)}
        tall = wide.select(F.col(series).alias("series_id"), F.col(bar).alias("bar_index"), *(F.col(c).cast("double").alias(c) for c in parsed)).unpivot(["series_id", "bar_index"], list(parsed), "name", "value")
        return cls(tall.select("series_id", "bar_index", *(c.alias(n) for n, c in parse_name(F.col("name")).items()), "value"))

    @classmethod
    def from_computation(cls, nav: DataFrame, lookbacks: tuple[int, ...], threshold: int, computed_at: str = "1970-01-01 00:00:00") -> "FeatureStore":
        """Rolling features of (series_id, seq, nav), each row with the hash of its series' values."""
        tall = long_features(rolling_features(nav.select("series_id", "seq", "nav"), lookbacks), threshold, computed_at).drop("nav_hash")
        return cls(tall.join(nav_hash(nav), "series_id"))

    def filter(self, series: str | None = None, threshold: int | None = None, lookback: int | None = None, feature: str | None = None) -> "FeatureStore":
        df = self.df
        for column, value in (("series_id", series), ("threshold_dbps", threshold), ("lookback", lookback), ("feature", feature)):
            if value is not None:
                df = df.filter(F.col(column) == value)
        return FeatureStore(df)

    def distinct(self, column: str) -> DataFrame:
        return self.df.select(column).distinct().orderBy(column)

    def to_wide(self, drop_warmup: bool = True, names: list[str] | None = None) -> DataFrame:
        """One column for each threshold, lookback and feature; ``names`` spares the job that finds them. The warm-up has a NULL, not NaN."""
        named = self.df.withColumn("name", X.feature_name(F.col("threshold_dbps"), F.col("lookback"), F.col("feature")))
        wide = named.groupBy("series_id", "bar_index").pivot("name", names or None).agg(F.first("value"))
        made = [F.col(f"`{c}`").isNotNull() for c in wide.columns]
        return wide.filter(reduce(lambda a, b: a & b, made)) if drop_warmup else wide

    def to_dense(self, threshold: int, names: list[str] | None = None) -> DataFrame:
        """One threshold's columns, without it in their names and with the warm-up."""
        named = self.df.filter(F.col("threshold_dbps") == threshold).withColumn("name", F.format_string("lb%d_%s", "lookback", "feature"))
        return named.groupBy("series_id", "bar_index").pivot("name", names or None).agg(F.first("value"))

    def to_nested(self) -> DataFrame:
        """(series_id, bar_index, features as JSON): threshold, lookback and feature as nested maps of valid values, keys in order."""

        def keyed(name: Column, value: Column) -> Column:
            entries = F.sort_array(F.collect_list(F.struct(name.alias("k"), value.cast("string").alias("v"))))
            return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["k"], F.lit('":'), e["v"])), ","), F.lit("}"))

        at = ["series_id", "bar_index"]
        by_lookback = self.df.filter("valid and not isnan(value)").groupBy(*at, "threshold_dbps", "lookback").agg(keyed(F.col("feature"), F.col("value")).alias("m"))
        by_threshold = by_lookback.groupBy(*at, "threshold_dbps").agg(keyed(F.format_string("lb%05d", "lookback"), F.col("m")).alias("m"))
        return by_threshold.groupBy(*at).agg(keyed(F.format_string("rb%05d", "threshold_dbps"), F.col("m")).alias("features"))

    def save(self, path: str) -> None:
        self.df.write.mode("overwrite").partitionBy("threshold_dbps").parquet(path)


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """The results of several jobs in one frame; columns that a part lacks are NULL there."""
    if not parts:
        raise ValueError("no parts")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def parse_name(name: Column) -> dict[str, Column]:
    """Threshold, lookback and feature of a wide column's name; NULL where it does not parse."""
    part = lambda i: F.nullif(F.regexp_extract(name, NAME, i), F.lit(""))
    return {"threshold_dbps": part(1).cast("int"), "lookback": part(2).cast("int"), "feature": part(3)}


def feature_columns(columns: list[str], threshold: int | None = None, lookback: int | None = None, feature: str | None = None) -> list[str]:
    """The names among ``columns`` that parse and agree, sorted."""
    found = [(c, re.match(NAME, c)) for c in columns]
    return sorted(c for c, m in found if m and (threshold is None or int(m[1]) == threshold) and (lookback is None or int(m[2]) == lookback) and (feature is None or m[3] == feature))


def names_by(names: DataFrame, part: str) -> DataFrame:
    """(part, names): the sorted wide names of each threshold_dbps, lookback or feature; a configuration's few names."""
    return names.select("name", parse_name(F.col("name"))[part].alias(part)).filter(F.col(part).isNotNull()).groupBy(part).agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def expected_names(spark: SparkSession, thresholds: list[int], lookbacks: list[int]) -> DataFrame:
    """All wide names of a configuration."""
    rows = [(f"ith_rb{t}_lb{n}_{c}",) for t in thresholds for n in lookbacks for c in CODES]
    return spark.createDataFrame(rows, "name string")


def name_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, side): names only expected (missing) or only there (extra)."""
    one, two = expected.select("name").distinct(), actual.select("name").distinct()
    return one.join(two, "name", "left_anti").withColumn("side", F.lit("missing")).unionByName(two.join(one, "name", "left_anti").withColumn("side", F.lit("extra")))


def drop_warmup(df: DataFrame, lookbacks: list[int], position: str = "bar_index") -> DataFrame:
    return df.filter(F.col(position) >= max(lookbacks) - 1)


def warmup_check(df: DataFrame, lookbacks: list[int], least: int = 100) -> DataFrame:
    """(series_id, n_bars, warmup, n_valid, enough) of each series."""
    warm = max(lookbacks) - 1
    by = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_bars"))
    return by.select("series_id", "n_bars", F.lit(warm).alias("warmup"), F.greatest(F.col("n_bars") - warm, F.lit(0)).alias("n_valid"), (F.col("n_bars") - warm >= least).alias("enough"))


def validation(df: DataFrame) -> DataFrame:
    """Counts of rule violations of a long table, in one pass: (rule, n_violations)."""
    rules = {
        "null_key": F.greatest(*(F.col(k).isNull().cast("int") for k in KEYS)),
        "unknown_feature": (~F.col("feature").isin(*CODES)).cast("int"),
        "out_of_bounds": F.coalesce(((F.col("value") < 0) | (F.col("value") > 1)).cast("int"), F.lit(0)),
        "not_positive": ((F.col("threshold_dbps") <= 0) | (F.col("lookback") <= 0)).cast("int"),
        "negative_position": (F.col("bar_index") < 0).cast("int"),
    }
    counted = df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in rules.items()))
    return counted.unpivot([], list(rules), "rule", "n_violations")


def duplicates(df: DataFrame) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*KEYS).count().filter("count > 1")


def glob_to_regex(pattern: Column) -> Column:
    """A shell pattern with ``*`` and ``?`` as a regular expression."""
    quoted = F.regexp_replace(pattern, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def suppression_table(spark: SparkSession, patterns: tuple = SUPPRESSED) -> DataFrame:
    rows = [(k, *p) for k, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "ord int, pattern string, category string, reason string")


def suppression_reasons(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(name, category, reason) of the first pattern that matches each name. The pattern table is a configuration of a few rows."""
    met = names.join(F.broadcast(patterns.withColumn("rx", glob_to_regex(F.col("pattern")))), F.expr("name rlike rx"))
    return met.groupBy("name").agg(F.min_by(F.struct("category", "reason"), "ord").alias("m")).select("name", "m.category", "m.reason")


def without_suppressed(names: DataFrame, patterns: DataFrame) -> DataFrame:
    return names.join(F.broadcast(patterns.withColumn("rx", glob_to_regex(F.col("pattern")))), F.expr("name rlike rx"), "left_anti")


def suppression_summary(names: DataFrame, patterns: DataFrame) -> DataFrame:
    return suppression_reasons(names, patterns).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def top_per_group(scores: DataFrame, group: str, score: str, name: str, n: int) -> DataFrame:
    """The ``n`` best rows of each group; ties go to the name that sorts first."""
    best = Window.partitionBy(group).orderBy(F.desc(score), name)
    return scores.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)
