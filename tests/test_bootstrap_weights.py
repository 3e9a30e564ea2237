"""Bootstrap draws of batches against Spark's own hashes, and blocks numbered by ranges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import resampling


def plain(long, target, replicates, block, seed=42):
    """Blocks multiplied by replicates, as one row each."""
    rows = long.join(target, ["series_id", "seq"]).filter("value is not null and target is not null")
    x, y = F.col("value"), F.col("target")
    terms = {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}
    blocks = rows.groupBy("feature", "series_id", F.floor(F.col("seq") / block).alias("block")).agg(*(F.sum(t).alias(k) for k, t in terms.items()))
    u = F.pmod(F.xxhash64(F.lit(seed), "replicate", "series_id", "block"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    at = [sum(math.exp(-1) / math.factorial(j) for j in range(k)) for k in range(1, 7)]
    spread = blocks.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", sum((u >= b).cast("int") for b in at))
    sums = spread.groupBy("feature", "replicate").agg(F.sum("w").alias("w"), *(F.sum(F.col("w") * F.col(k)).alias(k) for k in terms)).filter("w > 0").toPandas()
    cov = sums.n * sums.sxy - sums.sx * sums.sy
    var = (sums.n * sums.sxx - sums.sx**2) * (sums.n * sums.syy - sums.sy**2)
    sums["r"] = np.where(var > 0, cov**2 / var.where(var > 0, 1), 0.0)
    return {f: (g.r.mean(), g.r.std(ddof=0)) for f, g in sums.groupby("feature")}


NAMES = ("A", "", "a series of thirty-two bytes ....", "seventeen bytes..", "élan", "a name that is longer than two stripes of thirty-two bytes each is")


def test_draws_equal_spark_hashes(spark):
    rng = np.random.default_rng(3)
    made = [(s, i, f, None if i % 11 == 5 else float(v)) for s in NAMES for i in range(40) for f, v in (("a", rng.normal()), ("b", i))]
    long = spark.createDataFrame(made, "series_id string, seq long, feature string, value double").repartition(5)
    target = spark.createDataFrame([(s, i, float(i + rng.normal())) for s in NAMES for i in range(40) if i % 13], "series_id string, seq long, target double")
    found = resampling.bootstrap_importance(long, target, 30, block=3)
    # Rows aren't multiplied by replicates.
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = plain(long, target, 30, 3)
    got = {r.feature: (r.mean_importance, r.std_importance) for r in found.collect()}
    assert set(got) == set(want) == {"a", "b"}
    for f in want:
        assert got[f] == pytest.approx(want[f], rel=1e-9), f


def test_places_of_block_lengths_are_counted_by_ranges(spark, monkeypatch):
    """Gaps and nulls close up; no window numbers a whole series."""
    from tidemark.operators import spread

    monkeypatch.setattr(spread, "SPAN", 64)
    x = np.cumsum(np.random.default_rng(4).normal(size=500))
    rows = [("s", 3 * i, None if i % 7 == 3 else float(v)) for i, v in enumerate(x)]
    kept = [("s", i, v) for i, (_, _, v) in enumerate(r for r in rows if r[2] is not None)]
    schema = "series_id string, seq long, nav double"
    got, want = (resampling.block_lengths(spark.createDataFrame(r, schema)).first() for r in (rows, kept))
    assert (got.n, got.block_length) == (want.n, want.block_length) == (len(kept), want.block_length) and got.circular == pytest.approx(want.circular, rel=1e-9)
