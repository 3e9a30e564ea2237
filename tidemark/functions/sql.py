"""The scalar functions as SQL functions of a session, so that queries in SQL text can call them.

They are expressions that the optimizer sees through, not UDFs in Python.
"""

from pyspark.sql import SparkSession

# name, parameters, expression
FUNCTIONS = (
    ("relative_epsilon", "x DOUBLE", "greatest(abs(x), 1D) * 2.220446049250313e-14D"),
    ("logistic_sigmoid", "x DOUBLE, centre DOUBLE, slope DOUBLE", "1D / (1D + exp(-(x - centre) * slope))"),
    ("normalize_epochs", "epochs DOUBLE, lookback DOUBLE", "CASE WHEN lookback = 0 THEN 0.5D ELSE 1D / (1D + exp(-(try_divide(epochs, lookback) - 0.5D) * 10D)) END"),
    ("normalize_excess", "v DOUBLE", "tanh(abs(v) * 5D)"),
    ("normalize_cv", "cv DOUBLE", "1D / (1D + exp(-(coalesce(nanvl(cv, 0D), 0D) - 0.5D) * 4D))"),
    ("clamp01", "x DOUBLE", "CASE WHEN x IS NOT NULL THEN least(greatest(x, 0D), 1D) END"),
    ("hurst_soft_clamp", "x DOUBLE", "0.5D + 0.5D * tanh((x - 0.5D) * 4D)"),
)


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for name, parameters, expression in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS DOUBLE RETURN {expression}")
    return [name for name, _, _ in FUNCTIONS]
