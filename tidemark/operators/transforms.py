"""Wavelet scattering of windows of a series.

Windows are cut in Spark: a row is dealt to every window that holds it, windows are groups of a fixed number
of rows, and a small array kernel works on one window. A series of any length is many windows, never one task.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hopping_windows(nav: DataFrame, size: int, stride: int) -> DataFrame:
    """Rows dealt to all windows that hold them: adds ``end``, the window's last position. Partial windows are left out."""
    last = F.max("seq").over(Window.partitionBy("series_id"))
    first = F.greatest(F.ceil((F.col("seq") - (size - 1)) / F.lit(stride)), F.lit(0)).cast("long")
    until = F.least(F.floor(F.col("seq") / stride), F.floor((F.col("last") - (size - 1)) / F.lit(stride))).cast("long")
    placed = nav.withColumn("last", last).withColumns({"w0": first, "w1": until}).filter("w0 <= w1")
    return placed.withColumn("w", F.explode(F.sequence("w0", "w1"))).withColumn("end", F.col("w") * stride + (size - 1)).drop("last", "w0", "w1", "w")


def _morlet(n: int, octaves: int) -> np.ndarray:
    """Frequency responses of one wavelet an octave, and of the low-pass filter last."""
    f = np.fft.fftfreq(n)
    bands = [np.exp(-((f - 0.35 / 2**j) ** 2) / (2 * (0.12 / 2**j) ** 2)) for j in range(octaves)]
    return np.array([*bands, np.exp(-(f**2) / (2 * (0.12 / 2**octaves) ** 2))])


def scattering(x: np.ndarray, octaves: int = 4) -> np.ndarray:
    """Averages of order 0, 1 and 2: the signal, its wavelet moduli, and the moduli of those at coarser scales (Andén and Mallat, 2014)."""
    filters, spectrum = _morlet(len(x), octaves), np.fft.fft(x)
    first = np.abs(np.fft.ifft(spectrum * filters[:-1], axis=1))
    out = [np.real(np.fft.ifft(spectrum * filters[-1])).mean(), *first.mean(1)]
    for j in range(octaves - 1):
        second = np.abs(np.fft.ifft(np.fft.fft(first[j]) * filters[j + 1 : -1], axis=1))
        out += list(second.mean(1))
    return np.array(out)


def scattering_series(nav: DataFrame, size: int = 256, stride: int = 64, octaves: int = 4) -> DataFrame:
    """(series_id, seq, path, value): mean of each scattering path in each window, at the window's last position."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = scattering(pdf.sort_values("seq")["nav"].to_numpy(np.float64), octaves)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "seq": pdf["end"].iloc[0], "path": np.arange(len(values)), "value": values})

    whole = hopping_windows(nav.select("series_id", "seq", "nav").filter("nav is not null"), size, stride)
    full = whole.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("series_id", "end"))).filter(F.col("n") == size)
    return full.groupBy("series_id", "end").applyInPandas(run, "series_id string, seq long, path int, value double")


def scattering_summary(paths: DataFrame) -> DataFrame:
    """Mean, spread and range of each path over a series' windows."""
    return paths.groupBy("series_id", "path").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("max"), F.min("value").alias("min"))
