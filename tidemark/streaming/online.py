"""Online operators: state for each series in Structured Streaming, and their batch twins.

Batch twins are windows or folds over the long frame and give the same numbers. Streams carry a few
doubles of state a key; event-time aggregation drops what is later than the watermark.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalars as X
from ..operators.bars import BARS, OpenBar
from ..operators.epochs import Fold
from ..series import so_far

LATENESS = "1 hour"


def online_normalized(nav: DataFrame) -> DataFrame:
    """Adds ``z``: each value's sigmoid of its distance from the running mean, itself included; the first has variance 1."""
    mean, var, n = F.avg("nav").over(so_far()), F.var_samp("nav").over(so_far()), F.count("nav").over(so_far())
    spread = F.sqrt(F.when(n <= 1, F.lit(1.0)).otherwise(var))
    return nav.withColumn("z", X.logistic_sigmoid((F.col("nav") - mean) / F.greatest(spread, F.lit(X.EPS)), 0.0, 1.0))


def ema_normalized(values: DataFrame, span: int) -> DataFrame:
    """Adds ``z`` by exponential mean and then variance about the updated mean; the first value gives 0.5.

    The variance starts at the first value's square. The recurrence runs as a streamed fold with two numbers of state a series.
    """
    decay = 1 - 2 / (span + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, mean, var = None, None, 0.0
        for pdf in batches:
            out = []
            for s, x in zip(pdf["series_id"], pdf["nav"], strict=True):
                if mean is None or s != series:
                    series, mean, var = s, x, x * x
                    out.append((mean, var, True))
                else:
                    mean = decay * mean + (1 - decay) * x
                    var = decay * var + (1 - decay) * (x - mean) ** 2
                    out.append((mean, var, False))
            yield pdf[["series_id", "seq", "nav"]].assign(mean=[r[0] for r in out], var=[r[1] for r in out], first=[r[2] for r in out])

    rows = values.select("series_id", "seq", F.col("nav").cast("double").alias("nav")).filter("nav is not null")
    folded = rows.repartition("series_id").sortWithinPartitions("series_id", "seq").mapInPandas(run, "series_id string, seq long, nav double, mean double, var double, first boolean")
    z = X.logistic_sigmoid((F.col("nav") - F.col("mean")) / F.greatest(F.sqrt("var"), F.lit(X.EPS)), 0.0, 1.0)
    return folded.withColumn("z", F.when(F.col("first"), F.lit(0.5)).otherwise(z)).drop("first")


class RunningQuantile:
    """The P-square estimate of a quantile (Jain and Chlamtac, 1985) with five markers.

    ``advance_top`` says whether a new maximum moves the last marker, as published; without it that marker stays.
    """

    def __init__(self, p: float, advance_top: bool = False):
        self.p, self.advance_top = p, advance_top
        self.heights: list[float] = []
        self.places = [1.0, 2.0, 3.0, 4.0, 5.0]
        self.wanted = [1.0, 1 + 2 * p, 1 + 4 * p, 3 + 2 * p, 5.0]
        self.steps = [0.0, p / 2, p, (1 + p) / 2, 1.0]

    def update(self, x: float) -> float:
        h, n = self.heights, self.places
        if len(h) < 5:
            h.append(x)
            h.sort()
            return h[2] if len(h) == 5 else h[min(len(h) - 1, int(self.p * (len(h) - 1) + 0.5))]
        if x >= h[4]:
            h[4] = x
            cell = 3 if self.advance_top else 4
        else:
            h[0] = min(h[0], x)
            cell = max(k for k in range(4) if x >= h[k])
        for k in range(cell + 1, 5):
            n[k] += 1
        for k in range(5):
            self.wanted[k] += self.steps[k]
        for k in (1, 2, 3):
            off = self.wanted[k] - n[k]
            if off >= 1 and n[k + 1] - n[k] > 1 or off <= -1 and n[k - 1] - n[k] < -1:
                d = 1.0 if off > 0 else -1.0
                up, down = (h[k + 1] - h[k]) / (n[k + 1] - n[k]), (h[k] - h[k - 1]) / (n[k] - n[k - 1])
                curved = h[k] + d / (n[k + 1] - n[k - 1]) * ((n[k] - n[k - 1] + d) * up + (n[k + 1] - n[k] - d) * down)
                h[k] = curved if h[k - 1] < curved < h[k + 1] else h[k] + d * (up if d > 0 else down)
                n[k] += d
        return h[2]


def robust_normalized(values: DataFrame) -> DataFrame:
    """Adds ``median``, ``iqr`` and ``z`` from running quartiles; fewer than five values give 0.5."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, marks, seen = None, [], 0
        for pdf in batches:
            rows = []
            for s, x in zip(pdf["series_id"], pdf["nav"], strict=True):
                if s != series or not marks:
                    series, marks, seen = s, [RunningQuantile(p) for p in (0.25, 0.5, 0.75)], 0
                q = [m.update(x) for m in marks]
                seen += 1
                rows.append((q[1], q[2] - q[0], seen))
            yield pdf[["series_id", "seq", "nav"]].assign(median=[r[0] for r in rows], iqr=[r[1] for r in rows], seen=[r[2] for r in rows])

    rows = values.select("series_id", "seq", F.col("nav").cast("double").alias("nav")).filter("nav is not null")
    folded = rows.repartition("series_id").sortWithinPartitions("series_id", "seq").mapInPandas(run, "series_id string, seq long, nav double, median double, iqr double, seen long")
    z = X.logistic_sigmoid((F.col("nav") - F.col("median")) / F.greatest(F.col("iqr") / F.lit(1.35), F.lit(X.EPS)), 0.0, 1.0)
    return folded.withColumn("z", F.when(F.col("seen") < 5, F.lit(0.5)).otherwise(z)).drop("seen")


def stream_epochs(stream: DataFrame, hurdle: float, long: bool = True) -> DataFrame:
    """Gain, loss and epoch flag of each point of a stream (series_id, seq, nav), by keyed state.

    The points of a micro-batch are taken in order of ``seq``; the state is the fold's six numbers.
    """
    fields = "previous double, anchor double, best double, worst double, gain double, loss double"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = None
        if state.exists:
            fold = Fold(0.0, hurdle, long)
            fold.previous, fold.anchor, fold.best, fold.worst, fold.gain, fold.loss = state.get
        pdf = pd.concat(list(frames)).sort_values("seq")
        rows = []
        for x in pdf["nav"]:
            if fold is None:
                fold = Fold(x, hurdle, long)
                rows.append((0.0, 0.0, False))
            else:
                rows.append(fold.step(x))
        state.update((fold.previous, fold.anchor, fold.best, fold.worst, fold.gain, fold.loss))
        out = pd.DataFrame(rows, columns=["excess_gain", "excess_loss", "epoch"])
        yield pd.DataFrame({"series_id": key[0], "seq": pdf["seq"].to_numpy(), "nav": pdf["nav"].to_numpy()}).join(out)

    out = "series_id string, seq long, nav double, excess_gain double, excess_loss double, epoch boolean"
    return stream.groupBy("series_id").applyInPandasWithState(run, out, fields, "append", GroupStateTimeout.NoTimeout)


def stream_range_bars(stream: DataFrame, threshold: float) -> DataFrame:
    """Bars of a stream of trades (series_id, seq, price, quantity) as they close; the open bar is the state."""
    fields = "number long, open double, high double, low double, close double, volume double, start long, last long, trades long"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bar, number, rows = None, 0, []
        if state.exists:
            number, *held = state.get
            bar = OpenBar(0.0, 0, 0.0, 0)
            bar.open, bar.high, bar.low, bar.close, bar.volume, bar.start, bar.last, bar.trades = held
        pdf = pd.concat(list(frames)).sort_values("seq")
        for q, price, volume in zip(pdf["seq"], pdf["price"], pdf["quantity"], strict=True):
            if bar is None:
                bar = OpenBar(price, q, volume, 1)
                continue
            bar.take(price, q, volume)
            if bar.breached(threshold):
                rows.append(bar.row(key[0], number, True))
                bar, number = OpenBar(price, q, 0.0, 0), number + 1
        state.update((number, bar.open, bar.high, bar.low, bar.close, bar.volume, int(bar.start), int(bar.last), bar.trades))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in BARS.split(", ")])

    return stream.groupBy("series_id").applyInPandasWithState(run, BARS, fields, "append", GroupStateTimeout.NoTimeout)


def windowed_events(events: DataFrame, size: str = "5 minutes", slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Event-time windows by type with a watermark; works on a stream and on a table alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", lateness) if events.isStreaming else timed
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    by = timed.groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Sessions of each user, parted by gaps in event time."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", lateness) if events.isStreaming else timed
    by = timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "user_id", "n", "total")
