"""Shards by jump consistent hashing (Lamping and Veach, 2014), with gapless slots in each shard.

A row's shard depends on its key and the number of shards alone, without a ring or a table, so
shards can be computed in any task and after any loss of executors. Appending a shard moves only
the rows that the new shard takes: one part in n + 1.

Defined results: a null key hashes as the text ``null``; equal keys share a shard; rows that repeat
each get a slot; null text has size ``OVERHEAD`` and CRC 0; an empty table gives an empty result.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import free_names

#: Bytes that a row takes besides its text.
OVERHEAD = 8
#: Rows that one numbering task gets at most, about; the number of tasks follows the input.
ROWS_PER_CELL = 200_000

# Fixed values of the jump hash: the 64-bit LCG multiplier and the scale 2**31.
_LCG = np.uint64(2862933555777941757)
_SCALE = float(1 << 31)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard numbers of 64-bit keys, all rows at once; a row leaves the loop when it would jump past the end."""
    state = keys.astype(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    reach = np.zeros(len(state), np.int64)
    while len(live):
        shard[live] = reach
        state[live] = state[live] * _LCG + np.uint64(1)
        reach = ((reach + 1) * (_SCALE / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        going = reach < shards
        live, reach = live[going], reach[going]
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of each key as an int column; ``key`` may be of any type that casts to string."""
    if shards < 1:
        raise ValueError("there must be at least one shard")

    @F.pandas_udf("int")
    def assign(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashed.to_numpy(np.int64).view(np.uint64), shards)).astype(np.int32)

    return assign(F.xxhash64(F.coalesce(key.cast("string"), F.lit("null"))))


def shard_rows(df: DataFrame, key_col: str, text_col: str, shards: int) -> DataFrame:
    """``df``'s keys with size, CRC, shard, slot and the shard if one more were appended.

    Slots are numbered in two steps, so that no task holds a whole shard: rows are ranked within
    (shard, cell), cells being hash ranges of the key, and each cell is shifted by the rows of the
    cells before it. The table of cell counts has shards x cells rows and is joined as such.
    """
    cell, before = free_names(df, "cell", "before")
    rows = df.select(
        F.col(key_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        jump_shard(F.col(key_col), shards).alias("shard"),
        jump_shard(F.col(key_col), shards + 1).alias("grown_shard"),
    )
    cells = max(1, -(-df.count() // (ROWS_PER_CELL * shards)) * 4)
    rows = rows.withColumn(cell, F.pmod(F.xxhash64(F.lit("slot"), F.col(key_col)), F.lit(cells)).cast("int"))
    order = Window.partitionBy("shard", cell).orderBy(F.col(key_col).asc_nulls_first(), "text_crc32", "size")
    ranked = rows.withColumn("slot", F.row_number().over(order).cast("long") - 1)
    counts = rows.groupBy("shard", cell).agg(F.count(F.lit(1)).alias(before))
    running = Window.partitionBy("shard").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn(before, F.coalesce(F.sum(before).over(running), F.lit(0)))
    return ranked.join(shifts, ["shard", cell]).select(
        key_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") + F.col(before)).alias("slot"), "grown_shard"
    )
