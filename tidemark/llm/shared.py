"""Places and cuts that the operators share: the cluster's shared folder and tables written there."""

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of keys that are broadcast at most, with ``_ROW`` bytes for a row of keys; beyond it joins are shuffled.
BROADCAST_BYTES, _ROW = 16 << 20, 48
#: Bytes of a row group of tables written between steps: each writing task holds one, of whole texts, on the heap.
_ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, as in single-machine
    tests, it is a folder of the warehouse, which is shared as well, and is set as the checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again, which cuts its lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("parquet.block.size", _ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written to the shared folder that go when the work on them is done: ``with Scratch(spark) as keep``.

    What leaves the block must not read them any more, as a lazy frame would when it is computed.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, shared_dir(spark, "scratch")

    def __enter__(self) -> "Scratch":
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written and read again."""
        path = f"{self.base}/{name}-{uuid.uuid4().hex}"
        df.write.option("parquet.block.size", _ROW_GROUP).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *error) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; its files go when the frame is no longer used."""
    shared_dir(df.sparkSession, "checkpoint")
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Hold Arrow batches to so many rows and bytes in this session; texts are large, and a batch is held twice."""
    now = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    if int(now) <= 0 or int(now) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Return freed memory of this Python worker to the system; workers stay for later stages and count there."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Each wanted helper column name, with underscores appended until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small(keys: DataFrame) -> DataFrame:
    """A written table of keys of bounded size, to be broadcast if it is within ``BROADCAST_BYTES`` by a count; the side
    that a shuffled join makes a hash table of otherwise, so that the other side, which may hold texts, isn't sorted."""
    return F.broadcast(keys) if keys.count() * _ROW <= BROADCAST_BYTES else keys.hint("shuffle_hash")


def keep_rows(df: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with one row of each class, given (id, place, root) of its rows, place being the hash of the text.

    The row with the smallest (id, place) stays; rows with a null id stay. Texts aren't shuffled while the list of
    what goes is small: rows are kept or dropped by a join with it. Of rows equal in id and text one stays.
    """
    id_, place, again = free_names(df, "id", "place", "again")
    rows = classes.filter("id is not null").groupBy("id", "place", "root").agg(F.count(F.lit(1)).alias("n"))
    least = rows.groupBy("root").agg(F.min(F.struct("id", "place")).alias("least"))
    marked = rows.join(least, "root").select(F.col("id").alias(id_), F.col("place").alias(place), (F.struct("id", "place") == F.col("least")).alias("stays"), "n")
    decided = materialise(marked.filter("not stays or n > 1"), "not-whole")
    gone = decided.select(id_, place, (F.col("stays")).alias(again))
    keyed = df.withColumn(place, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    on = (keyed[id_col] == gone[id_]) & (keyed[place] == gone[place])
    kept = keyed.join(small(gone), on, "left_anti").select(*df.columns)
    twice = gone.filter(again)
    if twice.isEmpty():
        return kept
    on = (keyed[id_col] == twice[id_]) & (keyed[place] == twice[place])
    return kept.unionByName(keyed.join(twice, on, "left_semi").dropDuplicates([id_col, place]).select(*df.columns))
