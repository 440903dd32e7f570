"""What the training-data operators share: reading tables, durable intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of (up to two) longs that may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000
#: A key of more than 1 / HEAVY of all rows is hot.
HEAVY = 1000

#: Rows, and bytes, of an Arrow batch that a task works on at a time.
SLICE_ROWS = 512
SLICE_BYTES = 1 << 20

#: Bytes of the Arrow batches that Spark hands to Python under small_batches(), and the setting that says so.
BATCH_BYTES = 4 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Longer keys are solved each time they come: a text without spaces is one key, as long as the text.
LONGEST_KEY = 64


class Memo(dict):
    """Answers of solve() for the keys seen of late, in a bounded number of bounded size: once `limit` are known they
    become the old ones, of which those asked for again move back, and the rest go when the new ones are full. Keys
    above LONGEST_KEY are not kept."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit, self.old = limit, {}

    def solve(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        if len(key) > LONGEST_KEY:
            return self.solve(key)
        out = self.old.get(key)
        return self.keep(key, self.solve(key) if out is None else out)

    def keep(self, key, out):
        if len(key) <= LONGEST_KEY:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


@contextmanager
def small_batches(spark: SparkSession):
    """What is run inside hands Python batches of BATCH_BYTES, unless the session has a bound of its own: rows alone bound
    no memory where texts or sets are long, as a task's batch is held by the executor and by its Python worker."""
    own = spark.conf.get(BATCH, None)
    if own is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(BATCH)


def sliced(batches, rows: int = SLICE_ROWS):
    """The same rows in smaller Arrow batches, without copying."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sliced_by_bytes(batches, column: int, most: int = SLICE_BYTES):
    """The same rows in Arrow batches whose texts in a column have about so many bytes, without copying; a longer text is
    a batch of its own."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or what SparkContext.setCheckpointDir() was given. Where
    neither is set, a session whose driver is its only executor gets a temporary one; on a cluster that is an error, as
    no machine sees another's."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and survives the loss of any executor. The table goes
    when the driver ends, as lazy results may read it until then; see forget()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by stored() that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        if folder.getName().startswith("tidemark-"):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if df, counted now, has few rows; df must be cheap to count (a stored table)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_skewed(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join rows (cheap to read twice) to a stored table of one row per key, no key being a task of its own however many
    rows have it: a table of up to `limit` rows is broadcast; of a larger one, only the keys of more than 1 / HEAVY of the
    rows are, of which there are fewer than HEAVY, and the others shuffle."""
    if limit and table.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(table), key, how)
    counts = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")))
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    heavy = F.broadcast(counts.where((F.col("_rows") * HEAVY > F.lit(total)) & F.col(key).isNotNull()).select(key))
    hot = rows.join(heavy, key, "left_semi").join(F.broadcast(table.join(heavy, key, "left_semi")), key, how)
    return hot.union(rows.join(heavy, key, "left_anti").join(table, key, how))


def word_count(text) -> F.Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
