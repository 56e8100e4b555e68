"""Helpers shared by the corpus operators: scratch tables, Arrow byte access, gapless numbering."""

from __future__ import annotations

import contextlib
import math
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import ship

#: ASCII white space, the separators of "words" in most contracts: \x20 and \x09-\x0D.
WHITE = b" \t\n\x0b\x0c\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where that is unset and the driver does all the work (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quadrille-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Drop the shuffle files of each finished query at once, not when the driver collects garbage."""
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, old)


#: Scratch paths of the open temporary() blocks, innermost last; of this thread's, as each query runs in one.
_held = threading.local()


def _open() -> list[list[str]]:
    if not hasattr(_held, "levels"):
        _held.levels = []
    return _held.levels


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Deletes at its end the scratch tables written inside, but for those marked `keep`, which the next outer one takes over."""
    _open().append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _open().pop():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def scratch_table(spark: SparkSession, name: str, keep: bool) -> str:
    path = scratch_path(spark, name)
    level = len(_open()) - (2 if keep else 1)
    if level >= 0:
        _open()[level].append(path)
    return path


def materialize(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage, survives lost executors.  keep: see temporary()."""
    spark = df.sparkSession
    path = scratch_table(spark, name, keep)
    with shuffle_cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt_table(df: DataFrame, name: str, key: str, files: int, *, keep: bool = False) -> DataFrame:
    """Like materialize(), but with the rows of each key in one of `files` buckets, so that grouping by the key moves no row again."""
    spark = df.sparkSession
    path, own = scratch_table(spark, name, keep), f"scratch_{uuid.uuid4().hex}"
    with shuffle_cleanup(spark):
        df.repartition(files, key).write.format("parquet").bucketBy(files, key).option("path", path).saveAsTable(own)
    out = spark.table(own)
    out.schema  # resolved, so that the name isn't needed any more
    spark.sql(f"DROP TABLE {own}")
    return out


def bound_batches(spark: SparkSession, records: int = 2_000, bytes_: int = 8 << 20) -> None:
    """Small Arrow batches for this session, as texts are long and executor and Python worker each hold a batch; ships the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", bytes_)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application (call once its results have been written)."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one uint8 array, and its n+1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_batches(batches, text: int, most: int = 2 << 20):
    """Cuts record batches so that the text column of each holds about `most` bytes: work arrays stay small beside a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = arrow_bytes(b.column(text))
        off = off.copy()
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield b.slice(at, end - at)
            at = end


def each_bytes(col):
    """The UTF-8 bytes of each row of a string column, null as empty."""
    raw, off = arrow_bytes(col)
    whole = raw.tobytes()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield whole[a:b]


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def numbered_rows(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """df as a scratch table with a column _row that no two rows share, which gapless() deals rows by."""
    return materialize(df.withColumn("_row", F.monotonically_increasing_id()), name, keep=keep)


def gapless(df: DataFrame, group: str, order: list[str], sizes: dict, out: str, rows_per_bucket: int = 500, most: int = 1 << 17) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without sorting a whole group in one task.

    df comes from numbered_rows(); sizes has the rows of each of the (few) groups.  A group is dealt to
    buckets by row, as many as its size asks for, so that rows that are equal in everything spread too;
    buckets are counted, running sums of the counts give each bucket its first number, and a row's number
    is that plus its rank in the bucket by `order`.  A group has at most `most` buckets, whose rows are
    sorted with spilling, so running sums stay small at any size.
    """
    kind = df.schema[group].dataType
    buckets = [x for value, n in sizes.items() for x in (F.lit(value).cast(kind), F.lit(min(most, max(1, math.ceil(n / rows_per_bucket)))))]
    nb = F.element_at(F.create_map(*buckets), F.col(group)) if sizes else F.lit(1)  # names the group once, however long its expression is
    d = df.withColumn("_nb", F.pmod(F.xxhash64("_row"), nb).cast("int"))
    counts = d.groupBy(group, "_nb").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_nb").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(group, "_nb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(group, "_nb").orderBy(*order, "_row"))
    ranked = d.withColumn("_rank", rank)
    return ranked.join(first, [group, "_nb"]).withColumn(out, F.col("_first") + F.col("_rank") - 1).drop("_nb", "_first", "_rank", "_row")
