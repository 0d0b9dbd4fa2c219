"""Helpers that the operators share: the shared folder, written tables, size-checked broadcasts, text normalisation."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts name it: space and code points 9 to 13.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: An Arrow batch for a Python worker ends after so many bytes, where the session doesn't say less.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.  Where that is unset, local mode
    gets a folder of its own, as in tests; on a cluster it is an error, as executors would write to their own disks."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="sluiceway-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_scratch: dict[str, tuple] = {}  # folder: the JVM and its Hadoop configuration, which outlive the session


def scratch(spark: SparkSession) -> str:
    """This application's folder for tables between steps.  It goes when the driver's Python ends, or by clear()."""
    at = f"{shared_dir(spark)}/sluiceway/{spark.sparkContext.applicationId}"
    if at not in _scratch:
        _scratch[at] = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        if len(_scratch) == 1:
            atexit.register(clear)
    return at


def _remove(jvm, conf, at: str) -> None:
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(conf).delete(path, True)


def clear() -> None:
    """Remove all tables between steps; results that were not read to their end can't be read any more."""
    for at, (jvm, conf) in list(_scratch.items()):
        try:
            _remove(jvm, conf, at)
        except Exception:  # noqa: BLE001  the JVM may be gone; what is left lies in the folder for checkpoints
            pass
        del _scratch[at]


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library even when the session was started from another folder, and give them rows in
    batches of few bytes (or one row), so that what a task holds doesn't follow the lengths of texts."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF, "1g")) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, so a lost executor costs
    only the tasks that it ran, and a second use doesn't compute it again.  Tables of whole texts may take zstd."""
    at = f"{scratch(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of materialize() that nothing will read again."""
    for t in tables:
        _remove(*_scratch[os.path.dirname(t.written_at)], t.written_at)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df (a written table of narrow rows) with a broadcast hint if it has at most so many rows, else df as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def give_back() -> None:
    """Hand memory that a Python worker no longer needs back to the system; workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(f):
    """f, a function for mapInArrow, so that its task gives its memory back at the end."""

    def run(batches):
        yield from f(batches)
        give_back()

    return run


def keep_rows(docs: DataFrame, found: DataFrame, print_: Column, most: int) -> DataFrame:
    """The rows of docs that stay, with all their columns.  found has a row for each row of docs: doc_id, print (the value of
    print_, binary), kept, and once (of equal rows that stay only one does).  Lists of up to so many rows are broadcast."""
    state = found.groupBy("doc_id", "print").agg(F.max("kept").alias("stays"), F.max("once").alias("once"), F.count(F.lit(1)).alias("copies"))
    # few beside the rows that simply stay; names that no column of docs has
    odd = state.filter("not stays or once and copies > 1").select(F.col("doc_id").alias("\x01id"), F.col("print").alias("\x01print"), "stays")
    odd = materialize(odd, "odd-rows")
    dropped, repeated = (odd.filter(c).select("\x01id", "\x01print") for c in ("not stays", "stays"))
    same = F.col("doc_id").eqNullSafe(F.col("\x01id")) & (print_ == F.col("\x01print"))
    out = docs.join(small(dropped, most), same, "left_anti")
    if repeated.isEmpty():
        return out
    twice = small(repeated, most)
    one = out.join(twice, same, "left_semi").withColumn("\x01key", print_).dropDuplicates(["doc_id", "\x01key"]).drop("\x01key")
    return out.join(twice, same, "left_anti").unionByName(one)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.  lower() is the quick way for texts that are all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
