"""What the training-data operators share: the shared folder, staged tables, let-bindings."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: A key that more than one in so many rows of a join have is dealt over several tasks.
HEAVY = 1000


#: Bytes of an Arrow batch between Spark and a Python worker, where the session names no bound of its own.
ARROW_BYTES = 4 << 20
#: What Python workers remember between tasks; forget() empties it.
MEMORIES: list[Callable[[], None]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the Python workers, once for each application, and bounds Arrow batches.

    Workers then import it wherever they start; nothing need be installed on the executors.
    Rows hold whole texts, so batches are bounded in bytes: the number of rows alone bounds no memory.
    """
    context = spark.sparkContext
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(ARROW_BYTES))
    if getattr(context, "_tallyforge_sent", None) == context.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.join(root, "tallyforge")
    if os.path.isdir(package):
        path = os.path.join(tempfile.mkdtemp(prefix="tallyforge-code-"), "tallyforge_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        context.addPyFile(path)
    context._tallyforge_sent = context.applicationId


def forget() -> None:
    """Gives a Python worker's memory back before a stage of another kind: workers are reused, and idle memories add up."""
    for empty in MEMORIES:
        empty()
    gc.collect()
    trim()


def trim() -> None:
    """Gives what a Python worker no longer uses back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where none is named, a temporary folder is set once, but on a single machine only: executors
    elsewhere would write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    This cuts lineage: what follows reads committed files, survives a lost executor and
    sees one fixed set of rows.
    """
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    _made.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


_made: list[str] = []


def mark() -> int:
    """A point in time for clear()."""
    return len(_made)


def clear(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Deletes the tables staged after mark() but those of kept, once nothing else will read them."""
    names = {df._staged_path for df in kept}
    left = []
    for path in _made[since:]:
        if path in names:
            left.append(path)
        else:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _made[since:] = left


def dealt(left: DataFrame, right: DataFrame, key: str, weight: str, by: Column) -> DataFrame:
    """left joined (left outer) with right by key; right has one row for each key, and about weight rows of left have it.

    Keys of more than one in HEAVY of all rows are at most HEAVY by count, so their list may be
    broadcast; it deals their rows of left, by a hash of by, over as many tasks as they need, and
    copies their row of right to each. A null key meets nothing and is dealt like others.
    """
    total = right.agg(F.sum(weight)).first()[0] or 1
    copies = F.ceil(F.col(weight) * HEAVY / F.lit(total)).cast("int")
    heavy = right.filter(F.col(weight) * HEAVY > total).select(key, copies.alias("_parts"))
    parts = F.when(F.col(key).isNull(), HEAVY).otherwise(F.coalesce("_parts", F.lit(1)))
    spread = left.join(F.broadcast(heavy), key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    copied = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1))).drop(weight)
    return spread.join(copied.hint("merge"), [key, "_part"], "left").drop("_part")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element array's transform binds it.

    Without this the optimiser inlines an expression into each of its uses.
    """
    return F.transform(F.array(value), body)[0]


def lower_ascii(c: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
