"""Shared scratch tables: written intermediate results that survive lost executors.

Every cut in a lineage goes to the folder the cluster names in ``spark.checkpoint.dir``.
Only a local master, as in tests, may fall back to a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows with texts in an Arrow batch, in the JVM's memory and the worker's.
BATCH_ROWS = 1024
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share, from ``spark.checkpoint.dir``."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="vellumine-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session hands Python at most ``BATCH_ROWS`` rows at a time: whole texts stand in them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def staged(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many staged tables there are: a mark for ``clear``."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables staged after the mark ``since`` but the last ``keep``; nothing may read them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    last = len(_written) - keep
    for name in _written[since:last]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del _written[since:last]
