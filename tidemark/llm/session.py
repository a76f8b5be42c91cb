"""Settings that the operators of this package share."""

from __future__ import annotations

import gc
import os
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows that a Python worker takes at once, at most: of long texts, some megabytes.
BATCH_ROWS = 2000
#: Python workers give large buffers back to the system when they are done with them: workers outlive their tasks.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "4194304"}


def workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it (a path entry, no copy), take batches of bounded size and not keep freed memory."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    if ROOT not in sys.path:
        sys.path.insert(0, ROOT)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names.  Without one, a session of a single machine gets a folder of its own; on a cluster it must be set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    Spark removes the shuffle files of a cut lineage once nothing on the driver refers to it and the JVM has collected its
    garbage, which a driver that does little would put off for half an hour.  Both collectors, Python's for the frames'
    cycles, are asked to work here, so that the disks hold what is still needed.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    del df  # its plan refers to the shuffle files
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return done


def written(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """Cut the lineage with a compressed table in the shared folder, for many narrow rows: a checkpoint's rows are not compressed.

    The table's path is added to ``made``, for :func:`drop_written`; nothing else removes it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if made is not None:
        made.append(path)
    done = spark.read.schema(df.schema).parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return done


def drop_written(spark: SparkSession, made: list[str]) -> None:
    """Delete tables of :func:`written` that nothing will read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while made:
        path = jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(conf).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
