"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "strandframe", cpus: str | int = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one where that is unset and the
    master is local, so that there is one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = os.environ.setdefault("STRANDFRAME_SHARED", tempfile.mkdtemp(prefix="strandframe-"))
        spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
        folder = f"file://{folder}"
    return folder


def path_and_fs(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path, whatever store it is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = path_and_fs(spark, path)
    return fs.exists(target)


def files(spark: SparkSession, path: str) -> list[str]:
    """The data files that a path, a folder or a pattern names; hidden ones and markers are none."""
    target, fs = path_and_fs(spark, path)
    out = []
    for status in fs.globStatus(target) or []:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [f.getPath().toString() for f in inside if not f.isDirectory() and f.getPath().getName()[0] not in "._"]
    return out


def first_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """The first n bytes of a file; nothing more of it is read."""
    target, fs = path_and_fs(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file, under another name until it is whole."""
    target, fs = path_and_fs(spark, path)
    part = target.suffix(".part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be written")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that the JVM removes when it ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    target, fs = path_and_fs(spark, path)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of at most so many bytes, unless the session has set a limit of its own: at the default of 64 MB two
    tasks' batches of long texts take hundreds of MB off an executor's heap, and again in its Python workers."""
    if spark.conf.get(ARROW_BYTES, "67108864b") in ("67108864b", "64m", "64MB"):
        spark.conf.set(ARROW_BYTES, str(most))


def few_files(df: DataFrame, small: bool = False) -> DataFrame:
    """df in at most two partitions a core, or a sixteenth of the shuffle partitions that the data were given, whichever is
    more, without a shuffle: a task takes several of them one after the other, each with its own memory. Tables of many
    small files cost the executor three processes a file where the folder is a plain disk, and their readers a task each.
    small: one partition a core, for tables of a part of the rows, or of a number a row."""
    spark = df.sparkSession
    cores, given = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(cores, -(-given // 64)) if small else max(2 * cores, -(-given // 16)))


def stored(df: DataFrame, tag: str, small: bool = False) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read back, so that a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, tag) + "/data"
    few_files(df, small).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def held(df: DataFrame) -> DataFrame:
    """df, computed once and kept on the executors' disks until released; what is lost with an executor is made again."""
    return df.persist(StorageLevel.DISK_ONLY)


def released(*tables: DataFrame) -> None:
    for table in tables:
        table.unpersist()


def dropped(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for table in tables:
        target, fs = path_and_fs(table.sparkSession, table.stored_at)
        fs.delete(target, True)
