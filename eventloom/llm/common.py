"""What the operators of this subpackage share: reading, cutting lineage, names of rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark setting under which an action's shuffle files go as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which driver and executors share.

    Where none is set, a folder of its own is made if driver and executors are
    one process, as in tests; on a cluster that is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="eventloom-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted at the end of the driver unless ``remove`` is called before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_drop_all)
    _WRITTEN[path] = spark
    return path


def scan_tasks(table: DataFrame) -> int:
    """Tasks that a scan of a written table takes: in proportion to its size, whatever the number of shuffle partitions."""
    return max(1, table.rdd.getNumPartitions())


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; lost executors cannot take it away. Shuffle files that led to it go at once.

    The table stays until ``drop`` or the end of the driver.
    """
    spark = df.sparkSession
    path = own_folder(spark, "eventloom")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def cut_lean(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """``cut`` with fewer child processes.

    Without Hadoop's native library every file of a local folder, and the file of
    its checksums, costs its executor a child process (chmod), which counts with
    all of the executor's memory until it has started. So checksums are left out
    (of local folders only; others have no such file), and ``tasks`` bounds the
    files of tables whose partitions are even: results of partially aggregated
    groupBys and joins by row.
    """
    return cut(df if tasks is None else df.coalesce(tasks), **{"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"})


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing will read again."""
    for t in tables:
        remove(t.sparkSession, t.table_path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    _WRITTEN.pop(path, None)


_WRITTEN: dict[str, SparkSession] = {}


def _drop_all() -> None:
    for path, spark in list(_WRITTEN.items()):
        with suppress(Exception):  # the session may have ended
            remove(spark, path)


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that none of them can clash with those an operator makes."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def columns_of(df: DataFrame, row: str = "row", **replaced: Column) -> list[Column]:
    """The columns of ``df`` back from the struct, those named in ``replaced`` by other values."""
    return [replaced[c].alias(c) if c in replaced else F.col(f"{row}.`{c}`").alias(c) for c in df.columns]


def where_held(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on costly columns without pushing their definitions below the projections that hold them."""
    held = df.withColumn("held_row", F.monotonically_increasing_id())
    return held.where(condition & (F.col("held_row") >= 0)).drop("held_row")
