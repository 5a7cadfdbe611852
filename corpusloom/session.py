"""Session helpers: a local session for tests, and the folder that survives executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # text work is CPU-bound, so scan splits are smaller than the default 128 MB
        .config("spark.sql.files.maxPartitionBytes", "32m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in a local session that names none."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder, so that later stages start from files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path, for steps whose predecessor can go."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table that :func:`written` made."""
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def move_files(spark: SparkSession, source: str, target: str, prefix: str) -> None:
    """Move a table's files to the folder ``target``, their names after ``prefix``; those that are gone have been moved."""
    fs, folder = _file_system(spark, source)
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            _, path = _file_system(spark, f"{target}/{prefix}{name}")
            if not fs.rename(status.getPath(), path):
                raise OSError(f"{status.getPath()} could not be moved to {path}")


def drop_mark(spark: SparkSession, path: str) -> None:
    """Remove the success mark of an output that is about to be replaced."""
    fs, target = _file_system(spark, f"{path}/_SUCCESS")
    fs.delete(target, False)
