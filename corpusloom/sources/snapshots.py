"""Groups of tables that are replaced together: folders of data behind one pointer.

A writer puts all tables of a snapshot into a new folder, which nobody reads yet, and then publishes it by a file
``versions/<number>`` that names the folder. The file is written aside and renamed to its number, which fails if the
number is taken, so of two writers that started from one version one wins and the other gets ``Conflict``; and a
reader sees the tables of one version or of another, never some of both. A writer that dies leaves a folder without a
pointer, which is never read. The rename is atomic on HDFS and on local disks; on a store without atomic renames one
writer at a time is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from corpusloom.session import _file_system


class Conflict(RuntimeError):
    """Another writer has published the version this one was about to."""


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _file_system(spark, f"{root}/versions")
    if not fs.exists(folder):
        return []
    names = (status.getPath().getName() for status in fs.listStatus(folder))
    return sorted(int(name) for name in names if name.isdigit())


def current(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, str | None]:
    """The newest version (or the one asked for) and its folder; 0 and None if there is none."""
    known = _versions(spark, root)
    if version is not None and version not in known:
        raise FileNotFoundError(f"no version {version} at {root}")
    number = version or (known[-1] if known else 0)
    if not number:
        return 0, None
    fs, pointer = _file_system(spark, f"{root}/versions/{number:012d}")
    stream = fs.open(pointer)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return number, f"{root}/{name}"


def publish(spark: SparkSession, root: str, write: Callable[[str], None], after: int | None = None) -> int:
    """Have ``write`` fill a new folder and make it the version after ``after`` (the newest, if not given)."""
    number = (current(spark, root)[0] if after is None else after) + 1
    name = f"data-{uuid.uuid4().hex}"
    write(f"{root}/{name}")
    _point(spark, root, number, name)
    return number


def _point(spark: SparkSession, root: str, number: int, name: str) -> None:
    jvm = spark._jvm
    fs, aside = _file_system(spark, f"{root}/versions/.{name}")
    stream = fs.create(aside, True)
    stream.writeBytes(name)
    stream.close()
    _, pointer = _file_system(spark, f"{root}/versions/{number:012d}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    # without options an existing target is an error, where FileSystem.rename would replace or enter it
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(pointer), options)
    except Exception as error:
        fs.delete(aside, False)
        if fs.exists(pointer):
            raise Conflict(f"version {number} of {root} is another writer's") from error
        raise
