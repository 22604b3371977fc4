"""Landing documents: a file for each key, all in one folder.

Spark's writer makes a folder for each key, and on a local file system without Hadoop's
native library it starts a process for each folder, file and checksum it makes. So the tasks
write the files themselves, through Arrow's file systems (local, HDFS, S3, GCS). A file gets
its name when it is whole: a task that is repeated leaves the same files.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable
from functools import partial
from itertools import groupby
from operator import itemgetter

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The functions travel inside the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def arrow_files(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path, and the path there."""
    if "://" in path or path.startswith("file:"):
        bare = path.startswith("file:/") and not path.startswith("file://")
        return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if bare else path)
    return fs.LocalFileSystem(), path


def land_documents(documents: DataFrame, path: str) -> None:
    """Write (integer key, text) as files `<key>.json`.

    Texts of one key are lines of one file, so its rows must be in one partition.
    """
    spark = documents.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    whole = files.makeQualified(folder).toString()
    documents.sortWithinPartitions(documents.columns[0]).foreachPartition(partial(_write, whole))


def document_key() -> Column:
    """The key of the file that a row was read from; null for the file of rows without one."""
    return F.regexp_substr(F.col("_metadata.file_name"), F.lit(r"^-?\d+")).cast("bigint")


def _write(path: str, rows: Iterable[tuple]) -> None:
    files, base = arrow_files(path)
    for key, same in groupby(rows, itemgetter(0)):
        part = f"{base}/.{key}-{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            for _, text in same:
                out.write(f"{'' if text is None else text}\n".encode())
        files.move(part, f"{base}/{key}.json")
