"""Tables that appear at their path whole or not at all.

A table is written to a fresh folder beside its path and moved there once Spark has set its commit
mark. Readers count a folder as ready only with the mark.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MARK = "_SUCCESS"


class _Store:
    """The file system of a path, as Hadoop gives it."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self.files = self.path(path).getFileSystem(conf)
        home = self.files.makeQualified(self.path(path)).toUri()
        self.context = self.hadoop.FileContext.getFileContext(home, conf)
        self.no_options = spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)

    def path(self, path: str):
        return self.hadoop.Path(path)

    def exists(self, path: str) -> bool:
        return self.files.exists(self.path(path))

    def is_folder(self, path: str) -> bool:
        return self.exists(path) and self.files.getFileStatus(self.path(path)).isDirectory()

    def move(self, source: str, target: str) -> bool:
        """Move a folder; False if there is something at the target already, or nothing at the source."""
        source, target = (self.files.makeQualified(self.path(p)) for p in (source, target))
        try:
            self.context.rename(source, target, self.no_options)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() in ("FileAlreadyExistsException", "FileNotFoundException"):
                return False
            raise
        return True

    def remove(self, path: str) -> None:
        self.files.delete(self.path(path), True)


def is_ready(spark: SparkSession, path: str) -> bool:
    """Whether a table is complete: a file, or a folder with the commit mark."""
    store = _Store(spark, path)
    if not store.exists(path):
        return False
    return not store.is_folder(path) or store.exists(f"{path.rstrip('/')}/{MARK}")


def publish(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), replace: bool = False
) -> bool:
    """Write a parquet table that appears at ``path`` once it is complete; whether it is this one.

    Of several writers at once one wins and the others drop what they wrote, so a reader never sees parts of two. With
    ``replace`` a complete table gives way to the new one. A folder without the mark is moved
    aside, to a name with ``.incomplete-``, not deleted.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    store = _Store(spark, path)
    own = f"{path}.making-{uuid.uuid4().hex}"
    writer = df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(own)
    while not store.move(own, path):
        if not is_ready(spark, path):
            store.move(path, f"{path}.incomplete-{uuid.uuid4().hex}")
        elif replace:
            old = f"{path}.old-{uuid.uuid4().hex}"
            if store.move(path, old):
                store.remove(old)
        else:
            store.remove(own)
            return False
    return True
