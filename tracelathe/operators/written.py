"""Tables that an operator writes between its steps, in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary = WeakKeyDictionary()
#: Small row groups, so that files of few MB are read by many tasks.
DENSE = {"compression": "zstd", "parquet.block.size": str(16 << 20)}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set (tests), one under the warehouse."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder, which `drop_written` deletes."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _PATHS.setdefault(spark, []).append(path)
    return path


def written(rows: DataFrame, paths: list[str] | None = None, **options: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: computed once, with a known size, and safe if executors are lost.

    paths: where the table's path is noted, for `drop_paths`; options: of the writer.
    """
    path = new_path(rows.sparkSession)
    if paths is not None:
        paths.append(path)
    rows.write.options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def exchanges_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, the files of exchanges go with the end of the step that made them, not when Spark cleans references."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of this session that nothing rests on any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in _PATHS.get(spark, []):
            _PATHS[spark].remove(name)
    paths.clear()


def drop_written(spark: SparkSession) -> None:
    """Deletes what this session's operators and streams have written so far; results that rest on it can't be used any more."""
    drop_paths(spark, list(_PATHS.get(spark, [])))
