"""Connected components of a distributed link table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_WRITTEN: list[str] = []


def shared_checkpoints(spark) -> str:
    """The session's checkpoint folder; where none is set (tests), one under the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return sc.getCheckpointDir()


def table_path(spark, kind: str = "table") -> str:
    """A new path in the shared folder, which drop_tables deletes."""
    _WRITTEN.append(f"{shared_checkpoints(spark)}/{kind}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def drop_tables(spark) -> None:
    """Deletes all intermediate tables written so far; call it when the results that rest on them have been used."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


#: Rows that a task has at least where a table's size is known; more tasks than that would be idle.
TASK_ROWS = 50_000


def tasks(rows: DataFrame, most: int, each: int = TASK_ROWS) -> DataFrame:
    """The rows, at most `most` of them, in as many partitions as `each` rows to one make; never in more than before."""
    return rows.coalesce(max(1, -(-most // each)))


def cut(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The rows as a table in the shared folder, read again: its plan ends there, and its size is known.

    Checkpoints keep the size that was estimated before; in loops of joins these estimates multiply into numbers so long
    that planning stalls. `most`: a bound of the number of rows.
    """
    spark = rows.sparkSession
    path = table_path(spark)
    (rows if most is None else tasks(rows, most)).write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder with a column that tells them apart, and that column's name, which no other has."""
    name = "row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return cut(docs.withColumn(name, F.monotonically_increasing_id())), name


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that can be reached over links (a, b); ids without links don't appear.

    Labels go along the links and then jump to their label's label, so rounds grow with the logarithm of the
    longest path. Labels are written each round: both sides of each join then come straight from an
    exchange, and adaptive execution can split a hub's rows.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")).filter("src <> dst").distinct().transform(cut)
    n = both.count()
    labels = both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("component")).transform(cut, n)
    while True:
        sent = both.join(labels, both.src == labels.id).select(F.col("dst").alias("id"), "component", F.lit(None).cast("bigint").alias("was"))
        known = labels.withColumn("was", F.col("component"))
        low = known.union(sent).groupBy("id").agg(F.min("component").alias("component"), F.max("was").alias("was")).transform(cut, n)
        of = low.select(F.col("id").alias("component"), F.col("component").alias("better"))
        jumped = low.join(of, "component").select("id", F.col("better").alias("component"), "was").transform(cut, n)
        labels = jumped.select("id", "component")
        if not jumped.filter("component <> was").limit(1).count():
            return labels
