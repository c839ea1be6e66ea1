"""The driver's tables as traces, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt to all cores: tables of few bytes come in few partitions, however much is made of each row."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as events of a trace: clicks, views and errors are I/O, the rest is computing."""
    e = table(spark, sf_dir, "events")
    io = F.col("event_type").isin("click", "view", "error")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    dur = F.round(F.col("value") * 1e7).cast("bigint")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.when(io, "POSIX").otherwise("COMPUTE").alias("cat"), F.when(io, 3).otherwise(6).cast("smallint").alias("type"),
        F.lit(1).cast("smallint").alias("ph"), (F.col("user_id") % 8).alias("pid"), F.col("user_id").alias("tid"), ts.alias("ts"), dur.alias("dur"), (ts + dur).alias("te"),
        F.get_json_object("props", "$.k").cast("bigint").alias("size"),
    )


#: The same as a common table expression of DuckDB.
TRACE = """
e AS (
  SELECT event_id AS id, event_type AS name, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'POSIX' ELSE 'COMPUTE' END AS cat,
    CAST(CASE WHEN event_type IN ('click', 'view', 'error') THEN 3 ELSE 6 END AS SMALLINT) AS type, CAST(1 AS SMALLINT) AS ph,
    user_id % 8 AS pid, user_id AS tid, epoch_us(ts) AS ts, CAST(round(value * 1e7) AS BIGINT) AS dur,
    epoch_us(ts) + CAST(round(value * 1e7) AS BIGINT) AS te, CAST(props->>'$.k' AS BIGINT) AS size
  FROM events
)"""


def sql(body: str, more: str = "") -> str:
    return f"WITH {TRACE}{', ' + more if more else ''} {body}"
