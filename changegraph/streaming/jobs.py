"""Incremental jobs: facts of new content only, and the latest review marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def incremental_facts(
    files: DataFrame, facts_path: str, extract: Callable[[DataFrame], DataFrame], checkpoint: str
) -> StreamingQuery:
    """Runs ``extract`` on each (blob, lang) of a stream of files once, appending to a fact table.

    A batch that is repeated after a failure finds its own rows already known."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(["blob", "lang"])
        if _exists(spark, facts_path):
            fresh = fresh.join(spark.read.parquet(facts_path).select("blob", "lang"), ["blob", "lang"], "left_anti")
        extract(fresh).write.mode("append").parquet(facts_path)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reviewed_state(marks: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last flag of each (review_id, content_hash) of a stream of (review_id, content_hash, flag, ts).

    Each batch writes a version of its own; readers take the newest (``latest_state``)."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rows = df.select("review_id", "content_hash", "flag", "ts")
        old = latest_state(spark, state_path, number)
        if old is not None:
            rows = rows.unionByName(old)
        last = rows.groupBy("review_id", "content_hash").agg(F.max_by("flag", F.struct("ts", "flag")).alias("flag"), F.max("ts").alias("ts"))
        last.write.mode("overwrite").parquet(f"{state_path}/version={number:09d}")

    return marks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(spark: SparkSession, state_path: str, before: int | None = None) -> DataFrame | None:
    """The newest version, or the newest before a batch number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("version="))
    names = [n for n in names if before is None or int(n.split("=")[1]) < before]
    return spark.read.parquet(f"{state_path}/{names[-1]}") if names else None


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
