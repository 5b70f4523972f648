"""Outbound comments: what a review would send, and a sink that sends each comment once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from changegraph.functions.text import content_id, location

SENT = "review_id string, draft_id string, key string, remote_id string"


def plan_comments(drafts: DataFrame, placements: DataFrame, capabilities: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads, skipped) of drafts as they stand in the diff.

    drafts: (review_id, draft_id, body, remote_id, reply_to, author, general), ``reply_to`` being a discussion and ``general`` whether that
    is no thread; placements: (review_id, draft_id, status, path, first, last, old_side) with status line, file or stale;
    capabilities: (review_id, forge, drafts, file_comments, commit); summaries: (review_id, body, remote_id).

    Replies go to their discussion, on a forge that cannot thread a general one with the author's name before the text. Stale
    drafts are skipped with a reason. A comment on a file becomes a general one that names the file
    where the forge has none. A summary that is not blank comes last. Remote ids only count where the forge
    keeps drafts. ``key`` identifies the content, so an edited draft is another comment."""
    rows = drafts.join(capabilities, "review_id").join(placements, ["review_id", "draft_id"], "left")
    reply = F.col("reply_to").isNotNull()
    stale = ~reply & (F.coalesce("status", F.lit("stale")) == "stale")
    skipped = rows.where(stale).select("review_id", "draft_id", F.lit("its line is no longer in the diff").alias("reason"))
    kept = rows.where(~stale)
    whole = ~reply & (F.col("status") == "file")
    body = (
        F.when(reply & (F.col("forge") == "github") & F.coalesce("general", F.lit(False)), F.concat(F.lit("@"), "author", F.lit(" "), "body"))
        .when(whole & ~F.col("file_comments"), F.concat(F.lit("**`"), "path", F.lit("`**\n\n"), "body")).otherwise(F.col("body"))
    )
    line = F.struct("path", "first", "last", "old_side", "commit")
    file = F.struct("path", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("boolean").alias("old_side"), "commit")
    position = F.when(reply, None).when(whole, F.when(F.col("file_comments"), F.to_json(file))).otherwise(F.to_json(line))
    what = F.when(reply, F.concat(F.lit("reply to @"), "author")).when(whole, F.col("path")).otherwise(location(F.col("path"), F.col("first"), F.col("last"), F.col("old_side")))
    one = kept.select("review_id", F.col("draft_id").cast("string").alias("draft_id"), what.alias("what"), body.alias("body"), position.alias("position"), F.col("reply_to").alias("in_reply_to"), F.when(F.col("drafts"), F.col("remote_id")).alias("remote_id"), F.when(F.col("drafts"), "drafts").otherwise("direct").alias("mode"))
    text = F.rtrim(F.col("body"), F.lit(" \t\r\n"))
    last = summaries.join(capabilities, "review_id").where(F.trim(F.col("body"), F.lit(" \t\r\n")) != "").select(
        "review_id", F.lit("summary").alias("draft_id"), F.lit("summary").alias("what"), text.alias("body"), F.lit(None).cast("string").alias("position"), F.lit(None).cast("string").alias("in_reply_to"),
        F.when(F.col("drafts"), F.col("remote_id")).alias("remote_id"), F.when(F.col("drafts"), "drafts").otherwise("direct").alias("mode"),
    )
    payloads = one.unionByName(last)
    return payloads.withColumn("key", content_id("draft_id", F.coalesce("body", F.lit("")), F.coalesce("position", F.lit("")), F.coalesce("in_reply_to", F.lit("")))), skipped


def sent_comments(spark: SparkSession, path: str) -> DataFrame:
    """(review_id, draft_id, key, remote_id) of everything that was sent."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    return spark.read.schema(SENT).parquet(path) if exists else spark.createDataFrame([], SENT)


def outbox(payloads: DataFrame, path: str, send: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Sends a stream of payloads once each: ``send`` gets the new ones and returns (review_id, draft_id, key, remote_id).

    What was sent is appended to ``path`` and left out of every batch (by review, draft and content), so a batch that is
    repeated after it wrote, or a payload that comes again, sends nothing; an edited draft is sent again, with the remote id that
    it has. ``send`` itself should pass ``key`` on as the forge's idempotency key, since a failure can
    strike between sending and writing."""

    def batch(df: DataFrame, _: int) -> None:
        known = sent_comments(df.sparkSession, path)
        fresh = df.dropDuplicates(["review_id", "draft_id", "key"]).join(known.select("review_id", "draft_id", "key").distinct(), ["review_id", "draft_id", "key"], "left_anti")
        remote = known.groupBy("review_id", "draft_id").agg(F.max("remote_id").alias("_remote"))
        fresh = fresh.join(remote, ["review_id", "draft_id"], "left").withColumn("remote_id", F.coalesce("remote_id", F.when(F.col("mode") == "drafts", F.col("_remote")))).drop("_remote")
        send(fresh).select("review_id", "draft_id", "key", "remote_id").write.mode("append").parquet(path)

    return payloads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
