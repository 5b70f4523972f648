"""Discussions and their notes from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTE = "struct<id:bigint,body:string,author:string,created_at:timestamp,system:boolean,resolvable:boolean,resolved:boolean>"
THREAD = f"id string, path string, side string, old_line int, new_line int, outdated boolean, notes array<{NOTE}>"
COMMENT = "id bigint, body string, author string, created_at timestamp, state string"


def read_discussions(threads: DataFrame, comments: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(discussions, notes) of JSON bodies: threads on lines, comments and submitted reviews as general ones, by first note."""
    t = threads.select("review_id", F.from_json("body", THREAD).alias("t")).select("review_id", "t.*")
    placed = ~F.coalesce("outdated", F.lit(False))
    t = t.select(
        "review_id", F.col("id").alias("discussion_id"), "path", F.when(placed & (F.col("side") == "LEFT"), F.col("old_line")).alias("old_line"),
        F.when(placed & (F.coalesce("side", F.lit("RIGHT")) != "LEFT"), F.col("new_line")).alias("new_line"), "notes",
    )

    def general(df: DataFrame, keep) -> DataFrame:
        c = df.select("review_id", F.from_json("body", COMMENT).alias("c")).select("review_id", "c.*").where(F.coalesce(F.trim("body"), F.lit("")) != "").where(keep)
        note = F.struct("id", "body", "author", "created_at", F.lit(False).alias("system"), F.lit(False).alias("resolvable"), F.lit(False).alias("resolved"))
        return c.select("review_id", F.concat(F.lit("general:"), "id").alias("discussion_id"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("old_line"), F.lit(None).cast("int").alias("new_line"), F.array(note).alias("notes"))

    every = t.unionByName(general(comments, F.lit(True))).unionByName(general(reviews, F.coalesce("state", F.lit("")) != "PENDING"))
    notes = every.select("review_id", "discussion_id", F.posexplode("notes").alias("pos", "n")).select("review_id", "discussion_id", "pos", "n.*")
    first = F.array_min(F.transform("notes", lambda n: n["created_at"]))
    return every.select("review_id", "discussion_id", "path", "old_line", "new_line", first.alias("first_note")), notes


def discussion_flags(notes: DataFrame) -> DataFrame:
    """(review_id, discussion_id, system, resolvable, resolved): all notes of the system's; any resolvable; all of those resolved."""
    can = F.col("resolvable")
    resolved = F.coalesce(F.bool_and(F.when(can, F.col("resolved"))), F.lit(False))
    return notes.groupBy("review_id", "discussion_id").agg(F.bool_and("system").alias("system"), F.bool_or("resolvable").alias("resolvable"), resolved.alias("resolved"))
