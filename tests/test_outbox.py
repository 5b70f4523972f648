"""Comments to send, and a sink that a repeated batch cannot make send twice."""

from pyspark.sql import functions as F

from changegraph.streaming.outbox import outbox, plan_comments, sent_comments
from tests.test_operators import rows

DRAFTS = "review_id string, draft_id string, body string, remote_id string, reply_to string, author string, general boolean"
PLACES = "review_id string, draft_id string, status string, path string, first long, last long, old_side boolean"
CAPS = "review_id string, forge string, drafts boolean, file_comments boolean, commit string"


def planned(spark, caps):
    drafts = [("r", "1", "a", "9", None, None, None), ("r", "2", "b", None, None, None, None), ("r", "3", "c", None, None, None, None), ("r", "4", "d", None, "d7", "ann", True), ("r", "5", "e", None, None, None, None)]
    places = [("r", "1", "line", "p.py", 3, 3, False), ("r", "2", "file", "q.py", None, None, None), ("r", "3", "stale", None, None, None, None)]
    summary = [("r", "done \n", "77"), ("x", " ", None)]
    return plan_comments(spark.createDataFrame(drafts, DRAFTS), spark.createDataFrame(places, PLACES), spark.createDataFrame(caps, CAPS), spark.createDataFrame(summary, "review_id string, body string, remote_id string"))


def test_payloads_by_what_the_forge_can_do(spark):
    payloads, skipped = planned(spark, [("r", "github", False, False, "sha"), ("x", "github", False, False, "s")])
    assert rows(skipped, "draft_id") == [("3",), ("5",)]
    assert rows(payloads, "draft_id", "what", "body", "in_reply_to", "remote_id", "mode") == [
        ("1", "p.py:3", "a", None, None, "direct"), ("2", "q.py", "**`q.py`**\n\nb", None, None, "direct"), ("4", "reply to @ann", "@ann d", "d7", None, "direct"), ("summary", "summary", "done", None, None, "direct"),
    ]
    payloads, _ = planned(spark, [("r", "gitlab", True, True, "sha")])
    got = {r.draft_id: r for r in payloads.collect()}
    assert got["1"].position == '{"path":"p.py","first":3,"last":3,"old_side":false,"commit":"sha"}' and got["2"].position == '{"path":"q.py","commit":"sha"}'
    assert (got["1"].remote_id, got["summary"].remote_id, got["4"].body) == ("9", "77", "d") and len({r.key for r in got.values()}) == 4


def test_a_repeated_batch_sends_nothing_twice(spark, tmp_path):
    payloads, _ = planned(spark, [("r", "gitlab", True, True, "sha")])
    source, box, log = (str(tmp_path / x) for x in ("in", "box", "log"))
    payloads.coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(payloads.schema).parquet(source)

    def send(df):
        df.select("draft_id", "key").write.mode("append").parquet(log)
        return df.withColumn("remote_id", F.coalesce("remote_id", F.concat(F.lit("new-"), "draft_id")))

    outbox(stream(), box, send, str(tmp_path / "one")).awaitTermination()
    assert spark.read.parquet(log).count() == 4
    # A lost checkpoint makes the same batch run again; the same payloads come in one more file, too.
    payloads.coalesce(1).write.mode("append").parquet(source)
    outbox(stream(), box, send, str(tmp_path / "two")).awaitTermination()
    assert spark.read.parquet(log).count() == 4
    edited = payloads.where("draft_id = '2'").withColumn("body", F.lit("b2")).withColumn("key", F.lit("other"))
    edited.coalesce(1).write.mode("append").parquet(source)
    outbox(stream(), box, send, str(tmp_path / "two")).awaitTermination()
    assert spark.read.parquet(log).count() == 5
    assert rows(sent_comments(spark, box), "draft_id", "remote_id") == [("1", "9"), ("2", "new-2"), ("2", "new-2"), ("4", "new-4"), ("summary", "77")]
