"""Unified diffs: files, hunks and numbered lines from raw text, one row of text a review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changegraph.functions.text import content_id

HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$"


def _rows(diffs: DataFrame) -> DataFrame:
    """Lines of each diff with file and hunk numbers and what each hunk's header says."""
    rows = diffs.select("review_id", F.posexplode(F.split("raw", "\n")).alias("pos", "line")).withColumn("line", F.regexp_replace("line", "\r$", ""))
    upto = Window.partitionBy("review_id").orderBy("pos")
    rows = rows.withColumn("is_file", F.col("line").startswith("diff --git ")).withColumn("is_header", F.col("line").rlike(HEADER))
    rows = rows.withColumn("file_id", F.sum(F.col("is_file").cast("int")).over(upto)).withColumn("hunk_id", F.sum(F.col("is_header").cast("int")).over(upto))
    part = lambda i: F.regexp_extract("line", HEADER, i)
    count = lambda i: F.when(F.col("is_header"), F.when(part(i) == "", 1).otherwise(part(i).try_cast("int")))
    start = lambda i: F.when(F.col("is_header"), part(i).try_cast("int"))
    rows = rows.withColumns({"old_start": start(1), "old_len": count(2), "new_start": start(3), "new_len": count(4), "section": F.when(F.col("is_header"), part(5))})
    hunk = Window.partitionBy("review_id", "file_id", "hunk_id")
    return rows.withColumns({c: F.max(c).over(hunk) for c in ("old_start", "old_len", "new_start", "new_len", "section")})


def read_unified_diffs(diffs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, hunks, lines, errors) of (review_id, raw).

    A body goes on until the header's old and new counts are used up, so a removed ``-- x`` is
    a body line. Reviews with an error give their errors only."""
    rows = _rows(diffs)
    hunk = Window.partitionBy("review_id", "file_id", "hunk_id").orderBy("pos")
    before = hunk.rowsBetween(Window.unboundedPreceding, -1)
    old = F.when(F.col("line").rlike(r"^(-| |$)") & ~F.col("is_header") & ~F.col("is_file"), 1).otherwise(0)
    new = F.when(F.col("line").rlike(r"^(\+| |$)") & ~F.col("is_header") & ~F.col("is_file"), 1).otherwise(0)
    rows = rows.withColumn("_old", F.coalesce(F.sum(old).over(before), F.lit(0))).withColumn("_new", F.coalesce(F.sum(new).over(before), F.lit(0)))
    inside = (F.col("old_len").isNotNull()) & ~F.col("is_header") & ~F.col("is_file")
    body = inside & ((F.col("_old") < F.col("old_len")) | (F.col("_new") < F.col("new_len")))
    rows = rows.withColumn("_body", body).withColumn("_note", F.coalesce(F.lead("line").over(hunk).startswith("\\"), F.lit(False)))

    error = (
        F.when(F.col("is_header") & (F.col("file_id") == 0), "hunk before any file")
        .when(F.col("line").startswith("@@ ") & ~F.col("is_header"), "bad hunk header")
        .when(F.col("_body") & ~F.col("line").rlike(r"^([-+ \\]|$)"), "bad line in a hunk")
        .when(F.col("_body") & F.col("line").startswith("-") & (F.col("_old") >= F.col("old_len")), "too many old lines")
        .when(F.col("_body") & F.col("line").startswith("+") & (F.col("_new") >= F.col("new_len")), "too many new lines")
    )
    errors = rows.withColumn("error", error).where("error IS NOT NULL").select("review_id", (F.col("pos") + 1).alias("line_no"), "error")
    good = rows.join(errors.select("review_id").distinct(), "review_id", "left_anti")

    kind = F.when(F.col("line").startswith("+"), "added").when(F.col("line").startswith("-"), "removed").otherwise("context")
    lines = good.where(F.col("_body") & ~F.col("line").startswith("\\")).withColumn("kind", kind)
    lines = lines.select(
        "review_id", "file_id", "hunk_id", (F.row_number().over(hunk) - 1).alias("idx"), "kind",
        F.when(F.col("kind") != "added", F.col("old_start") + F.col("_old")).alias("old_line"),
        F.when(F.col("kind") != "removed", F.col("new_start") + F.col("_new")).alias("new_line"),
        F.substr("line", F.lit(2)).alias("text"), F.col("_note").alias("no_newline"),
    )
    hunks = good.where("is_header").select(
        "review_id", "file_id", "hunk_id", F.struct(F.col("old_start").alias("start"), F.col("old_len").alias("len")).alias("old"),
        F.struct(F.col("new_start").alias("start"), F.col("new_len").alias("len")).alias("new"), "section",
    )
    return _files(good), hunks, lines, errors


def _files(rows: DataFrame) -> DataFrame:
    """(review_id, file_id, path, old_path, status, binary, similarity) from the lines before each file's first hunk."""
    first = F.min(F.when(F.col("is_header"), F.col("pos"))).over(Window.partitionBy("review_id", "file_id"))
    head = rows.withColumn("_first", first).where("file_id > 0 AND (_first IS NULL OR pos < _first)")
    value = lambda pattern: F.max(F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1)))
    has = lambda pattern: F.bool_or(F.col("line").rlike(pattern))
    out = head.groupBy("review_id", "file_id").agg(
        value(r"^--- (?:a/)?(.*)$").alias("old"), value(r"^\+\+\+ (?:b/)?(.*)$").alias("new"), value(r"^diff --git a/(.*) b/\1$").alias("same"),
        value(r"^(?:rename|copy) from (.*)$").alias("source"), value(r"^(?:rename|copy) to (.*)$").alias("target"),
        has(r"^new file mode").alias("added"), has(r"^deleted file mode").alias("deleted"), has(r"^rename from").alias("renamed"), has(r"^copy from").alias("copied"),
        has(r"^(Binary files|GIT binary patch)").alias("binary"), value(r"^similarity index (\d+)%").cast("int").alias("similarity"),
    )
    real = lambda c: F.when(F.col(c) != "/dev/null", F.col(c))
    path = F.coalesce("target", real("new"), real("old"), "same")
    status = (
        F.when(F.col("added") | (F.col("old") == "/dev/null"), "added").when(F.col("deleted") | (F.col("new") == "/dev/null"), "deleted")
        .when(F.col("renamed"), "renamed").when(F.col("copied"), "copied").otherwise("modified")
    )
    out = out.withColumn("status", status)
    old = F.when(~F.col("status").isin("added", "deleted"), F.coalesce("source", real("old"), path))
    return out.select("review_id", "file_id", path.alias("path"), old.alias("old_path"), "status", "binary", "similarity")


def file_key(files: DataFrame) -> DataFrame:
    """Adds file_key, the identity of files without hunks."""
    return files.withColumn("file_key", content_id(F.coalesce("old_path", F.lit("")), "path", "status"))


def hunkless_files(files: DataFrame, hunks: DataFrame) -> DataFrame:
    return files.join(hunks, ["review_id", "file_id"], "left_anti")
