"""Diff lines: counters, pairs, digests, statistics and overlays.

``lines`` has (review_id, hunk_id, idx, kind, text), kind being context, added or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changegraph.functions.paths import directory
from changegraph.functions.text import content_id, squash
from changegraph.operators.graph import store

HUNK = ("review_id", "hunk_id")


def _running(order: str = "idx"):
    return Window.partitionBy(*HUNK).orderBy(order)


def diff_stats(lines: DataFrame, *keys: str) -> DataFrame:
    """Added and removed lines by review and ``keys``."""
    return lines.groupBy("review_id", *keys).agg(F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "removed").alias("removed"))


def line_counters(lines: DataFrame, old_start: Column | int = 1, new_start: Column | int = 1) -> DataFrame:
    """Adds old_ctr and new_ctr: the numbers that the next old and new line would have, at each line."""
    before = _running().rowsBetween(Window.unboundedPreceding, -1)
    old = F.coalesce(F.sum((F.col("kind") != "added").cast("int")).over(before), F.lit(0))
    new = F.coalesce(F.sum((F.col("kind") != "removed").cast("int")).over(before), F.lit(0))
    lit = lambda v: F.lit(v) if isinstance(v, int) else v
    return lines.withColumn("old_ctr", old + lit(old_start)).withColumn("new_ctr", new + lit(new_start))


def pair_changed_lines(lines: DataFrame) -> DataFrame:
    """(review_id, hunk_id, run, k, old_idx, new_idx): in each run of changed lines the k-th removed beside the k-th added."""
    starts = (F.col("kind") != "context") & (F.coalesce(F.lag("kind").over(_running()), F.lit("context")) == "context")
    changed = lines.withColumn("run", F.sum(starts.cast("int")).over(_running())).where("kind <> 'context'")
    k = F.row_number().over(Window.partitionBy(*HUNK, "run", "kind").orderBy("idx"))
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("idx")))
    return changed.withColumn("k", k).groupBy(*HUNK, "run", "k").agg(pick("removed").alias("old_idx"), pick("added").alias("new_idx"))


def hunk_digest(lines: DataFrame, n: int = 3, width: int = 80, section_width: int = 60) -> DataFrame:
    """(review_id, hunk_id, added, removed, digest): ``@@ section @@ +a -r | first changed lines``.

    ``lines`` also has section, the text of the hunk's header. The first ``n`` changed lines that
    are not blank are squashed, and what is longer than its width ends in an ellipsis."""
    short = lambda c, w: F.when(F.length(c) > w, F.concat(F.substring(c, 1, w), F.lit("…"))).otherwise(c)
    text = squash(F.col("text"), 1 << 30)
    own = (F.col("kind") != "context") & (text != "")
    shown = F.struct("idx", F.concat(F.when(F.col("kind") == "added", "+").otherwise("-"), short(text, width)).alias("t"))
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.when(own, shown))), 1, n), lambda x: x["t"])
    section = short(squash(F.coalesce(F.max("section"), F.lit("")), 1 << 30), section_width)
    rows = lines.groupBy(*HUNK).agg(
        F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "removed").alias("removed"), first.alias("_first"), section.alias("_section")
    )
    head = F.when(F.col("_section") != "", F.concat(F.lit("@@ "), "_section", F.lit(" @@ "))).otherwise("")
    tail = F.when(F.size("_first") > 0, F.concat(F.lit(" | "), F.array_join("_first", " ⏎ "))).otherwise("")
    return rows.select(*HUNK, "added", "removed", F.concat(head, F.lit("+"), "added", F.lit(" -"), "removed", tail).alias("digest"))


# Languages where a line that begins with ``import`` is prose or data.
NO_IMPORTS = ("markdown", "json", "yaml", "xml", "html", "properties", "toml", "sql", "shell", "css", "scss")

#: What is trimmed around a line.
BLANKS = " \t\n\x0b\f\r"


def _imports(t: Column, script: Column) -> Column:
    """Whether a trimmed line begins an import, package or re-export."""
    after = F.ltrim(F.substr(t, F.lit(7)), F.lit(BLANKS))
    plain = t.rlike(r"^import([ {*]|$|\s*\()")
    whole = ~(script & after.rlike("^[\"'`]")) & ((after == "(") | ~after.startswith("("))
    source = F.regexp_extract(t, r"^.*? from (.*)$", 1)
    return (
        F.when(plain, whole).when(t.startswith("from "), t.contains(" import ") | t.endswith(" import"))
        .when(t.rlike("^(export |})"), F.ltrim(source, F.lit(BLANKS)).rlike("^[\"'`]"))
        .when(t.rlike("^(pub use |use )"), ~t.contains("(") & t.rlike("[;{]$")).when(t.startswith("using "), t.endswith(";") & ~t.contains("("))
        .otherwise(t.rlike("^(package |#include|#import|require |require_relative )") | t.contains("= require("))
    )


def import_lines(lines: DataFrame) -> DataFrame:
    """Adds is_import; ``lines`` also has language. An import that opens a bracket goes on to the line that closes one.

    A script's import without bindings and a dynamic import are code. Whether a line stands in an
    open import follows from the last line that surely opened or closed one, and from how many
    lines since then could do both."""
    t = F.trim(F.col("text"), F.lit(BLANKS))
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c)))
    begins = _imports(t, F.coalesce(F.col("language").isin("typescript", "tsx", "javascript"), F.lit(False)))
    opens = begins & ((count("{") > count("}")) | (count("(") > count(")")))
    closes = t.contains("}") | t.contains(")")
    rows = lines.withColumns({"_begins": begins, "_opens": opens, "_closes": closes})
    rows = rows.withColumn("_sure", F.when(F.col("_opens") != F.col("_closes"), F.col("_opens")))
    upto = _running().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_since", F.count("_sure").over(upto))
    since = Window.partitionBy(*HUNK, "_since").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = F.sum((F.col("_opens") & F.col("_closes")).cast("int")).over(since)
    after = F.coalesce(F.first("_sure", ignorenulls=True).over(since), F.lit(False)) != (both % 2 == 1)
    rows = rows.withColumn("_after", after).withColumn("_inside", F.coalesce(F.lag("_after").over(_running()), F.lit(False)))
    known = ~F.coalesce(F.col("language").isin(*NO_IMPORTS), F.lit(False))
    return rows.withColumn("is_import", known & (F.col("_inside") | F.col("_begins"))).drop("_begins", "_opens", "_closes", "_sure", "_since", "_after", "_inside")


def hunk_content_hash(lines: DataFrame) -> DataFrame:
    """(review_id, hunk_id, content_hash) from the path, signs and texts; line numbers play no part. ``lines`` also has path."""
    sign = F.when(F.col("kind") == "added", "+").when(F.col("kind") == "removed", "-").otherwise(" ")
    ordered = F.array_sort(F.collect_list(F.struct("idx", F.concat(sign, "text").alias("t"))))
    body = F.array_join(F.transform(ordered, lambda x: x["t"]), "\n")
    return lines.groupBy(*HUNK, "path").agg(body.alias("body")).select(*HUNK, content_id("path", "body").alias("content_hash"))


def whitespace_only(lines: DataFrame) -> DataFrame:
    """(review_id, hunk_id, whitespace_only): the removed text equals the added text once white space is gone."""

    def side(kind: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("idx", "text"))))
        return F.regexp_replace(F.array_join(F.transform(ordered, lambda x: x["text"]), ""), r"\s+", "")

    return lines.groupBy(*HUNK).agg((side("removed") == side("added")).alias("whitespace_only"))


def mechanical_kind(hunks: DataFrame) -> DataFrame:
    """Adds kind from is_generated, whitespace_only and rename_class (``imports``, ``renamed`` or null), in that precedence."""
    kind = F.when(F.col("is_generated"), "generated").when(F.col("whitespace_only"), "whitespace").otherwise(F.col("rename_class"))
    return hunks.withColumn("mechanical", kind)


def tree_order(files: DataFrame) -> DataFrame:
    """Adds tree_pos from 1: directory by directory, a directory's files before its subdirectories."""
    parts = F.split(directory(F.col("path")), "/")
    dirs = F.when(F.col("path").contains("/"), parts).otherwise(F.array().cast("array<string>"))
    ranked = F.row_number().over(Window.partitionBy("review_id").orderBy(dirs, F.element_at(F.split("path", "/"), -1), "path"))
    return files.withColumn("tree_pos", ranked)


def overlay_file(head: DataFrame, lines: DataFrame) -> DataFrame:
    """(review_id, path, pos, old_line, new_line, kind, text): the whole new file with removed lines in their places.

    ``head``: (review_id, path, new_line, text). ``lines``: (review_id, path, idx, kind, old_line,
    new_line, before), ``before`` being the new line that a removed one stands before. Outside
    of changes the old number is the new one less what was added, plus what was removed, above."""
    added = lines.where("kind = 'added'").select("review_id", "path", "new_line", F.lit("added").alias("k"))
    kept = head.join(added, ["review_id", "path", "new_line"], "left").select(
        "review_id", "path", F.col("new_line").alias("at"), F.lit(1).alias("part"), F.lit(0).alias("idx"), "new_line", F.coalesce("k", F.lit("context")).alias("kind"), "text"
    )
    gone = lines.where("kind = 'removed'").select(
        "review_id", "path", F.col("before").alias("at"), F.lit(0).alias("part"), "idx", F.lit(None).cast("int").alias("new_line"), "kind", "text"
    )
    order = Window.partitionBy("review_id", "path").orderBy("at", "part", "idx")
    olds = F.sum((F.col("kind") != "added").cast("int")).over(order)
    rows = kept.unionByName(gone).withColumn("pos", F.row_number().over(order))
    return rows.select("review_id", "path", "pos", F.when(F.col("kind") != "added", olds).alias("old_line"), "new_line", "kind", "text")


def directory_rollup(files: DataFrame) -> DataFrame:
    """(review_id, dir, files, added, removed, done) of every directory with all below it; files: (path, added, removed, reviewed)."""
    parts = F.split("path", "/")
    upto = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, ".").otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    return files.withColumn("dir", F.explode(upto)).groupBy("review_id", "dir").agg(
        F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count_if("reviewed").alias("done")
    )


def group_by_directory(items: DataFrame, most: int = 40) -> DataFrame:
    """Adds dir: the shallowest directory prefix of at most ``most`` total weight, else the whole directory.

    Depth by depth, groups that are small or have nothing deeper are peeled off; the rest goes
    one component further."""
    parts = F.split(directory(F.col("path")), "/")
    rest, done, depth = items.withColumn("_parts", parts), None, 0
    while done is None or not rest.isEmpty():
        depth += 1
        here = rest.withColumn("dir", F.array_join(F.slice("_parts", 1, depth), "/"))
        sizes = here.groupBy("review_id", "dir").agg(F.sum("weight").alias("_w"), F.max(F.size("_parts")).alias("_deep"))
        here = store(here.join(sizes, ["review_id", "dir"]))
        final = (F.col("_w") <= most) | (F.col("_deep") <= depth)
        out = here.where(final).drop("_w", "_deep", "_parts")
        done = out if done is None else done.unionByName(out)
        rest = store(here.where(~final).drop("_w", "_deep", "dir"))
    return done


def running_sums(rows: DataFrame, key: list[str], order: list[str], value: Column) -> DataFrame:
    """Adds ``_pos`` (from 0) and ``_before``, the sum of ``value`` over earlier rows of the key.

    Rows are sorted by ranges; a key's sums are added up over the ranges that it spans, so no key is gathered in one task."""
    by = [F.col(c) for c in [*key, *order]]
    placed = store(rows.withColumn("_v", value.cast("long")).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy("_part", *key).orderBy(*order)
    placed = placed.withColumns({"_pos": F.row_number().over(inner) - 1, "_before": F.sum("_v").over(inner) - F.col("_v")})
    parts = placed.groupBy("_part", *key).agg(F.sum("_v").alias("_sum"), F.count("*").alias("_n"))
    outer = Window.partitionBy(*key).orderBy("_part")
    parts = parts.select("_part", *key, (F.sum("_sum").over(outer) - F.col("_sum")).alias("_sums"), (F.sum("_n").over(outer) - F.col("_n")).alias("_rows"))
    out = placed.join(parts, ["_part", *key])
    return out.withColumns({"_pos": F.col("_pos") + F.col("_rows"), "_before": F.col("_before") + F.col("_sums")}).drop("_part", "_v", "_sums", "_rows")


def pack_batches(items: DataFrame, budget: int) -> DataFrame:
    """Adds batch from 0 to (review_id, dir, ord, weight) items, taken in order; a directory that fits is not split.

    Units are directories that fit, and the items of the others. From running sums each unit learns where the batch
    that it would begin must end: at the first later unit beyond the budget, which stands in its own stretch of
    ``budget`` or the next one. Following these pointers from the first unit, twice as far in each round, marks the units
    that do begin a batch. Units beyond the budget are batches of their own. No task holds a whole review."""
    key = ["review_id"]
    dirs = items.groupBy("review_id", "dir").agg(F.sum("weight").alias("_total"), F.min("ord").alias("_first"))
    rows = store(items.join(dirs, ["review_id", "dir"]).withColumn("_fits", F.col("_total") <= budget).withColumn("_unit", F.when(F.col("_fits"), F.col("_first")).otherwise(F.col("ord"))))
    units = rows.groupBy("review_id", "_first", "_unit").agg(F.sum("weight").cast("long").alias("_w"))
    units = store(running_sums(units, key, ["_first", "_unit"], F.col("_w") > budget))
    segment = 2 * F.col("_before") + (F.col("_w") > budget).cast("long")
    units = units.select("review_id", "_first", "_unit", "_w", F.col("_pos").alias("_at"), segment.alias("_segment"))
    units = store(running_sums(units, [*key, "_segment"], ["_at"], F.col("_w")))
    whole = units.where(F.col("_w") <= budget)
    stretch = lambda x: F.floor(x / budget)
    end = F.col("_before") + F.col("_w")
    points = whole.select("review_id", "_segment", stretch(end).alias("_s"), end.alias("_x"), F.lit(0).alias("_asks"), "_at")
    asks = whole.select("review_id", "_segment", stretch(F.col("_before") + budget).alias("_s"), (F.col("_before") + budget).alias("_x"), F.lit(1).alias("_asks"), "_at")
    w = Window.partitionBy("review_id", "_segment", "_s").orderBy("_x", "_asks", "_at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    here = points.unionByName(asks).withColumn("_next", F.first(F.when(F.col("_asks") == 0, F.col("_at")), ignorenulls=True).over(w)).where("_asks = 1")
    later = points.groupBy("review_id", "_segment", (F.col("_s") - 1).alias("_s")).agg(F.min("_at").alias("_later"))
    here = here.join(later, ["review_id", "_segment", "_s"], "left")
    jump = store(here.select("review_id", "_at", F.coalesce("_next", "_later").alias("_to")).where("_to IS NOT NULL"))
    begins = store(units.groupBy("review_id", "_segment").agg(F.min("_at").alias("_at")).select("review_id", "_at"))
    while not jump.isEmpty():
        begins = store(begins.unionByName(begins.join(jump, ["review_id", "_at"]).select("review_id", F.col("_to").alias("_at"))).distinct())
        onward = jump.select("review_id", F.col("_at").alias("_to"), F.col("_to").alias("_far"))
        jump = store(jump.join(onward, ["review_id", "_to"]).select("review_id", "_at", F.col("_far").alias("_to")))
    begun = units.select("review_id", "_unit", "_at").join(begins.withColumn("_begins", F.lit(1)), ["review_id", "_at"], "left")
    numbered = running_sums(begun, key, ["_at"], F.coalesce("_begins", F.lit(0)))
    batch = F.col("_before") + F.coalesce("_begins", F.lit(0)) - 1
    return rows.join(numbered.select("review_id", "_unit", batch.alias("batch")), ["review_id", "_unit"]).select(*items.columns, "batch")


def package_roots(files: DataFrame) -> DataFrame:
    """(review_id, module, root): each module's longest common directory prefix, from its least and greatest path."""
    dirs = F.split(directory(F.col("path")), "/")
    ends = files.groupBy("review_id", "module").agg(F.min(dirs).alias("a"), F.max(dirs).alias("z"))
    same = F.transform(F.sequence(F.lit(1), F.least(F.size("a"), F.size("z"))), lambda i: F.slice("a", F.lit(1), i) == F.slice("z", F.lit(1), i))
    return ends.select("review_id", "module", F.slice("a", F.lit(1), F.size(F.filter(same, lambda x: x))).alias("root"))
