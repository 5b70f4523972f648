"""Groups of changes: checks, repairs, progress and renames.

``assignment``: (review_id, layer, group_id, title, item_id, pos).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changegraph.functions.paths import layer_rank


def check_assignment(assignment: DataFrame, expected: DataFrame) -> DataFrame:
    """(review_id, problem, id): unknown, duplicate and missing items, and groups without a title."""
    item = F.col("item_id").cast("string")
    unknown = assignment.join(expected, ["review_id", "item_id"], "left_anti").select("review_id", F.lit("unknown").alias("problem"), item.alias("id")).distinct()
    twice = assignment.groupBy("review_id", "item_id").count().where("count > 1").select("review_id", F.lit("duplicate").alias("problem"), item.alias("id"))
    missing = expected.join(assignment, ["review_id", "item_id"], "left_anti").select("review_id", F.lit("missing").alias("problem"), item.alias("id"))
    untitled = assignment.where(F.coalesce(F.trim("title"), F.lit("")) == "").select("review_id", F.lit("untitled").alias("problem"), F.col("group_id").cast("string").alias("id")).distinct()
    return unknown.unionByName(twice).unionByName(missing).unionByName(untitled)


def salvage_assignment(assignment: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first placement of each known item, and the items left over."""
    w = Window.partitionBy("review_id", "item_id").orderBy("layer", "group_id", "pos")
    known = assignment.join(expected.select("review_id", "item_id").distinct(), ["review_id", "item_id"], "left_semi")
    kept = known.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return kept, expected.join(kept, ["review_id", "item_id"], "left_anti")


def normalize_layers(assignment: DataFrame) -> DataFrame:
    """Adds layer_pos: layers of the same name (any case) are one, in the order first seen."""
    named = assignment.withColumn("layer", F.lower(F.trim("layer")))
    first = named.groupBy("review_id", "layer").agg(F.min("pos").alias("_first"))
    ranked = first.withColumn("layer_pos", F.row_number().over(Window.partitionBy("review_id").orderBy("_first", "layer")))
    return named.join(ranked.drop("_first"), ["review_id", "layer"])


def validate_merges(merges: DataFrame, groups: DataFrame) -> DataFrame:
    """(review_id, merge_id, problem): members named twice or unknown, single members, missing titles. merges: (merge_id, group_id, title)."""
    key = ["review_id", "merge_id"]
    again = merges.groupBy("review_id", "group_id").agg(F.collect_set("merge_id").alias("m")).where(F.size("m") > 1).select("review_id", F.explode("m").alias("merge_id"), F.lit("group merged twice").alias("problem"))
    unknown = merges.join(groups, ["review_id", "group_id"], "left_anti").select(*key, F.lit("unknown group").alias("problem"))
    few = merges.groupBy(*key).agg(F.countDistinct("group_id").alias("n")).where("n < 2").select(*key, F.lit("fewer than two groups").alias("problem"))
    bare = merges.where(F.coalesce(F.trim("title"), F.lit("")) == "").select(*key, F.lit("no title").alias("problem"))
    return again.unionByName(unknown).unionByName(few).unionByName(bare).distinct()


def apply_merges(assignment: DataFrame, merges: DataFrame) -> DataFrame:
    """Members of a merge go to its smallest group, under its title."""
    target = merges.groupBy("review_id", "merge_id").agg(F.min("group_id").alias("_target"), F.min("title").alias("_title"))
    remap = merges.select("review_id", "merge_id", "group_id").join(target, ["review_id", "merge_id"]).drop("merge_id")
    rows = assignment.join(remap, ["review_id", "group_id"], "left")
    return rows.withColumn("group_id", F.coalesce("_target", "group_id")).withColumn("title", F.coalesce("_title", "title")).drop("_target", "_title")


def dominant_layer_rank(assignment: DataFrame) -> DataFrame:
    """(review_id, group_id, rank): the rank of the layer with most items, the lowest on a tie."""
    by_layer = assignment.groupBy("review_id", "group_id", layer_rank(F.col("layer")).alias("r")).agg(F.count("*").alias("n"))
    return by_layer.groupBy("review_id", "group_id").agg(F.min_by("r", F.struct(-F.col("n"), F.col("r"))).alias("rank"))


def group_progress(assignment: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(review_id, group_id, done, total) over the group's items."""
    rows = assignment.join(reviewed.select("review_id", "item_id").distinct().withColumn("_done", F.lit(True)), ["review_id", "item_id"], "left")
    return rows.groupBy("review_id", "group_id").agg(F.count_if(F.coalesce("_done", F.lit(False))).alias("done"), F.count("*").alias("total"))


def rename_counts(pairs: DataFrame) -> DataFrame:
    """(review_id, old, new, hunks), by number of hunks."""
    return pairs.groupBy("review_id", "old", "new").agg(F.countDistinct("hunk_id").alias("hunks"))


def aside_summary(classes: DataFrame, k: int = 8) -> DataFrame:
    """(review_id, class, old, new, hunks, rank) of the ``k`` most used pairs of each class (the feature's own limit)."""
    rows = classes.groupBy("review_id", "class", "old", "new").agg(F.countDistinct("hunk_id").alias("hunks"))
    w = Window.partitionBy("review_id", "class").orderBy(F.desc("hunks"), "old", "new")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def word_inventory(texts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, word): distinct identifiers, of the asked names only if given."""
    out = texts.select("snapshot_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("word")).distinct()
    key = ["snapshot_id", "word"]
    return out if names is None else out.join(names.select(*key).distinct(), key, "left_semi").select(*key)


def confirm_renames(pairs: DataFrame, base_words: DataFrame, head_words: DataFrame) -> DataFrame:
    """(review_id, hunk_id, old, new) of hunks all of whose pairs are confirmed: the old name is gone from the review's head and the new one was not in its base.

    pairs: (review_id, hunk_id, old, new); words: (review_id, word)."""
    there = head_words.select("review_id", F.col("word").alias("old")).distinct().withColumn("_there", F.lit(True))
    was = base_words.select("review_id", F.col("word").alias("new")).distinct().withColumn("_was", F.lit(True))
    rows = pairs.distinct().join(there, ["review_id", "old"], "left").join(was, ["review_id", "new"], "left")
    doubt = rows.where("_there OR _was").select("review_id", "hunk_id").distinct()
    return rows.join(doubt, ["review_id", "hunk_id"], "left_anti").select("review_id", "hunk_id", "old", "new")


TOKEN = r"""("[^"]*"|'[^']*'|[A-Za-z_][A-Za-z0-9_]*|[0-9]+|\S)"""


def rename_shape(lines: DataFrame) -> DataFrame:
    """(review_id, hunk_id, pairs, imports_only): hunks whose two sides differ in identifiers only, each old one always becoming the same new one.

    lines: (review_id, hunk_id, idx, kind, text, is_import)."""

    def side(kind: str):
        own = F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & ~F.col("is_import"), F.struct("idx", "text"))))
        return F.regexp_extract_all(F.array_join(F.transform(own, lambda x: x["text"]), "\n"), F.lit(TOKEN), F.lit(1))

    rows = lines.groupBy("review_id", "hunk_id").agg(side("removed").alias("a"), side("added").alias("b"), F.bool_or("is_import").alias("has_import"))
    rows = rows.where(F.size("a") == F.size("b")).withColumn("pairs", F.array_distinct(F.filter(F.arrays_zip("a", "b"), lambda x: x["a"] != x["b"])))
    names = F.forall("pairs", lambda x: x["a"].rlike("^[A-Za-z_]") & x["b"].rlike("^[A-Za-z_]"))
    function = F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"]))) == F.size("pairs")
    rows = rows.where(names & function & ((F.size("pairs") > 0) | F.col("has_import")))
    pairs = F.transform("pairs", lambda x: F.struct(x["a"].alias("old"), x["b"].alias("new")))
    return rows.select("review_id", "hunk_id", pairs.alias("pairs"), (F.size("pairs") == 0).alias("imports_only"))


def step_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(snapshot_id, entry_id, step_id, change): added, removed, or rerouted (in both, with other parents). Both: (snapshot_id, entry_id, step_id, parent_id)."""
    key = ["snapshot_id", "entry_id", "step_id"]
    own = lambda df, name: df.groupBy(*key).agg(F.array_sort(F.collect_set("parent_id")).alias(name))
    rows = own(before, "_b").join(own(after, "_a"), key, "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "rerouted")
    return rows.withColumn("change", change).where("change IS NOT NULL").select(*key, "change")
