"""Names in nested scopes: the binding or value that a name has where it is used.

A scope tree is (snapshot_id, scope_id, parent_id, is_type). Uses of a name ask in their own scope; what is not
found there asks in the scope around it, each question once for all uses that lead to it, so the rounds get
smaller as the tree narrows. Questions and definitions of one (scope, name) meet in one ordered
pass, so no pairs of uses and definitions are made. The answers go back the way the questions came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changegraph.operators.graph import P, closure, store

#: Uses in a type see its fields wherever they stand.
_ANYWHERE = 2**62
#: Up to so many answers are sent to all tasks; beyond, they are joined by shuffle.
BROADCAST_ANSWERS = 100_000


def scope_paths(scopes: DataFrame) -> DataFrame:
    """(scope_id, outer_id, dist, outer_is_type): every scope, itself (0) and those around it."""
    up = scopes.where("parent_id IS NOT NULL").select(P, F.col("scope_id").alias("from_id"), F.col("parent_id").alias("to_id"))
    paths = closure(up, scopes.select(P, F.col("scope_id").alias("start_id")), None)
    kind = scopes.select(P, F.col("scope_id").alias("node_id"), F.col("is_type").alias("outer_is_type"))
    return paths.join(kind, [P, "node_id"]).select(P, F.col("start_id").alias("scope_id"), F.col("node_id").alias("outer_id"), "dist", "outer_is_type")


def _tree(scopes: DataFrame) -> DataFrame:
    """(scope_id, parent_id, is_type) of scopes, given as such or as ``scope_paths``."""
    if "outer_id" not in scopes.columns:
        return scopes.select(P, "scope_id", "parent_id", "is_type")
    up = scopes.where("dist = 1").select(P, "scope_id", F.col("outer_id").alias("parent_id"))
    return scopes.where("dist = 0").select(P, "scope_id", F.col("outer_is_type").alias("is_type")).join(up, [P, "scope_id"], "left").select(P, "scope_id", "parent_id", "is_type")


def _few(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if most <= BROADCAST_ANSWERS else df


def _hash(question: str) -> Column:
    """What questions are sorted by first: numbers compare faster than structs."""
    return F.xxhash64(question).alias("_h")


def _look(asked: DataFrame, definitions: DataFrame, tree: DataFrame) -> DataFrame:
    """``asked`` (scope_id, name, at, fields_only, …) with what its own scope says: parent_id, and found, a struct that is null if there is no definition."""
    kind = definitions.schema["value"].dataType.simpleString()
    if "parent_id" in asked.columns:
        rows = asked.withColumn("_known", F.lit(True))
    else:
        rows = asked.join(tree.withColumn("_known", F.lit(True)), ["scope_id", P], "left")
    line = F.when(F.col("is_type"), F.lit(_ANYWHERE)).otherwise(F.col("at").cast("long"))
    none = F.lit(None)
    u = rows.select(
        P, "scope_id", "name", line.alias("_line"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_ord"), none.cast("boolean").alias("_field"), none.cast(f"struct<value:{kind}>").alias("_bound"),
        F.struct(*[c for c in rows.columns if c not in (P, "scope_id", "name")]).alias("_row"),
    )
    d = definitions.select(
        P, "scope_id", "name", F.col("at").cast("long").alias("_line"), F.lit(0).alias("_side"), F.col("ord").cast("long").alias("_ord"), F.col("field").alias("_field"), F.struct("value").alias("_bound"),
        none.cast(u.schema["_row"].dataType).alias("_row"),
    )
    w = Window.partitionBy("scope_id", "name", P).orderBy("_line", "_side", "_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every, fields = F.last("_bound", ignorenulls=True).over(w), F.last(F.when(F.col("_field"), F.col("_bound")), ignorenulls=True).over(w)
    seen = d.unionByName(u).withColumns({"_all": every, "_fields": fields}).where("_side = 1").select(P, "scope_id", "name", "_row.*", "_all", "_fields")
    looks = F.col("_known") & (F.col("is_type") | ~F.col("fields_only"))
    return seen.withColumn("found", F.when(looks, F.when(F.col("fields_only"), F.col("_fields")).otherwise(F.col("_all")))).drop("_all", "_fields", "_known", "is_type")


def _answered(uses: DataFrame, definitions: DataFrame, scopes: DataFrame) -> DataFrame:
    """``uses`` with found (a struct of the value) and dist of the nearest scope that has the name, both null if none has.

    Uses may bring parent_id and is_type of their own scopes, which then need not be among ``scopes``. A use is given
    once for each way up, if scopes have several parents. A question carries a scope that it has met (its own, where the mark
    is null) and ends when it comes there again, so scopes around themselves end too; that scope is set anew in
    rounds 1, 2, 4, …, so the mark does not keep questions apart for long."""
    tree = _tree(scopes)
    kept = [c for c in uses.columns if c not in (P, "scope_id", "at", "fields_only", "parent_id", "is_type")]
    asked, rounds, sizes = uses.withColumn("_mark", F.lit(None).cast("string")), [], []
    while True:
        n = len(rounds) + 1
        met = F.coalesce("_mark", "scope_id")
        mark = F.lit(None).cast("string") if n & (n - 1) == 0 else met
        on = F.when(F.col("found").isNull() & (F.col("parent_id") != met), F.struct(P, F.col("parent_id").alias("scope_id"), "name", "at", "fields_only", mark.alias("_mark")))
        own = [P, *kept] if not rounds else [F.struct(P, "scope_id", "name", "at", "fields_only", "_mark").alias("_q")]
        rounds.append(store(_look(asked, definitions, tree).select(*own, "found", on.alias("_on"))))
        sizes.append(rounds[-1].count() if n > 1 else BROADCAST_ANSWERS + 1)
        open_ = rounds[-1].where("_on IS NOT NULL")
        if open_.isEmpty():
            break
        if n == 1:  # from here on only scopes with scopes in them are asked; where uses bring their parents, the others need not be given
            if "parent_id" not in uses.columns:
                tree = tree.join(tree.select(P, F.col("parent_id").alias("scope_id")).distinct(), ["scope_id", P], "left_semi")
            tree = store(tree.distinct())
            definitions = store(definitions.join(tree.select(P, "scope_id"), ["scope_id", P], "left_semi"))
        asked = open_.select("_on.*").distinct()
    answers = rounds[-1].select(*[c for c in rounds[-1].columns if c != "_on"], F.when(F.col("found").isNotNull(), F.lit(0)).alias("dist"))
    for k in range(len(rounds) - 2, -1, -1):
        up = answers.where("found IS NOT NULL").select(_hash("_q"), F.col("_q").alias("_on"), F.col("found").alias("_found"), F.col("dist").alias("_dist"))
        own = [c for c in rounds[k].columns if c not in ("_on", "found")]
        # What does not ask further goes past the join: its missing question would bring it all into one task.
        done = rounds[k].where("_on IS NULL").select(*own, "found", F.when(F.col("found").isNotNull(), F.lit(0)).alias("dist"))
        rows = rounds[k].where("_on IS NOT NULL").withColumn("_h", _hash("_on")).join(_few(up, sizes[k + 1]), ["_h", "_on"], "left")
        answers = done.unionByName(rows.select(*own, F.col("_found").alias("found"), (F.col("_dist") + 1).alias("dist")))
    return answers


def nearest_definition(uses: DataFrame, definitions: DataFrame, scopes: DataFrame) -> DataFrame:
    """(use_id, found, dist): the last definition of the name in the nearest scope around the use that has one.

    uses: (use_id, scope_id, name, at, fields_only); definitions: (scope_id, name, at, ord, field, value), value of any
    type; scopes as a tree or as ``scope_paths`` gives. In a callable only definitions up to the use's line ``at``
    count, in a type all; a use with fields_only looks into types alone and sees fields alone."""
    uses = uses.select(P, F.col("use_id").cast("string").alias("use_id"), "scope_id", "name", "at", "fields_only")
    best = _answered(uses, definitions, scopes).where("found IS NOT NULL").groupBy(P, "use_id").agg(F.min_by(F.struct("found", "dist"), "dist").alias("_b"))
    return best.select(P, "use_id", F.col("_b.found.value").alias("found"), F.col("_b.dist").alias("dist"))


def binding_lookup(refs: DataFrame, bindings: DataFrame, scopes: DataFrame, levels: DataFrame) -> DataFrame:
    """(ref_id, type_name, via): the declared type of a name where it is used.

    refs: (ref_id, scope_id, type_id, name, at, fields_only), type_id being the type around the reference; bindings:
    (scope_id, name, at, ord, field, type_name); scopes as a tree or as ``scope_paths`` gives; levels: (type_id, relative_id,
    dist), supertypes by distance. References may bring parent_id and is_type of their scopes, which then need not be among ``scopes``. The nearest scope wins (``via`` scope); a name that no scope has may be an inherited field:
    the first one in the nearest supertype (``via`` inherited), the least id among supertypes of one distance."""
    brought = ["parent_id", "is_type"] if {"parent_id", "is_type"} <= set(refs.columns) else []
    uses = refs.select(P, F.col("ref_id").cast("string").alias("ref_id"), "scope_id", "type_id", "name", "at", "fields_only", *brought)
    here = _answered(uses, bindings.withColumn("value", F.col("type_name")), scopes)
    fields = bindings.where("field").select(P, F.col("scope_id").alias("relative_id"), "name", "type_name", "ord")
    first = fields.groupBy(P, "relative_id", "name").agg(F.min_by("type_name", "ord").alias("type_name"))
    above = levels.where("dist > 0").join(first, [P, "relative_id"]).groupBy(P, "type_id", "name")
    above = store(above.agg(F.min(F.struct(F.col("dist"), "relative_id", "type_name")).alias("_above")))
    rows = here.join(_few(above, above.count()), [P, "type_id", "name"], "left")
    best = rows.groupBy(P, "ref_id").agg(F.min_by("found", F.when(F.col("found").isNotNull(), F.col("dist"))).alias("_here"), F.min("_above").alias("_above"))
    via = F.when(F.col("_here").isNotNull(), "scope").otherwise("inherited")
    best = best.where("_here IS NOT NULL OR _above IS NOT NULL")
    return best.select(P, "ref_id", F.when(F.col("_here").isNotNull(), F.col("_here.value")).otherwise(F.col("_above.type_name")).alias("type_name"), via.alias("via"))
