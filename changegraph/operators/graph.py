"""Symbols and edges: merging, rolling up, neighbours and traversal.

``symbols`` has (snapshot_id, symbol_id, kind, module, changed, …), ``edges`` (snapshot_id,
from_id, to_id, kind, confidence, line).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P = "snapshot_id"
TYPE_KINDS = ("class", "interface", "enum", "record", "object", "annotation")
CALLABLE_KINDS = ("method", "function", "constructor")
#: Beyond so many rows in a task, rows are dealt to more tasks than the session's number of shuffle partitions.
TASK_ROWS = 400_000


def store(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job: checkpoint to the shared folder the session names."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="changegraph-"))
    return df.checkpoint()


def spread(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """Deals rows by keys to as many tasks as keep each at about ``TASK_ROWS``; as they are, where the session's tasks suffice or ``rows`` is not known."""
    tasks = -(-(rows or 0) // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def merge_edges(candidates: DataFrame) -> DataFrame:
    """One edge for (from, to, kind): largest confidence within [0, 1], first line by ``ord``; no self-edges."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max("confidence").cast("double")))
    return candidates.where("from_id <> to_id").groupBy(P, "from_id", "to_id", "kind").agg(c.alias("confidence"), F.min_by("line", "ord").alias("line"))


def confidence_buckets(edges: DataFrame) -> DataFrame:
    """(snapshot_id, bucket, n) of the edges' confidence, and their total."""
    c = F.col("confidence")
    bucket = F.when(F.col("confirmed"), "confirmed").when(c >= 1.0, "1.0").when(c >= 0.85, "0.85-1").when(c >= 0.5, "0.5-0.85").otherwise("<0.5")
    own = edges.groupBy(P, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return own.unionByName(own.groupBy(P).agg(F.lit("total").alias("bucket"), F.sum("n").alias("n")))


def graph_stats(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(snapshot_id, what, kind, n): symbols and edges by kind."""
    count = lambda df, what: df.groupBy(P, "kind").agg(F.count("*").alias("n")).select(P, F.lit(what).alias("what"), "kind", "n")
    return count(symbols, "symbol").unionByName(count(edges, "edge"))


def with_modules(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with from_module and to_module."""
    side = lambda name: symbols.select(P, F.col("symbol_id").alias(f"{name}_id"), F.col("module").alias(f"{name}_module"))
    return edges.join(side("from"), [P, "from_id"]).join(side("to"), [P, "to_id"])


def module_nodes(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy(P, "module").agg(F.count("*").alias("symbols"), F.count_if("changed").alias("changed_symbols"))


def module_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(snapshot_id, from_module, to_module, n, kinds, rank): dependencies across modules, heaviest first."""
    across = with_modules(edges.where("kind <> 'tests'"), symbols).where("from_module <> to_module")
    by_kind = across.groupBy(P, "from_module", "to_module", "kind").agg(F.count("*").alias("k"))
    out = by_kind.groupBy(P, "from_module", "to_module").agg(
        F.sum("k").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "k")))).alias("kinds")
    )
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(P).orderBy(F.desc("n"), "from_module", "to_module")))


def impacted_modules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Changed modules and those one hop away, either way."""
    changed = nodes.where("changed_symbols > 0").select(P, "module")
    out = edges.join(changed.withColumnRenamed("module", "from_module"), [P, "from_module"]).select(P, F.col("to_module").alias("module"))
    into = edges.join(changed.withColumnRenamed("module", "to_module"), [P, "to_module"]).select(P, F.col("from_module").alias("module"))
    return changed.union(out).union(into).distinct()


def fold_level(edges: DataFrame, symbols: DataFrame, module: str | Column | None = None) -> DataFrame:
    """Edges between the nodes of a level: modules at the root, or the symbols of one module and other modules around it."""
    rows = with_modules(edges, symbols)
    if module is None:
        node = lambda side: F.col(f"{side}_module")
        rows = rows.where("from_module <> to_module")
    else:
        node = lambda side: F.when(F.col(f"{side}_module") == module, F.col(f"{side}_id")).otherwise(F.col(f"{side}_module"))
        rows = rows.where((F.col("from_module") == module) | (F.col("to_module") == module))
    rows = rows.withColumn("a", node("from")).withColumn("b", node("to")).where("a <> b")
    return rows.groupBy(P, "a", "b").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"))


def interface_links(edges: DataFrame, implements: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, via): users of an interface also use its implementations; not through subtyping, not themselves.

    Both sides are made distinct first, so each link arises once and the links themselves are never shuffled. Both are dealt by
    number: few rows can give many links, so partitions are not merged by size."""
    spark = edges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    down = implements.select(P, F.col("interface_id").alias("to_id"), "impl_id").repartition(tasks, "to_id").distinct()
    used = edges.where(~F.col("kind").isin("inherits", "overrides")).select(P, "from_id", "to_id", "kind").distinct().repartition(tasks, "to_id")
    rows = used.join(down, [P, "to_id"]).where("from_id <> impl_id")
    return rows.select(P, "from_id", F.col("impl_id").alias("to_id"), "kind", F.col("to_id").alias("via"))


def follow_link(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_module, to_module, node): the symbol of the target module that most links meet, the least on a tie."""
    rows = with_modules(links, symbols).where("from_module <> to_module").groupBy(P, "from_module", "to_module", "to_id").agg(F.count("*").alias("n"))
    return rows.groupBy(P, "from_module", "to_module").agg(F.min_by("to_id", F.struct(-F.col("n"), F.col("to_id"))).alias("node"))


def impact(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, n, n_untouched): callers of changed symbols, and how many of them are unchanged themselves."""
    target = symbols.where("changed").select(P, F.col("symbol_id").alias("to_id"))
    source = symbols.select(P, F.col("symbol_id").alias("from_id"), F.col("changed").alias("touched"))
    rows = edges.join(target, [P, "to_id"]).select(P, "to_id", "from_id").distinct().join(source, [P, "from_id"])
    return rows.groupBy(P, F.col("to_id").alias("symbol_id")).agg(F.count("*").alias("n"), F.count_if(~F.col("touched")).alias("n_untouched"))


def best_link_per_symbol(edges: DataFrame) -> DataFrame:
    """One link for each (from, to): best confidence, then kind."""
    w = Window.partitionBy(P, "from_id", "to_id").orderBy(F.desc("confidence"), "kind")
    return edges.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rank_neighbours(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Neighbours of each symbol, ranked: changed first, then confidence, then id."""
    side = symbols.select(P, F.col("symbol_id").alias("to_id"), "changed")
    w = Window.partitionBy(P, "from_id").orderBy(F.desc("changed"), F.desc("confidence"), "to_id", "kind")
    return edges.join(side, [P, "to_id"]).select(P, "from_id", "to_id", "kind", "changed", "confidence", F.row_number().over(w).alias("rank"))


def context_top_k(links: DataFrame, k: int) -> DataFrame:
    """The first ``k`` links of each (subject, section) by confidence and id; ``more`` counts the others."""
    part = Window.partitionBy(P, "subject", "section")
    ranked = links.withColumn("rank", F.row_number().over(part.orderBy(F.desc("confidence"), "other")))
    return ranked.withColumn("more", F.greatest(F.count("*").over(part) - k, F.lit(0))).where(F.col("rank") <= k)


def max_children(children: DataFrame, k: int = 12) -> DataFrame:
    """At most ``k`` children of a step: those that reach a change first, then confidence; listed in source order again."""
    part = Window.partitionBy(P, "parent_id")
    kept = children.withColumn("_r", F.row_number().over(part.orderBy(F.desc("reaches"), F.desc("confidence"), "line", "child_id"))).withColumn("truncated", F.greatest(F.count("*").over(part) - k, F.lit(0)))
    return kept.where(F.col("_r") <= k).withColumn("pos", F.row_number().over(part.orderBy("line", "child_id"))).drop("_r")


def stable_symbol_ids(defs: DataFrame) -> DataFrame:
    """Adds symbol_id: path#name, with ``~k`` for the k-th equal one in definition order."""
    base = F.concat_ws("#", "path", "name")
    k = F.row_number().over(Window.partitionBy(P, "path", "name").orderBy("pos"))
    return defs.withColumn("symbol_id", F.when(k == 1, base).otherwise(F.concat(base, F.lit("~"), k)))


def find_symbols(symbols: DataFrame, text: str) -> DataFrame:
    """By exact name, or ``Owner.name`` with the container's name."""
    owner, _, name = text.rpartition(".")
    found = symbols.where(F.col("name") == name)
    if owner:
        own = symbols.where(F.col("name") == owner).select(P, F.col("symbol_id").alias("container_id"))
        found = found.join(own, [P, "container_id"], "left_semi")
    return found


def find_flows(flows: DataFrame, text: str) -> DataFrame:
    """By case-insensitive part of the label, the name or the id."""
    has = lambda c: F.contains(F.lower(F.col(c)), F.lit(text.lower()))
    return flows.where(has("label") | has("name") | has("entry_id"))


def uncertain_edges(edges: DataFrame, symbols: DataFrame, n_edges: int | None = None) -> DataFrame:
    """Calls worth outside evidence: below certainty, with a line, touching a change; one for (from, line, name) by priority.

    ``n_edges``, if known, is the most edges there may be; the tasks follow it."""
    side = lambda c: symbols.select(P, F.col("symbol_id").alias(f"{c}_id"), F.col("changed").alias(f"{c}_changed"), F.col("name").alias(f"{c}_name"))
    rows = spread(edges.where("confidence < 1 AND line > 0"), n_edges, "from_id").join(side("from"), [P, "from_id"])
    rows = spread(rows, n_edges, "to_id").join(side("to"), [P, "to_id"]).where("from_changed OR to_changed")
    priority = F.when(F.col("from_changed") & F.col("to_changed"), 0).when(F.col("to_changed"), 1).otherwise(2)
    w = Window.partitionBy(P, "from_id", "line", "to_name").orderBy("priority", "to_id", "kind")
    rows = spread(rows, n_edges, "from_id", "line", "to_name").withColumn("priority", priority).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return rows.select(P, "from_id", "to_name", "line", "priority")


def test_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """A ``tests`` edge for each call from a test to other code."""
    roles = lambda c: symbols.select(P, F.col("symbol_id").alias(f"{c}_id"), F.col("is_test").alias(f"{c}_test"))
    rows = edges.where("kind = 'calls'").join(roles("from"), [P, "from_id"]).join(roles("to"), [P, "to_id"]).where("from_test AND NOT to_test")
    return rows.select(P, "from_id", "to_id", F.lit("tests").alias("kind"), "confidence", "line")


def reconcile_edges(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, confidence, change): confirmed edges get confidence 1, contradicted ones go, named ones are added."""
    key = [P, "from_id", "to_id", "kind"]
    said = evidence.groupBy(*key).agg(F.bool_or(F.col("verdict") == "confirm").alias("yes"), F.bool_or(F.col("verdict") == "contradict").alias("no"), F.bool_or(F.col("verdict") == "add").alias("new"))
    rows = edges.select(*key, "confidence").join(said, key, "full_outer")
    change = (
        F.when(F.col("confidence").isNull() & (F.col("new") | F.col("yes")), "added").when(F.col("confidence").isNull(), "ignored")
        .when(F.col("yes"), "confirmed").when(F.col("no"), "removed").otherwise("kept")
    )
    rows = rows.withColumn("change", change).where("change <> 'ignored'")
    return rows.withColumn("confidence", F.when(F.col("change").isin("added", "confirmed"), 1.0).when(F.col("change") == "kept", F.col("confidence")))


def ancestors(symbols: DataFrame) -> DataFrame:
    """(symbol_id, ancestor_id, dist) over container_id, level by level up to the outermost container."""
    parent = symbols.where("container_id IS NOT NULL").select(P, F.col("symbol_id").alias("from_id"), F.col("container_id").alias("to_id"))
    out = closure(parent, parent.select(P, F.col("from_id").alias("start_id")), None).where("dist > 0")
    return out.select(P, F.col("start_id").alias("symbol_id"), F.col("node_id").alias("ancestor_id"), "dist")


class _Levels:
    """Stored levels of a traversal. They are only appended; many small ones are written together now and then, so that plans stay short."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, level: DataFrame) -> None:
        self.parts.append(level)
        if len(self.parts) > 24:
            self.parts = [store(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def closure(pairs: DataFrame, start: DataFrame, max_depth: int | None) -> DataFrame:
    """(start_id, node_id, dist): what each start reaches over (from_id, to_id), at the least distance, within ``max_depth`` steps (None: all)."""
    pairs = store(pairs.select(P, "from_id", "to_id").distinct())
    frontier = store(start.select(P, "start_id", F.col("start_id").alias("node_id"), F.lit(0).alias("dist")).distinct())
    seen, dist = _Levels(frontier), 0
    while max_depth is None or dist < max_depth:
        dist += 1
        step = frontier.join(pairs.withColumnRenamed("from_id", "node_id"), [P, "node_id"]).select(P, "start_id", F.col("to_id").alias("node_id")).distinct()
        frontier = store(step.join(seen.all(), [P, "start_id", "node_id"], "left_anti").withColumn("dist", F.lit(dist)))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    return seen.all()


def reach_back(edges: DataFrame, seeds: DataFrame, max_depth: int | None = 12) -> DataFrame:
    """(symbol_id, dist): what leads to a seed within ``max_depth`` steps (None: any number), at the least distance."""
    back = store(edges.select(P, F.col("to_id").alias("symbol_id"), F.col("from_id").alias("next")).distinct())
    frontier = store(seeds.select(P, "symbol_id", F.lit(0).alias("dist")).distinct())
    seen, dist = _Levels(frontier), 0
    while max_depth is None or dist < max_depth:
        dist += 1
        step = frontier.join(back, [P, "symbol_id"]).select(P, F.col("next").alias("symbol_id")).distinct()
        frontier = store(step.join(seen.all(), [P, "symbol_id"], "left_anti").withColumn("dist", F.lit(dist)))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    return seen.all()


def callers(edges: DataFrame, overrides: DataFrame) -> DataFrame:
    """(symbol_id, caller_id, confidence, via): direct callers, and callers of overridden methods at 0.7 times the override's confidence."""
    direct = edges.select(P, F.col("to_id").alias("symbol_id"), F.col("from_id").alias("caller_id"), "confidence", F.lit(None).cast("string").alias("via"))
    over = overrides.select(P, F.col("from_id").alias("symbol_id"), F.col("to_id").alias("via"), F.col("confidence").alias("oc"))
    through = over.join(edges.select(P, F.col("to_id").alias("via"), F.col("from_id").alias("caller_id"), F.col("confidence").alias("cc")), [P, "via"])
    through = through.select(P, "symbol_id", "caller_id", (F.col("cc") * 0.7 * F.col("oc")).alias("confidence"), "via")
    w = Window.partitionBy(P, "symbol_id", "caller_id").orderBy(F.desc("confidence"), F.asc_nulls_first("via"))
    return direct.unionByName(through).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def tests_of(edges: DataFrame, symbols: DataFrame, above: DataFrame) -> DataFrame:
    """(symbol_id, test_id, confidence, line, via): direct tests, and test classes and files of the types around a symbol at half the confidence.

    above: (symbol_id, ancestor_id) as ``ancestors`` gives. One row for a symbol and a test, the surest."""
    tests = edges.where("kind = 'tests'").select(P, "from_id", "to_id", "confidence", "line")
    direct = tests.select(P, F.col("to_id").alias("symbol_id"), F.col("from_id").alias("test_id"), "confidence", "line", F.lit(None).cast("string").alias("via"))
    whole = symbols.where(F.col("kind").isin(*TYPE_KINDS, "file")).select(P, F.col("symbol_id").alias("from_id"))
    types = symbols.where(F.col("kind").isin(*TYPE_KINDS)).select(P, F.col("symbol_id").alias("to_id"))
    around = above.select(P, "symbol_id", F.col("ancestor_id").alias("to_id")).join(types, [P, "to_id"], "left_semi")
    outer = around.join(tests.join(whole, [P, "from_id"], "left_semi"), [P, "to_id"])
    outer = outer.select(P, "symbol_id", F.col("from_id").alias("test_id"), (F.col("confidence") * 0.5).alias("confidence"), "line", F.col("to_id").alias("via"))
    w = Window.partitionBy(P, "symbol_id", "test_id").orderBy(F.desc("confidence"), F.asc_nulls_first("via"), "line")
    return direct.unionByName(outer).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 3, cap: int | None = 3000) -> DataFrame:
    """(symbol_id, dist): undirected expansion by ``hops``; at most ``cap`` symbols a snapshot, nearest first (the feature's own limit; None: all)."""
    # Both directions of a row at once: a union would compute the edges twice.
    there, back = (F.struct(F.col(a).alias("from_id"), F.col(b).alias("to_id")) for a, b in (("from_id", "to_id"), ("to_id", "from_id")))
    both = edges.select(P, F.explode(F.array(there, back)).alias("_e")).select(P, "_e.from_id", "_e.to_id")
    out = reach_back(both, seeds, hops)
    if cap is None:
        return out
    return out.withColumn("_r", F.row_number().over(Window.partitionBy(P).orderBy("dist", "symbol_id"))).where(F.col("_r") <= cap).drop("_r")
