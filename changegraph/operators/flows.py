"""Flows from entry points, and the order of groups of changes.

Edges and symbols meet in joins over the whole graph; only an entry's own bounded
neighbourhood, or a review's own few groups, is ordered inside one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changegraph.operators.graph import P, closure

STEP = "snapshot_id string, entry_id string, step_no long, parent_no long, depth long, symbol_id string, confidence double, repeat boolean"


def flow_neighbourhoods(edges: DataFrame, entries: DataFrame, max_depth: int = 12) -> DataFrame:
    """(entry_id, from_id, to_id, confidence, line): the edges that each entry can reach within ``max_depth`` steps."""
    reach = closure(edges, entries.select(P, F.col("entry_id").alias("start_id")), max_depth)
    near = reach.select(P, F.col("start_id").alias("entry_id"), F.col("node_id").alias("from_id"))
    return edges.join(near, [P, "from_id"]).select(P, "entry_id", "from_id", "to_id", "confidence", "line")


def walk_flows(
    edges: DataFrame, entries: DataFrame, max_depth: int = 12, max_children: int = 12, max_steps: int = 400, least: float = 0.1
) -> DataFrame:
    """The steps of each entry's flow in depth-first order (columns of STEP).

    Children come in source order, at most ``max_children`` of the surest; a path ends below
    ``least`` confidence or at ``max_depth``; a symbol already shown is listed but not
    expanded. The limits are the feature's own and bound an entry's work."""
    from pyspark.sql import Window

    w = Window.partitionBy(P, "entry_id", "from_id").orderBy(F.desc("confidence"), "line", "to_id")
    best = flow_neighbourhoods(edges.where("from_id <> to_id"), entries, max_depth).groupBy(P, "entry_id", "from_id", "to_id").agg(F.max("confidence").alias("confidence"), F.min("line").alias("line"))
    kept = best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_children).drop("_r")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        part, entry = pdf[P].iloc[0], pdf["entry_id"].iloc[0]
        children: dict[str, list] = {}
        for r in pdf.sort_values(["line", "to_id"]).itertuples():
            children.setdefault(r.from_id, []).append((r.to_id, r.confidence))
        out, seen, stack = [], set(), [(entry, 1.0, 0, -1)]
        while stack and len(out) < max_steps:
            symbol, sure, depth, parent = stack.pop()
            again = symbol in seen
            number = len(out)
            out.append((part, entry, number, parent, depth, symbol, sure, again))
            if again or depth >= max_depth:
                continue
            seen.add(symbol)
            for to, c in reversed(children.get(symbol, [])):
                if sure * c >= least:
                    stack.append((to, sure * c, depth + 1, number))
        return pd.DataFrame(out, columns=[P, "entry_id", "step_no", "parent_no", "depth", "symbol_id", "confidence", "repeat"])

    return kept.groupBy(P, "entry_id").applyInPandas(walk, STEP)


def impacted_flows(steps: DataFrame, symbols: DataFrame) -> DataFrame:
    """(entry_id, steps, changed_steps, confidence) of flows with a changed step; the best path's confidence."""
    changed = symbols.where("changed").select(P, "symbol_id").withColumn("_changed", F.lit(True))
    rows = steps.join(changed, [P, "symbol_id"], "left")
    out = rows.groupBy(P, "entry_id").agg(F.count("*").alias("steps"), F.count_if("_changed").alias("changed_steps"), F.max(F.when(F.col("_changed"), F.col("confidence"))).alias("confidence"))
    return out.where("changed_steps > 0")


def compare_flows(before: DataFrame, after: DataFrame) -> DataFrame:
    """(snapshot_id, entry_id, status, added, removed): flows that are new, removed, changed or same between two lists of steps."""
    own = lambda df, name: df.select(P, "entry_id", "symbol_id").distinct().withColumn(name, F.lit(True))
    rows = own(before, "_b").join(own(after, "_a"), [P, "entry_id", "symbol_id"], "full_outer")
    out = rows.groupBy(P, "entry_id").agg(
        F.count_if("_b").alias("_nb"), F.count_if("_a").alias("_na"), F.count_if(F.col("_b").isNull()).alias("added"), F.count_if(F.col("_a").isNull()).alias("removed")
    )
    status = F.when(F.col("_nb") == 0, "new").when(F.col("_na") == 0, "removed").when((F.col("added") > 0) | (F.col("removed") > 0), "changed").otherwise("same")
    return out.select(P, "entry_id", status.alias("status"), "added", "removed")


def group_edges(members: DataFrame, edges: DataFrame, least: float = 0.3) -> DataFrame:
    """(review_id, a, b): group a depends on group b through the symbols of their hunks. members: (snapshot_id, review_id, group_id, symbol_id)."""
    side = lambda name, key: members.select(P, "review_id", F.col("group_id").alias(name), F.col("symbol_id").alias(key)).distinct()
    rows = edges.where(F.col("confidence") >= least).join(side("a", "from_id"), [P, "from_id"]).join(side("b", "to_id"), [P, "review_id", "to_id"])
    return rows.where("a <> b").select("review_id", "a", "b").distinct()


def order_groups(groups: DataFrame, depends: DataFrame) -> DataFrame:
    """(review_id, group_id, position): what a group depends on comes first; cycles count as one; then (mechanical, rank, ord).

    groups: (review_id, group_id, mechanical, rank, ord); depends: (review_id, a, b). A review
    has few groups, so its small graph is ordered in one task."""
    lists = depends.groupBy("review_id", F.col("a").alias("group_id")).agg(F.sort_array(F.collect_set("b")).alias("needs"))
    rows = groups.join(lists, ["review_id", "group_id"], "left")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["group_id"].tolist()
        needs = {i: {int(x) for x in n if x in set(ids)} if n is not None else set() for i, n in zip(ids, pdf["needs"])}
        reach = {i: set(needs[i]) for i in ids}
        changed = True
        while changed:
            changed = False
            for i in ids:
                more = set().union(*(reach[j] for j in reach[i])) - reach[i] if reach[i] else set()
                if more:
                    reach[i] |= more
                    changed = True
        key = {r.group_id: (bool(r.mechanical), int(r.rank), int(r.ord)) for r in pdf.itertuples()}
        cycle = {i: min([j for j in reach[i] if i in reach[j]] + [i], key=lambda j: key[j]) for i in ids}
        left, out = set(ids), []
        while left:
            ready = [i for i in left if not any(cycle[j] != cycle[i] and j in left for j in reach[i])]
            first = cycle[min(ready, key=lambda i: key[cycle[i]])]
            own = sorted((i for i in left if cycle[i] == first), key=lambda i: key[i])
            out += own
            left -= set(own)
        return pd.DataFrame({"review_id": pdf["review_id"].iloc[0], "group_id": out, "position": range(1, len(out) + 1)})

    return rows.groupBy("review_id").applyInPandas(order, "review_id string, group_id long, position long")
