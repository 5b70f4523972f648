"""Queries without SQL against brute force over all rows of a small table."""

import collections

import pytest

import __spark_entry__ as entry
from changegraph.plans import queries as q
from changegraph.plans import views as v
from changegraph.sources import facts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    symbols = {r.symbol_id: r for r in v.symbols(spark, SF).collect()}
    return symbols, v.edges(spark, SF).collect()


def reached(starts, next_of, depth):
    dist = dict.fromkeys(starts, 0)
    level = list(dist)
    for k in range(1, depth + 1):
        level = {n for x in level for n in next_of[x]} - set(dist)
        dist |= dict.fromkeys(level, k)
    return dist


def links(pairs, back=False):
    out = collections.defaultdict(set)
    for a, b in pairs:
        out[b if back else a].add(a if back else b)
    return out


def test_nation_closure_uses_all_edges(spark, data):
    symbols, edges = data
    pairs = {(symbols[e.from_id].module, symbols[e.to_id].module) for e in edges}
    pairs = {(a, b) for a, b in pairs if a != b}
    want = {(a, n, d) for a in {a for a, _ in pairs} for n, d in reached([a], links(pairs), 6).items()}
    assert {(r.start_id, r.node_id, r.dist) for r in entry.queries()["nation_closure"](spark, SF).collect()} == want


def test_traversals_start_at_all_changed_symbols(spark, data):
    symbols, edges = data
    pairs = {(e.from_id, e.to_id) for e in edges}
    changed = [s for s, r in symbols.items() if r.changed]
    assert {(r.symbol_id, r.dist) for r in q.reach_back(spark, SF).collect()} == set(reached(changed, links(pairs, back=True), 12).items())
    both = links(pairs | {(b, a) for a, b in pairs})
    assert {(r.symbol_id, r.dist) for r in q.neighbourhood_all(spark, SF).collect()} == set(reached(changed, both, 3).items())


def test_impacted_modules_of_all_modules(spark, data):
    symbols, edges = data
    changed = {r.module for r in symbols.values() if r.changed}
    pairs = {(symbols[e.from_id].module, symbols[e.to_id].module) for e in edges}
    want = changed | {b for a, b in pairs if a in changed} | {a for a, b in pairs if b in changed}
    assert sorted(r.module for r in q.impacted_modules_all(spark, SF).collect()) == sorted(want)


def test_evidence_of_all_line_items(spark, data):
    customer = {r.o_orderkey: r.o_custkey for r in v.table(spark, SF, "orders").collect()}
    said = collections.defaultdict(set)
    for r in v.table(spark, SF, "lineitem").collect():
        kind = "calls" if r.l_returnflag == "R" else "uses"
        verdict = "confirm" if r.l_tax < 0.02 else "contradict" if r.l_tax < 0.05 else "add"
        said[f"c{customer[r.l_orderkey]}", f"s{r.l_suppkey}", kind].add(verdict)
    known = {(e.from_id, e.to_id, e.kind) for e in data[1]}
    want = {k: "confirmed" if "confirm" in said[k] else "removed" if "contradict" in said[k] else "kept" for k in known}
    want |= {k: "added" for k, x in said.items() if k not in known and x & {"add", "confirm"}}
    assert {(r.from_id, r.to_id, r.kind): r.change for r in q.reconcile_edges_all(spark, SF).collect()} == want


def test_json_leaves_of_every_depth(spark):
    text = '{"a": 1, "b": {"c": {"d": {"e": {"f": {"g": "deep"}, "h": 2}}}}, "i": {}}'
    rows = spark.createDataFrame([(1, text), (2, "{}"), (3, None)], "id long, props string")
    got = {(r.id, r.key, r.value) for r in facts.json_keys(rows, "id", "props").collect()}
    assert got == {(1, "a", "1"), (1, "b.c.d.e.f.g", "deep"), (1, "b.c.d.e.h", "2")}
