"""Cases of the third review that failed before."""

import re

from pyspark.sql import functions as F

from changegraph.operators import graph as g
from changegraph.operators import matching as m
from changegraph.operators import names
from changegraph.operators import resolution as rs
from changegraph.operators import walks
from changegraph.plans import queries as q


def test_interface_links_are_not_made_distinct_after_the_join(spark, capsys):
    e = spark.createDataFrame([("s", "a", "i", "calls"), ("s", "a", "i", "calls"), ("s", "x", "i", "uses"), ("s", "b", "i", "inherits")], "snapshot_id string, from_id string, to_id string, kind string")
    i = spark.createDataFrame([("s", "i", "x"), ("s", "i", "x"), ("s", "i", "y")], "snapshot_id string, interface_id string, impl_id string")
    links = g.interface_links(e, i)
    got = sorted((r.from_id, r.to_id, r.kind, r.via) for r in links.collect())
    assert got == [("a", "x", "calls", "i"), ("a", "y", "calls", "i"), ("x", "y", "uses", "i")]
    links.explain()
    plan = capsys.readouterr().out
    assert "Join" in plan and "Aggregate" not in plan[: plan.index("Join")]


def test_interface_links_are_dealt_by_number(spark):
    """Few rows can give many links, so the partitions of small sides are not merged."""
    e = spark.createDataFrame([("s", f"a{i}", f"i{i % 9}", "calls") for i in range(90)], "snapshot_id string, from_id string, to_id string, kind string")
    i = spark.createDataFrame([("s", f"i{k % 9}", f"x{k}") for k in range(45)], "snapshot_id string, interface_id string, impl_id string")
    links = g.interface_links(e, i)
    assert links.count() == 450 and links.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism


def test_innermost_span_rounds_seconds_as_its_sql_does(spark, tmp_path):
    rows = [(40, "2024-01-01 00:01:00", 1, "view"), (1, "2024-01-01 00:00:59.6", 1, "purchase"), (2, "2024-01-01 00:00:59.4", 1, "purchase"), (3, "2024-01-01 00:00:59.5", 1, "purchase"), (4, "2024-01-01 00:00:58.5", 1, "purchase")]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    assert sorted((r.point_id, r.span_id) for r in q.innermost_span(spark, str(tmp_path)).collect()) == [(1, 40), (3, 40)]


def crowded(spark):
    """Two references to a name of eight types in their file, one to a name of eight in their package, one to a name of one type."""
    types = [(f"t{i}", "Many", "class", "f", "q") for i in range(8)] + [(f"u{i}", "Full", "class", f"g{i}", "p") for i in range(8)] + [("one", "One", "class", "h", "p")]
    symbols = spark.createDataFrame([("s", *t) for t in types], "snapshot_id string, symbol_id string, name string, kind string, file string, package string")
    refs = spark.createDataFrame([("s", 1, "f", "p", "Many"), ("s", 2, "f", "p", "Many"), ("s", 3, "f", "p", "Full"), ("s", 4, "f", "p", "One"), ("s", 5, "f", "p", "One")], "snapshot_id string, ref_id long, file string, package string, name string")
    imports = spark.createDataFrame([], "snapshot_id string, file string, name string, package string")
    return refs, symbols, imports, imports.select("snapshot_id", "file", "package")


def test_names_are_looked_up_once_a_file_and_crowded_ones_not_joined(spark):
    refs, symbols, imports, wild = crowded(spark)
    asks, of = names.questions(refs)
    assert asks.count() == 3 and of.count() == 5
    near = names.by_tiers(asks, names.qualified_names(symbols), imports, wild, most=5)
    assert sorted(r["count"] for r in near.groupBy("ref_id").count().collect()) == [1, 6, 6]
    got = rs.resolve_types(refs, symbols, imports, wild).collect()
    assert sorted((r.ref_id, r.symbol_id, r.confidence, r.tier) for r in got) == [(4, "one", 0.9, 2), (5, "one", 0.9, 2)]
    assert rs.resolve_types(refs, symbols, imports, wild, most=None).count() == 26


def test_resolve_names_tells_crowded_names_by_one_candidate_too_many(spark):
    refs, symbols, imports, wild = crowded(spark)
    got = m.resolve_names(refs, symbols, imports, wild)
    assert sorted((r.ref_id, r.symbol_id, r.confidence, r.tier) for r in got.collect()) == [(4, "one", 0.9, 2), (5, "one", 0.9, 2)]
    assert names.one_too_many(symbols, 5, "file", "name").groupBy("file", "name").count().agg(F.max("count")).first()[0] == 6


def test_constructors_are_counted_by_kind_and_not_joined(spark, monkeypatch):
    """Eight types of a name in a file with a constructor each, of which two take two arguments: those two are left."""
    refs, symbols, imports, wild = crowded(spark)
    symbols = symbols.withColumns({"container_id": F.col("file"), "params": F.lit(None).cast("long"), "variadic": F.lit(False)})
    made = symbols.where("name = 'Many'").select("snapshot_id", F.concat(F.lit("k"), "symbol_id").alias("symbol_id"), "name", F.lit("constructor").alias("kind"), "file", "package", F.col("symbol_id").alias("container_id"), F.when(F.col("symbol_id") < "t2", 2).otherwise(1).cast("long").alias("params"), "variadic")
    plain = symbols.where("name = 'Full'").withColumn("params", F.lit(2).cast("long"))
    symbols = made.unionByName(symbols.where("name <> 'Full'")).unionByName(plain)
    refs = refs.withColumns({"arity": F.lit(2).cast("long"), "lang": F.lit("java")})
    stored = []
    monkeypatch.setattr(rs, "store", lambda df: stored.append(df) or g.store(df))
    got = rs.resolve_constructors(refs, symbols, imports, wild).collect()
    # The types without a fitting constructor still take any number, so there are eight options; only ``One`` is left.
    assert sorted((r.ref_id, r.symbol_id) for r in got) == [(4, "one"), (5, "one")]
    ones = symbols.withColumn("params", F.when(F.col("kind") == "class", F.lit(9)).otherwise(F.col("params")))
    got = rs.resolve_constructors(refs, ones, imports, wild).collect()
    assert sorted((r.ref_id, r.symbol_id, round(r.confidence, 6)) for r in got) == [(i, f"kt{j}", 0.25) for i in (1, 2) for j in (0, 1)]
    # Nothing that is stored grows with the references.
    stored.clear()
    many = refs.crossJoin(spark.range(50)).withColumn("ref_id", F.col("ref_id") * 100 + F.col("id")).drop("id")
    assert rs.resolve_constructors(many, ones, imports, wild).count() == 200
    assert max(df.count() for df in stored) <= 25


def test_walks_ask_only_for_symbols_that_they_meet(spark, monkeypatch):
    """Of 30 chains only the first is walked to its end: what lies further on the others is never sent to a walk."""
    names = [f"c{i:02}" for i in range(30)]
    symbols = [("s", n, n, "function", None, "f", 1, False, False, [], {}) for n in ["e", *names, *[f"d{n}" for n in names]]]
    symbols = spark.createDataFrame(symbols, "snapshot_id string, symbol_id string, name string, kind string, container_id string, file string, line int, changed boolean, removed boolean, roles array<string>, tags map<string,string>")
    edges = spark.createDataFrame([("s", "e", n, "calls", 1.0, i) for i, n in enumerate(names)] + [("s", n, f"d{n}", "calls", 1.0, 1) for n in names], "snapshot_id string, from_id string, to_id string, kind string, confidence double, line int")
    around = walks.enclosing_types(symbols)
    entries = symbols.where("symbol_id = 'e'").select("snapshot_id", F.col("symbol_id").alias("entry_id"))
    none = symbols.where("false").select("snapshot_id", "symbol_id")
    seen = []
    monkeypatch.setattr(walks, "store", lambda df: seen.append(df) or g.store(df))
    monkeypatch.setattr(walks, "ASK_AT_ONCE", 2)
    out = walks.walk_trees(walks.flow_children(symbols, edges, around), walks.step_attributes(symbols, edges, around), entries, none, max_children=30, max_steps=4, prune=False)
    got = [r.symbol_id for r in out.orderBy("step_no").collect()]
    assert got == ["e", "c00", "dc00", *names[1:]]
    asked = {r["from_id"] for df in seen if df.columns == ["snapshot_id", "_g", "from_id"] for r in df.collect()}
    assert asked == {"e", *names, "dc00"}


def test_nation_closure_reads_the_merged_edges_once(spark, monkeypatch):
    given = []
    monkeypatch.setattr(g, "closure", lambda pairs, start, depth: given.extend([pairs, start]) or pairs)
    q.nation_closure(spark, "/root/testdata/sf0.001")
    assert len(given) == 2 and not any(df.inputFiles() for df in given)


def test_neighbourhood_computes_the_edges_once(spark, monkeypatch, tmp_path):
    spark.createDataFrame([("s", "a", "b"), ("s", "b", "c")], "snapshot_id string, from_id string, to_id string").write.parquet(f"{tmp_path}/e")
    edges, seeds = spark.read.parquet(f"{tmp_path}/e"), spark.createDataFrame([("s", "c")], "snapshot_id string, symbol_id string")
    assert sorted((r.symbol_id, r.dist) for r in g.neighbourhood(edges, seeds, cap=None).collect()) == [("a", 2), ("b", 1), ("c", 0)]
    given = []
    monkeypatch.setattr(g, "reach_back", lambda pairs, *a: given.append(pairs) or pairs)
    g.neighbourhood(edges, seeds, cap=None)
    assert given[0]._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_tasks_of_merged_edges_follow_the_input(spark, monkeypatch):
    """Every exchange of edges has as many tasks as the line items ask for, and the rows stay the same."""
    d = "/root/testdata/sf0.001"
    for query in (q.merge_edges, q.best_link_per_symbol, q.confidence_buckets, q.max_children, q.uncertain_edges):
        want = sorted(map(str, query(spark, d).collect()))
        with monkeypatch.context() as m_:
            m_.setattr(g, "TASK_ROWS", 500)
            out = query(spark, d)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, out.collect())) == want
        sizes = re.findall(r"hashpartitioning\(.*, (\d+)\)", plan)
        # Only the few counts by bucket go through the session's four.
        assert len(sizes) >= 3 and sizes.count("4") == (3 if query is q.confidence_buckets else 0), query.__name__
