"""Small operators and expressions, each on a few rows."""

from pyspark.sql import functions as F

from changegraph.functions import text as ft
from changegraph.operators import graph as g
from changegraph.operators import lines as ln
from changegraph.operators import matching as m
from changegraph.operators import resolution as rs
from changegraph.operators import rules
from changegraph.sources import diffs, facts
from tests.test_operators import rows


def test_sources_and_results(spark, tmp_path):
    df = spark.createDataFrame
    tree = df([("s", "a.java", 10), ("s", "b.java", 10**7), ("s", "c.unknown", 1), ("s", "gen/d.java", 1)], "snapshot_id string, path string, size long")
    kept, skipped = facts.select_sources(tree, skip=("gen/**",))
    assert rows(kept, "path") == [("a.java",)] and rows(skipped, "reason", "n") == [("glob", 1), ("language", 1), ("size", 1)]
    paths = df([("x", "b1", "java"), ("y", "b1", "java"), ("z", "b2", "java")], "path string, blob string, lang string")
    assert rows(facts.fan_out(paths, df([("b1", "java", 7)], "blob string, lang string, n int")), "path", "n") == [("x", 7), ("y", 7)]
    assert rows(facts.union_snapshots(paths, paths.limit(1), "other").where("path LIKE 'other/%'"), "path") == [("other/x",)]
    files = df([("r", 1, None, "p", "added"), ("r", 2, "o", "p", "renamed"), ("r", 3, "o", "p", "renamed")], "review_id string, file_id int, old_path string, path string, status string")
    keys = {r.file_id: r.file_key for r in diffs.file_key(files).collect()}
    assert keys[1] != keys[2] == keys[3]
    one, two = (facts.result_key(d, "blob", "path", "lang", params="v1") for d in (paths, paths.orderBy(F.desc("path"))))
    assert rows(one) == rows(two) and one.exceptAll(facts.result_key(paths, "blob", "path", "lang", params="v2")).count() == 2
    assert rows(facts.stale_results(one, two.where("blob = 'b1'"), "blob"), "blob") == [("b2",)]
    facts.write_result(paths, str(tmp_path / "out"), partition_by=("blob",))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_line_operators(spark):
    hunks = spark.createDataFrame([(1, True, True, "imports"), (2, False, True, "renamed"), (3, False, False, "renamed"), (4, False, False, None)], "hunk_id int, is_generated boolean, whitespace_only boolean, rename_class string")
    assert rows(ln.mechanical_kind(hunks), "hunk_id", "mechanical") == [(1, "generated"), (2, "whitespace"), (3, "renamed"), (4, None)]
    lines = spark.createDataFrame([("r", "p", "removed", 3, None, 0), ("r", "p", "added", None, 3, 1), ("r", "p", "context", 4, 4, 2)], "review_id string, path string, kind string, old_line int, new_line int, idx int")
    positions = spark.createDataFrame([("r", "a", "p", 3, None), ("r", "b", "p", None, 3), ("r", "c", "p", 4, 4), ("r", "d", "p", 4, None), ("r", "e", "q", 3, 3)], "review_id string, position_id string, path string, old_line int, new_line int")
    assert rows(m.locate_positions(positions, lines), "position_id", "idx") == [("a", 0), ("b", 1), ("c", 2), ("d", None), ("e", None)]


def test_symbols_and_visible_types(spark):
    df = lambda data, schema: spark.createDataFrame([("s", *r) for r in data], f"snapshot_id string, {schema}")
    symbols = df([("A", "Owner", "class", "f", "p", None), ("A.m", "find", "method", "f", "p", "A"), ("B", "Pet", "class", "g", "p", None), ("B.m", "find", "method", "g", "p", "B"), ("C", "Far", "class", "h", "q", None)], "symbol_id string, name string, kind string, file string, package string, container_id string")
    assert rows(g.find_symbols(symbols, "find"), "symbol_id") == [("A.m",), ("B.m",)] and rows(g.find_symbols(symbols, "Pet.find"), "symbol_id") == [("B.m",)]
    files = df([("f", "p"), ("h", "q"), ("z", None)], "file string, package string")
    seen = rs.visible_types(files, symbols, df([("z", "q", "Far")], "file string, package string, name string"), df([("h", "p")], "file string, package string"))
    assert rows(seen, "file", "type_id") == [("f", "A"), ("f", "B"), ("g", "B"), ("h", "A"), ("h", "B"), ("h", "C"), ("z", "C")]
    external = rs.inheritance_edges(df([("r", "f", "p", "extends", "Gone", "A", 1), ("q", "f", "p", "extends", "Pet", "A", 1)], "ref_id string, file string, package string, kind string, name string, scope_id string, line int"), symbols, df([], "file string, package string, name string"), df([], "file string, package string"))[1]
    assert rows(external, "symbol_id") == [("A",)]


def test_methods_of_frequent_names_are_found_either_way(spark):
    df = lambda data, schema: spark.createDataFrame([("s", *r) for r in data], f"snapshot_id string, {schema}")
    methods = [(f"T{i}.pay", "pay", "method", f"T{i}", i % 4, False, i % 5 == 0) for i in range(120)]
    symbols = df(methods, "symbol_id string, name string, kind string, container_id string, params int, variadic boolean, is_test boolean")
    refs = df([(f"r{a}{t}{lang}", f"f{a}", "pay", a, lang, t) for a in range(5) for t in (True, False) for lang in ("java", "kotlin")], "ref_id string, file string, name string, arity int, lang string, is_test boolean")
    visible = df([(f"f{a}", f"T{i}") for a in range(5) for i in range(a, 120, 17)], "file string, type_id string")
    want = []
    for a in range(5):
        for t in (True, False):
            for lang in ("java", "kotlin"):
                pool = [x for x in methods if t or not x[6]]
                left = [x for x in pool if x[4] == a] or [x for x in pool if lang != "java" and x[4] > a]
                near = [x for x in left if int(x[3][1:]) in range(a, 120, 17)]
                few = near or (left if len(left) <= 2 else [])
                want += [(f"r{a}{t}{lang}", x[0], round((0.5 if near else 0.3) / len(few), 9)) for x in few]
    for often in (1, 1000):
        got = rs.unknown_receivers(refs, symbols, visible, often=often)
        assert sorted((r.ref_id, r.symbol_id, round(r.confidence, 9)) for r in got.collect()) == sorted(want)


def test_rules_and_tests_by_name(spark):
    df = lambda data, schema: spark.createDataFrame([("s", *r) for r in data], f"snapshot_id string, {schema}")
    tags = df([("a", "k", "v")], "symbol_id string, key string, value string")
    assert rules.merge_tags(tags, tags, tags.withColumn("value", F.lit("w"))).count() == 2

    class Adds:
        name = "adds"

        def apply(self, known, graph):
            n = graph["tags"].count() if "tags" in graph else 0
            return rules.RuleOutput(tags=known["base"].withColumn("value", F.lit(f"v{n}")))

    assert rows(rules.apply_rules([Adds(), Adds()], {"base": tags}, {})["tags"], "value") == [("v0",), ("v1",)]
    named = rules.test_naming_edges(df([("T", "p", "OwnerTests"), ("U", "q", "OwnerIT"), ("V", "p", "Test")], "symbol_id string, package string, name string"), df([("O", "p", "Owner")], "symbol_id string, package string, name string"))
    assert rows(named, "from_id", "to_id", "confidence") == [("T", "O", 0.8)]
    files = df([("a/x.spec.ts", True), ("a/y.test.tsx", True), ("a/x.ts", False), ("a/z.spec.ts", False)], "path string, is_test boolean")
    symbols = df([("X", "class", "a/x.ts", "a/x.ts"), ("X.f", "method", "a/x.ts", "X"), ("y", "function", "a/y.tsx", None), ("v", "variable", "a/x.ts", None)], "symbol_id string, kind string, file string, container_id string")
    assert rows(rules.test_file_edges(files, symbols), "from_id", "to_id") == [("a/x.spec.ts", "X"), ("a/y.test.tsx", "y")]


def test_text_expressions(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert [one(ft.unquote, x) for x in ('"a"', "'b'", "`c`", "\"d'", "e", '""')] == ["a", "b", "c", "\"d'", "e", ""]
    assert one(ft.string_literals, 'f("a", x + "b c", "")') == ["a", "b c", ""]
    assert [one(ft.decapitalize, x) for x in ("OwnerService", "URLService", "x", "")] == ["ownerService", "URLService", "x", ""]
    assert [one(ft.extract_json, x) for x in ('say: {"a": {"b": 1}} done', "{no", "none")] == ['{"a": {"b": 1}}', None, None]
    assert [one(ft.tolerant_id, x) for x in ("12", '"h12"', "#7", "x y")] == [12, 12, 7, None]
