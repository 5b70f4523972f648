"""Operators on small tables with results worked out by hand."""

from pyspark.sql import functions as F

from changegraph.functions import paths as fp
from changegraph.functions import text as ft
from changegraph.operators import flows, graph, groups, lines, matching, rules
from changegraph.sources import diffs, discussions, facts

DIFF = """diff --git a/src/a.txt b/src/a.txt
index 1..2 100644
--- a/src/a.txt
+++ b/src/a.txt
@@ -1,3 +1,3 @@ head
 one
--- two
+two
 three
\\ No newline at end of file
@@ -9 +9,0 @@
-gone
diff --git a/old name b/new name
similarity index 90%
rename from old name
rename to new name
diff --git a/x.bin b/x.bin
new file mode 100644
Binary files /dev/null and b/x.bin differ
"""


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_unified_diffs(spark):
    raw = spark.createDataFrame([("r", DIFF), ("bad", "diff --git a/a b/a\n@@ -1,1 +1,1 @@\n*x\n"), ("lost", "@@ -1 +1 @@\n-a\n+b\n")], "review_id string, raw string")
    files, hunks, body, errors = diffs.read_unified_diffs(raw)
    assert rows(files, "path", "old_path", "status", "binary", "similarity") == [("new name", "old name", "renamed", False, 90), ("src/a.txt", "src/a.txt", "modified", False, None), ("x.bin", None, "added", True, None)]
    assert rows(hunks, "hunk_id", "old.start", "old.len", "new.start", "new.len", "section") == [(1, 1, 3, 1, 3, "head"), (2, 9, 1, 9, 0, "")]
    assert rows(body, "hunk_id", "idx", "kind", "old_line", "new_line", "text", "no_newline") == [
        (1, 0, "context", 1, 1, "one", False), (1, 1, "removed", 2, None, "-- two", False), (1, 2, "added", None, 2, "two", False),
        (1, 3, "context", 3, 3, "three", True), (2, 0, "removed", 9, None, "gone", False),
    ]
    assert {r.review_id for r in errors.collect()} == {"bad", "lost"}
    assert rows(diffs.hunkless_files(files, hunks), "path") == [("new name",), ("x.bin",)]


def test_overlay_and_renames(spark):
    head = spark.createDataFrame([("r", "f", 1, "a"), ("r", "f", 2, "B"), ("r", "f", 3, "c")], "review_id string, path string, new_line int, text string")
    body = spark.createDataFrame([("r", "f", 1, "removed", 2, None, 2, "b"), ("r", "f", 2, "added", None, 2, None, "B")], "review_id string, path string, idx int, kind string, old_line int, new_line int, before int, text string")
    assert rows(lines.overlay_file(head, body), "pos", "old_line", "new_line", "kind", "text") == [(1, 1, 1, "context", "a"), (2, 2, None, "removed", "b"), (3, None, 2, "added", "B"), (4, 3, 3, "context", "c")]
    hunk = spark.createDataFrame([("r", 1, 0, "removed", 'foo(x, "s")', False), ("r", 1, 1, "added", 'bar(x, "s")', False), ("r", 2, 0, "removed", "a + a", False), ("r", 2, 1, "added", "b + c", False)], "review_id string, hunk_id int, idx int, kind string, text string, is_import boolean")
    got = groups.rename_shape(hunk).collect()
    assert [(r.hunk_id, [tuple(p) for p in r.pairs], r.imports_only) for r in got] == [(1, [("foo", "bar")], False)]


def test_paths_and_texts(spark):
    df = spark.createDataFrame([("m/src/test/java/a/FooTest.java",), ("web/app.spec.ts",), ("IT.java",), ("README",)], "p string")
    p = F.col("p")
    assert rows(df.select(fp.is_test_path(p), fp.language(p), fp.directory(p))) == sorted([(True, "java", "m/src/test/java/a"), (True, "typescript", "web"), (False, "java", "."), (False, None, ".")], key=str)
    assert fp.glob_pattern("**/dist/**") == "^(.*/)?dist/.*$"
    one = spark.createDataFrame([("spring.my-Key[0]", "${a.b:x}-${c}", "http://h/x/{id}/:n?q#f", ' "h12" ')], "k string, e string, u string, i string")
    assert one.select(ft.relaxed_key(F.col("k")), ft.placeholders(F.col("e")), ft.url_segments(F.col("u")), ft.tolerant_id(F.col("i"))).first() == ("spring.mykey", ["a.b", "c"], ["x", "{}", "{}"], 12)


def test_configuration_and_elements(spark):
    files = spark.createDataFrame([("f", "a:\n  b: 1 # x\n  list:\n    - name: 'q'\n  text: |\n    skipped words\n---\nz: 2\n")], "file string, text string")
    assert rows(facts.yaml_keys(files), "key", "value", "line") == [("a.b", "1", 2), ("a.list.name", "q", 4), ("a.text", None, 5), ("z", "2", 8)]
    props = spark.createDataFrame([("f", "# c\na.b = 1\nc:2\n\n")], "file string, text string")
    assert rows(facts.properties_keys(props), "key", "value", "line") == [("a.b", "1", 2), ("c", "2", 3)]
    uses = spark.createDataFrame([("s", "S", "a", True, "m"), ("s", "T", "a.b", False, "other")], "snapshot_id string, symbol string, key string, is_prefix boolean, module string")
    config = spark.createDataFrame([("s", "f", "m", "a.b", 2), ("s", "f", "m", "a.c", 1)], "snapshot_id string, file string, module string, key string, line int")
    assert rows(matching.bind_config_keys(uses, config), "symbol", "key", "confidence") == [("S", "a.c", 0.9), ("T", "a.b", 0.6)]


def test_fact_tables_from_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"snapshot_id":"s","path":"p","defs":[{"name":"A","kind":"class","span":{"start":1,"end":3},"line":1}],"refs":[]}')
    tables = facts.read_fact_tables(spark, str(tmp_path))
    assert rows(tables["defs"], "path", "pos", "name", "span.end") == [("p", 0, "A", 3)] and tables["refs"].count() == 0


def test_discussions(spark):
    thread = '{"id":"t1","path":"f","side":"LEFT","old_line":3,"new_line":4,"outdated":false,"notes":[{"id":1,"body":"x","author":"a","created_at":"2024-01-02T00:00:00Z","system":false,"resolvable":true,"resolved":true}]}'
    comment = '{"id":7,"body":"hello","author":"b","created_at":"2024-01-01T00:00:00Z"}'
    df = lambda *b: spark.createDataFrame([("r", x) for x in b], "review_id string, body string")
    found, notes = discussions.read_discussions(df(thread), df(comment, '{"id":8,"body":" "}'), df('{"id":9,"body":"p","state":"PENDING"}'))
    assert rows(found, "discussion_id", "old_line", "new_line") == [("general:7", None, None), ("t1", 3, None)]
    assert rows(discussions.discussion_flags(notes), "discussion_id", "system", "resolvable", "resolved") == [("general:7", False, False, False), ("t1", False, True, True)]


def test_flows_and_group_order(spark):
    edges = spark.createDataFrame([("s", "e", "a", 1.0, 1), ("s", "e", "b", 0.5, 2), ("s", "a", "c", 1.0, 1), ("s", "c", "a", 1.0, 1), ("s", "b", "d", 0.1, 1)], "snapshot_id string, from_id string, to_id string, confidence double, line int")
    steps = flows.walk_flows(edges, spark.createDataFrame([("s", "e")], "snapshot_id string, entry_id string"))
    assert rows(steps, "step_no", "parent_no", "symbol_id", "repeat") == [(0, -1, "e", False), (1, 0, "a", False), (2, 1, "c", False), (3, 2, "a", True), (4, 0, "b", False)]
    symbols = spark.createDataFrame([("s", "c", True)], "snapshot_id string, symbol_id string, changed boolean")
    assert rows(flows.impacted_flows(steps, symbols), "entry_id", "changed_steps") == [("e", 1)]
    after = steps.where("symbol_id <> 'b'")
    assert rows(flows.compare_flows(steps, after)) == [("s", "e", "changed", 0, 1)]
    members = spark.createDataFrame([("s", "r", 1, "e"), ("s", "r", 2, "a"), ("s", "r", 3, "d"), ("t", "q", 1, "e"), ("t", "q", 2, "a")], "snapshot_id string, review_id string, group_id long, symbol_id string")
    own = spark.createDataFrame([("r", 1, False, 2, 1), ("r", 2, False, 1, 2), ("r", 3, True, 0, 3)], "review_id string, group_id long, mechanical boolean, rank int, ord int")
    assert rows(flows.order_groups(own, flows.group_edges(members, edges)), "group_id", "position") == [(1, 2), (2, 1), (3, 3)]


def test_rules(spark):
    defs = spark.createDataFrame(
        [("s", "C", "class", None, [("RestController", []), ("RequestMapping", [(None, "/api")])]), ("s", "m", "method", "C", [("GetMapping", [("value", "/x/")])]), ("s", "k", "method", "C", [("KafkaListener", [("topics", "t")])])],
        "snapshot_id string, symbol_id string, kind string, parent_id string, annotations array<struct<name:string,args:array<struct<key:string,value:string>>>>",
    )
    assert rows(rules.assign_roles(defs)) == [("s", "C", "controller")]
    assert rows(rules.endpoint_routes(defs), "symbol_id", "method", "route") == [("m", "GET", "/api/x")]
    assert rows(rules.entry_points(defs), "symbol_id", "entry_kind", "target") == [("k", "listener", "t")]
    supers = spark.createDataFrame([("s", "B", "A"), ("s", "D", "B")], "snapshot_id string, from_id string, to_id string")
    repos = spark.createDataFrame([("s", "A")], "snapshot_id string, symbol_id string")
    assert rows(rules.repository_closure(supers, repos), "symbol_id") == [("A",), ("B",), ("D",)]
    points = spark.createDataFrame([("s", 1, "X", "A", None, "d")], "snapshot_id string, point_id int, from_id string, type_id string, qualifier string, name string")
    beans = spark.createDataFrame([("s", "B", "b", False), ("s", "D", "d", False)], "snapshot_id string, symbol_id string, bean string, is_primary boolean")
    assert rows(rules.inject_targets(points, beans, supers), "from_id", "to_id", "confidence") == [("X", "D", 0.9)]


def test_citations_and_modules(spark):
    answers = spark.createDataFrame([("r", 1, "see a/b.java:3 and b.java:9, c.py:1 (old)")], "review_id string, answer_id int, text string")
    context = spark.createDataFrame([("r", "x/a/b.java", "new", 3), ("r", "c.py", "old", 1)], "review_id string, path string, side string, line int")
    assert rows(matching.validate_citations(answers, context), "cited", "valid") == [("a/b.java:3", True), ("b.java:9", False), ("c.py:1 (old)", True)]
    imports = spark.createDataFrame([("s", 1, "src/a/x.ts", "../b"), ("s", 2, "src/a/x.ts", "./y")], "snapshot_id string, import_id int, file string, spec string")
    files = spark.createDataFrame([("s", "src/b/index.ts"), ("s", "src/b.ts"), ("s", "src/a/y.js")], "snapshot_id string, path string")
    assert rows(matching.resolve_module_path(imports, files), "import_id", "path") == [(1, "src/b.ts"), (2, "src/a/y.js")]


def test_callers_through_overridden_methods(spark):
    e = spark.createDataFrame([("s", "x", "base", 1.0)], "snapshot_id string, from_id string, to_id string, confidence double")
    o = spark.createDataFrame([("s", "impl", "base", 0.9)], "snapshot_id string, from_id string, to_id string, confidence double")
    got = rows(graph.callers(e, o), "symbol_id", "caller_id", F.round("confidence", 4), "via")
    assert got == [("base", "x", 1.0, None), ("impl", "x", 0.63, "base")]


def test_merges(spark):
    a = spark.createDataFrame([("r", "api", 1, "t", 1, 1), ("r", "api", 2, "u", 2, 2), ("r", "ui", 3, "v", 3, 3)], "review_id string, layer string, group_id int, title string, item_id int, pos int")
    m = spark.createDataFrame([("r", 1, 1, "both"), ("r", 1, 2, "both"), ("r", 2, 3, "")], "review_id string, merge_id int, group_id int, title string")
    assert rows(groups.validate_merges(m, a), "merge_id", "problem") == [(2, "fewer than two groups"), (2, "no title")]
    assert rows(groups.apply_merges(a, m.where("merge_id = 1")), "item_id", "group_id", "title") == [(1, 1, "both"), (2, 1, "both"), (3, 3, "v")]
