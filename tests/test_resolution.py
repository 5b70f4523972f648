"""Resolution of calls and symbols on small tables with results worked out by hand."""

from changegraph.operators import graph, lines, resolution
from changegraph.operators.matching import renormalise
from tests.test_operators import rows

def test_arity_is_loose_but_for_java(spark):
    data = [("s", 1, "f", 1.0, 1, 2, False, "kotlin"), ("s", 2, "f", 1.0, 1, 2, False, "java"), ("s", 3, "f", 0.5, 1, 1, False, "java"), ("s", 3, "g", 0.5, 1, 3, False, "java"), ("s", 4, "v", 1.0, 4, 2, True, "java")]
    df = spark.createDataFrame(data, "snapshot_id string, ref_id int, symbol_id string, confidence double, arity int, params int, variadic boolean, lang string")
    assert rows(renormalise(df), "ref_id", "symbol_id", "confidence") == [(1, "f", 0.8), (3, "f", 1.0), (4, "v", 1.0)]


def test_hunks_of_renamed_files_and_removed_symbols(spark):
    schema = "snapshot_id string, symbol_id string, file string, kind string, container_id string, start int, stop int, pos int"
    base = spark.createDataFrame([("s", "o", "o", "file", None, 1, 20, -1), ("s", "o#A", "o", "class", "o", 1, 20, 0), ("s", "o#A.f", "o", "method", "o#A", 2, 4, 1), ("s", "o#B", "o", "class", "o", 11, 20, 2), ("s", "o#B.g", "o", "method", "o#B", 12, 14, 3)], schema)
    head = spark.createDataFrame([("s", "n", "n", "file", None, 1, 10, -1), ("s", "n#A", "n", "class", "n", 1, 10, 0), ("s", "n#A.f", "n", "method", "n#A", 2, 4, 1)], schema)
    body = spark.createDataFrame([("s", 1, "n", "o", "removed", 3, None), ("s", 1, "n", "o", "added", None, 9), ("s", 2, "n", "o", "removed", 13, None)], "snapshot_id string, hunk_id int, path string, old_path string, kind string, old_line int, new_line int")
    own, changed, removed = resolution.map_hunks_to_symbols(body, head, base)
    assert rows(own, "hunk_id", "symbol_id") == [(1, "n#A"), (1, "n#A.f"), (2, "o#B.g")]
    assert rows(removed, "symbol_id", "container_id") == [("o#B", "n"), ("o#B.g", "o#B")]


def test_tests_of_enclosing_types(spark):
    edges = spark.createDataFrame([("s", "t1", "m", "tests", 0.8, 1), ("s", "T", "A", "tests", 1.0, 2), ("s", "t2", "A", "tests", 1.0, 3)], "snapshot_id string, from_id string, to_id string, kind string, confidence double, line int")
    sym = spark.createDataFrame([("s", "T", "class"), ("s", "t1", "method"), ("s", "t2", "method"), ("s", "A", "class"), ("s", "m", "method")], "snapshot_id string, symbol_id string, kind string")
    above = spark.createDataFrame([("s", "m", "A", 1)], "snapshot_id string, symbol_id string, ancestor_id string, dist int")
    got = graph.tests_of(edges, sym, above).where("symbol_id = 'm'")
    assert rows(got, "test_id", "confidence", "via") == [("T", 0.5, "A"), ("t1", 0.8, None)]


def test_import_lines_indented_by_tabs(spark):
    texts = ["\timport os", "\t from a import b\r", "\tx = 1", "export * from\t'x'"]
    data = [("r", i, 0, t, "python") for i, t in enumerate(texts)]
    got = lines.import_lines(spark.createDataFrame(data, "review_id string, hunk_id int, idx int, text string, language string"))
    assert [r.is_import for r in sorted(got.collect(), key=lambda r: r.hunk_id)] == [True, True, False, False]


def test_import_lines(spark):
    texts = ["import { a,", "  b", "} from 'x'", "import './run'", "import('late')", "import c from 'c'", "let x = 1", "export { d } from 'd'", "const e = require('e')"]
    data = [("r", 1, i, t, "typescript") for i, t in enumerate(texts)] + [("r", 2, 0, "import this is prose", "markdown"), ("r", 3, 0, "from a import (", "python"), ("r", 3, 1, "b)", "python"), ("r", 3, 2, "b()", "python")]
    got = lines.import_lines(spark.createDataFrame(data, "review_id string, hunk_id int, idx int, text string, language string"))
    flags = {(r.hunk_id, r.idx): r.is_import for r in got.collect()}
    assert [flags[1, i] for i in range(len(texts))] == [True, True, True, False, False, True, False, True, True]
    assert [flags[2, 0], flags[3, 0], flags[3, 1], flags[3, 2]] == [False, True, True, False]


SYMBOLS = "snapshot_id string, symbol_id string, name string, kind string, file string, package string, container_id string, params int, variadic boolean, is_test boolean"
REFS = "snapshot_id string, ref_id int, file string, package string, lang string, name string, arity int, is_test boolean"


def test_constructors_fit_the_arity_or_give_the_type(spark):
    symbols = spark.createDataFrame(
        [
            ("s", "A", "A", "class", "a.kt", "p", "a.kt", 0, False, False), ("s", "A.0", "A", "constructor", "a.kt", "p", "A", 0, False, False),
            ("s", "A.2", "A", "constructor", "a.kt", "p", "A", 2, False, False), ("s", "B", "B", "class", "b.kt", "p", "b.kt", 1, False, False),
        ],
        SYMBOLS,
    )
    refs = spark.createDataFrame([("s", 1, "c.java", "p", "java", "A", 2, False), ("s", 2, "c.java", "p", "java", "B", 1, False), ("s", 3, "c.java", "p", "java", "Gone", 1, False)], REFS)
    imports = spark.createDataFrame([], "snapshot_id string, file string, package string, name string")
    wildcards = spark.createDataFrame([], "snapshot_id string, file string, package string")
    got = resolution.resolve_constructors(refs, symbols, imports, wildcards)
    assert rows(got, "ref_id", "symbol_id") == [(1, "A.2"), (2, "B")]


def test_unknown_receivers_prefer_visible_types(spark):
    method = lambda i, name, of, test=False: ("s", i, name, "method", f"{of}.kt", "p", of, 1, False, test)
    symbols = spark.createDataFrame(
        [method("A.pay", "pay", "A"), method("B.pay", "pay", "B"), method("C.pay", "pay", "C"), method("A.owe", "owe", "A"), method("T.owe", "owe", "T", True), method("A.get", "get", "A")]
        + [method(f"D{i}.lend", "lend", f"D{i}") for i in range(3)],
        SYMBOLS,
    )
    refs = spark.createDataFrame([("s", i, "x.java", "p", "java", name, 1, False) for i, name in ((1, "pay"), (2, "owe"), (3, "get"), (4, "lend"))], REFS)
    visible = spark.createDataFrame([("s", "x.java", "A"), ("s", "x.java", "B")], "snapshot_id string, file string, type_id string")
    got = resolution.unknown_receivers(refs, symbols, visible)
    assert rows(got, "ref_id", "symbol_id", "confidence") == [(1, "A.pay", 0.25), (1, "B.pay", 0.25), (2, "A.owe", 0.5)]


def test_calls_by_what_stands_before_the_name(spark):
    sym = lambda i, name, kind, of: ("s", i, name, kind, "f.kt", "p", of, 0, False, False)
    symbols = spark.createDataFrame(
        [
            sym("Base", "Base", "class", "f.kt"), sym("Base.go", "go", "method", "Base"), sym("Out", "Out", "class", "f.kt"), sym("Out.o", "o", "method", "Out"),
            sym("Sub", "Sub", "class", "Out"), sym("Sub.m", "m", "method", "Sub"), sym("helper", "helper", "function", "f.kt"), sym("Out.quux", "quux", "method", "Out"),
        ],
        SYMBOLS,
    )
    calls = [(1, "go", None), (2, "o", None), (3, "helper", None), (4, "Base", None), (5, "m", "this"), (6, "go", "super"), (7, "go", "x"), (8, "helper", "ns"), (9, "quux", "y.z()"), (10, "gone", None)]
    refs = spark.createDataFrame(
        [("s", i, "f.kt", "p", "kotlin", "call", name, receiver, 0, "Sub.m", "Sub", i, False) for i, name, receiver in calls],
        "snapshot_id string, ref_id int, file string, package string, lang string, kind string, name string, receiver string, arity int, scope_id string, type_id string, line int, is_test boolean",
    )
    table = lambda data, schema: spark.createDataFrame(data, "snapshot_id string, " + schema)
    levels = table([("s", "Sub", "Sub", 0), ("s", "Sub", "Base", 1), ("s", "Base", "Base", 0), ("s", "Out", "Out", 0)], "type_id string, relative_id string, dist int")
    inherits = table([("s", "Sub", "Base", 1.0)], "from_id string, to_id string, confidence double")
    outer = table([("s", "Sub", "Sub", 0), ("s", "Sub", "Out", 1), ("s", "Base", "Base", 0), ("s", "Out", "Out", 0)], "type_id string, outer_id string, dist int")
    got = resolution.resolve_calls(
        refs, symbols, levels, inherits, outer, table([("s", 7, "Base")], "ref_id int, type_name string"), table([], "file string, package string, name string"),
        table([], "file string, package string"), table([("s", "f.kt", "ns", "f.kt")], "file string, name string, target_file string"), table([], "file string, type_id string"),
    )
    want = [(1, "Base.go", 0.9), (2, "Out.o", 0.9), (3, "helper", 0.95), (4, "Base", 1.0), (5, "Sub.m", 0.9), (6, "Base.go", 0.9), (7, "Base.go", 0.95), (8, "helper", 0.9), (9, "Out.quux", 0.3)]
    assert rows(got, "ref_id", "symbol_id", "confidence") == want
