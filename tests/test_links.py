"""Links of frameworks on small tables, worked out by hand."""

from changegraph.operators import links
from tests.test_operators import rows

SYMBOLS = "symbol_id string, name string, kind string, file string, package string, container_id string, line int"


def frames(spark):
    df = lambda data, schema: spark.createDataFrame([("s", *r) for r in data], f"snapshot_id string, {schema}")
    return df, df([], "file string, package string, name string"), df([], "file string, package string")


def test_events_reach_listeners_of_supertypes(spark):
    df, imports, wild = frames(spark)
    symbols = df([("Paid", "Paid", "class", "e", "p", "e", 1), ("Base", "Base", "class", "e", "p", "e", 9), ("Other", "Other", "class", "e", "p", "e", 20)], SYMBOLS)
    inherits = df([("Paid", "Base")], "from_id string, to_id string")
    publishes = df([("a", "f", "p", "Paid", 4), ("b", "f", "p", "Ghost", 5)], "from_id string, file string, package string, event string, line int")
    listeners = df([("l1", "g", "p", ["Base"]), ("l2", "g", "p", ["Ghost"]), ("l3", "g", "p", ["Other", "Paid"]), ("l4", "g", "p", ["Other"]), ("l5", "g", "q", ["Unknown"])], "symbol_id string, file string, package string, types array<string>")
    got = links.match_publishers_to_listeners(publishes, listeners, symbols, imports, wild, inherits)
    assert rows(got, "from_id", "to_id", "confidence", "line") == [("a", "l1", 0.85, 4), ("a", "l3", 0.85, 4), ("b", "l2", 0.6, 5)]


def test_operations_of_specifications(spark):
    df, *_ = frames(spark)
    config = df([("a.yml", "openapi", "3.0", 1), ("a.yml", "paths./pets/{id}.get.operationId", "getPet", 4), ("a.yml", "paths./pets.x-note.operationId", "other", 5), ("b.yml", "paths./pets.get.operationId", "list", 4)], "file string, key string, value string, line int")
    controllers = df([("C", ["/api"], "/ctx"), ("D", [], None)], "symbol_id string, prefixes array<string>, context string")
    methods = df([("C.getPet", "C", "getPet"), ("C.list", "C", "list"), ("D.getPet", "D", "getPet"), ("E.getPet", "E", "getPet")], "symbol_id string, container_id string, name string")
    edges, tags = links.bind_operations(config, controllers, methods, df([], "symbol_id string"))
    assert rows(edges, "from_id", "to_id", "confidence", "line") == [("a.yml", "C.getPet", 0.8, 4), ("a.yml", "D.getPet", 0.8, 4)]
    assert rows(tags.where("key <> 'http.spec' AND key <> 'entry'"), "symbol_id", "key", "value") == [("C.getPet", "http.context_path", "/ctx"), ("C.getPet", "http.route", "GET /api/pets/{id}"), ("D.getPet", "http.route", "GET /pets/{id}")]
    assert links.bind_operations(config, controllers, methods, df([("C.getPet",), ("D.getPet",)], "symbol_id string"))[0].count() == 0


def test_environments_configure_their_readers(spark):
    df, *_ = frames(spark)
    files = df([("env/environment.ts",), ("env/environment.prod.ts",), ("env/other.ts",), ("x/environment.ts",)], "path string")
    imports = df([("a.ts", "env", "environment", "env/environment.ts", 1), ("b.ts", "environment", "environment", "env/environment.ts", 2), ("env/environment.prod.ts", "e", "environment", "env/environment.ts", 1)], "file string, local string, name string, target_file string, line int")
    texts = df([("a.ts", "A.f", 7, "env.api + '/x'"), ("a.ts", "A.g", 8, "environment.api"), ("b.ts", "B.f", 7, "none")], "file string, scope_id string, line int, text string")
    symbols = df([("E", "environment", "variable", "env/environment.ts", None, "env/environment.ts", 3)], SYMBOLS)
    got = links.environment_edges(files, imports, texts, symbols)
    assert rows(got, "from_id", "to_id", "confidence", "line") == [("E", "A.f", 0.9, 3), ("E", "b.ts", 0.9, 3), ("env/environment.prod.ts", "A.f", 0.6, 1), ("env/environment.prod.ts", "b.ts", 0.6, 1)]


def test_entities_and_generated_repositories(spark):
    df, imports, wild = frames(spark)
    note = "array<struct<name:string,args:array<struct<key:string,value:string>>>>"
    defs = df([("Owner", "class", 1, [("Entity", []), ("Table", [("name", "owners")])]), ("Plain", "class", 1, [("Table", [(None, "plain")])]), ("Owners", "interface", 5, []), ("Own", "interface", 6, []), ("K", "class", 7, [])], f"symbol_id string, kind string, line int, annotations {note}")
    symbols = df([("Owner", "Owner", "class", "o", "p", "o", 1), ("CrudRepository", "CrudRepository", "interface", "q", "q", "q", 1)], SYMBOLS)
    supers = df([("Owners", "f", "p", "JpaRepository", "Owner"), ("Own", "g", "q", "CrudRepository", "Owner"), ("K", "f", "p", "JpaRepository", "Owner")], "symbol_id string, file string, package string, name string, argument string")
    roles, tags, edges = links.persistence_facts(defs, supers, symbols, imports, wild)
    assert rows(roles, "symbol_id", "role") == [("Owner", "entity"), ("Owners", "repository"), ("Plain", "entity")]
    assert rows(tags, "symbol_id", "key", "value") == [("Owner", "persistence.table", "owners"), ("Owners", "persistence", "spring_data"), ("Owners", "persistence.entity", "Owner"), ("Plain", "persistence.table", "plain")]
    assert [(a, b, round(c, 6)) for a, b, c in rows(edges, "from_id", "to_id", "confidence")] == [("Owners", "Owner", 0.855)]
