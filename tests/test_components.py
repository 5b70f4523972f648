"""Components of user interfaces on small tables."""

import random

from changegraph.operators import components as c
from tests.test_operators import rows

SYMBOLS = "snapshot_id string, symbol_id string, name string, kind string, file string, package string, container_id string"


def df(spark, data, schema):
    return spark.createDataFrame([("s", *r) for r in data], f"snapshot_id string, {schema}")


def test_decorators(spark):
    note = "array<struct<name:string,line:int,args:array<struct<key:string,value:string>>>>"
    defs = df(spark, [
        ("A", "a.ts", "class", [("Component", 3, [("selector", "'app-a, app-b[x], [y]'"), ("templateUrl", "'./a.html'"), ("imports", "[Shared, RouterModule]"), ("providers", "[{provide: T, useClass: Impl}, {provide: U, deps: [X], useExisting: T}, {provide: V, useValue: 1}]")])]),
        ("S", "s.ts", "class", [("Injectable", 1, [("providedIn", "'root'")])]), ("I", "s.ts", "class", [("Injectable", 9, [])]),
        ("M", "m.ts", "class", [("NgModule", 1, [("declarations", "[A, P]"), ("exports", "[A]")])]), ("P", "p.ts", "class", [("Pipe", 1, [("name", "\"short\"")])]), ("f", "p.ts", "function", [("Component", 1, [])]),
    ], f"symbol_id string, file string, kind string, annotations {note}")
    facts, selectors, templates, uses, provided = c.ui_components(defs)
    assert rows(facts.where("kind = 'role'"), "symbol_id", "name") == [("A", "component"), ("A", "view"), ("I", "component"), ("M", "config"), ("P", "component"), ("S", "component")]
    assert rows(facts.where("kind = 'tag'"), "symbol_id", "name", "value") == [("A", "angular.selector", "app-a, app-b[x], [y]"), ("A", "angular.template", "./a.html"), ("I", "angular.provided_in", "module"), ("P", "angular.pipe", "short"), ("S", "angular.provided_in", "root")]
    assert rows(selectors, "element", "component_id") == [("app-a", "A"), ("app-b", "A")] and rows(templates, "symbol_id", "url", "line") == [("A", "./a.html", 3)]
    assert rows(uses, "symbol_id", "name") == [("A", "Shared"), ("M", "A"), ("M", "P")]
    assert rows(provided, "file", "token", "name") == [("a.ts", "T", "Impl"), ("a.ts", "U", "T")]


def test_tokens_give_what_is_provided_else_types_else_constants(spark):
    symbols = df(spark, [("Impl", "Impl", "class", "i.ts", None, "i.ts"), ("Other", "Other", "class", "o.ts", None, "o.ts"), ("Svc", "Svc", "class", "s.ts", None, "s.ts"), ("TOKEN", "TOKEN", "variable", "t.ts", None, "t.ts"), ("HERE", "HERE", "variable", "a.ts", None, "a.ts")], SYMBOLS.removeprefix("snapshot_id string, "))
    imports = df(spark, [("a.ts", "Mine", None, "Impl", True, "i.ts"), ("a.ts", "Alias", None, "TOKEN", True, "t.ts"), ("a.ts", "Out", None, "Out", True, None)], "file string, name string, package string, exported string, is_script boolean, target_file string")
    provided = df(spark, [("a.ts", "Base", "Mine"), ("a.ts", "Base", "Other"), ("a.ts", "Lost", "Nothing")], "file string, token string, name string")
    names = ["Base", "Svc", "Alias", "HERE", "Lost", "Out", "Mine"]
    points = df(spark, [(k, "A", "a.ts", None, n, k) for k, n in enumerate(names)], "point_id int, from_id string, file string, package string, name string, line int")
    got = c.component_injection(points, provided, symbols, imports, df(spark, [], "file string, package string"))
    got = [(line, to, round(x, 6)) for line, to, x in rows(got, "line", "to_id", "confidence")]
    assert got == [(0, "Impl", 0.4275), (0, "Other", 0.135), (1, "Svc", 0.27), (2, "TOKEN", 0.9), (3, "HERE", 0.9), (6, "Impl", 0.855)]


def test_elements_are_shared_by_their_components(spark):
    elements = df(spark, [("a.html", "app-x", 4), ("a.html", "app-y", 5), ("a.html", "p", 6), ("B", "app-x", 2)], "file string, name string, line int")
    selectors = df(spark, [("app-x", "X1"), ("app-x", "X2"), ("app-y", "Y")], "element string, component_id string")
    got = c.template_component_edges(elements, selectors, df(spark, [("A", "a.html", 9)], "symbol_id string, file string, line int"))
    assert rows(got, "from_id", "to_id", "confidence", "line") == [
        ("A", "X1", 0.45, 9), ("A", "X2", 0.45, 9), ("A", "Y", 0.9, 9), ("B", "X1", 0.45, 2), ("B", "X2", 0.45, 2), ("a.html", "X1", 0.45, 4), ("a.html", "X2", 0.45, 4), ("a.html", "Y", 0.9, 5),
    ]


def test_prefixes_with_diamonds_cycles_and_a_cut(spark):
    rnd = random.Random(5)
    routes, lazy = [], []
    for i in range(60):
        file = f"f{i % 12}"
        above = [r for r in routes if r[1] == file]
        routes.append((f"r{i}", file, rnd.choice(("a", "b/c", "", "/d/")), rnd.choice(above)[0] if above and rnd.random() < 0.5 else None))
    for k in range(26):
        lazy.append((rnd.choice(routes)[0], f"f{rnd.randrange(12)}", k))
    lazy += [(routes[0][0], "f7", 50 + k) for k in range(2)]
    by_id = {r[0]: r for r in routes}
    clean = lambda *parts: "/".join(x for p in parts for x in p.split("/") if x)

    def path(r):
        return clean(path(by_id[r][3]) if by_id[r][3] else "", by_id[r][2])

    prefixes = {}
    for _ in range(6):
        later = {}
        for r, target, _ in sorted(lazy, key=lambda x: x[2]):
            for base in prefixes.get(by_id[r][1], [""]):
                p, own = clean(base, path(r)), later.setdefault(target, [])
                if p not in own and len(own) < 8:
                    own.append(p)
        if later == prefixes:
            break
        prefixes = later
    want = sorted({(r, "/" + clean(b, path(r))) for r, file, *_ in routes for b in prefixes.get(file, [""])})
    got = c.route_prefixes(df(spark, routes, "route_id string, file string, path string, parent_id string"), df(spark, lazy, "route_id string, target_file string, ord int"))
    assert rows(got, "route_id", "full_path") == want and max(map(len, prefixes.values())) == 8
