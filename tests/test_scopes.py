"""Scoped names and string templates against plain Python, over two snapshots."""

import random

from changegraph.operators import graph as g
from changegraph.operators import resolution as rs
from changegraph.operators import scopes as sc
from changegraph.operators import templates as tp

SCOPES = "snapshot_id string, scope_id string, parent_id string, is_type boolean, file string"


def scope_tree(rnd, n):
    out = []
    for i in range(n):
        parent = rnd.choice(out) if out and rnd.random() < 0.85 else None
        file = parent[3] if parent else f"f{rnd.randrange(4)}"
        out.append((f"s{i}", parent[0] if parent else None, rnd.random() < 0.4, file))
    return out


def test_bindings_of_nested_scopes_and_supertypes(spark):
    rnd = random.Random(3)
    trees = {p: scope_tree(rnd, 40) for p in ("p", "q")}
    bindings = {p: [(rnd.choice(t)[0], rnd.choice("xyz"), rnd.randrange(30), k, rnd.random() < 0.5, f"T{k}") for k in range(70)] for p, t in trees.items()}
    types = {p: [s for s in t if s[2]] for p, t in trees.items()}
    supers = {p: {(rnd.choice(t)[0], rnd.choice(t)[0]) for _ in range(12)} for p, t in types.items()}
    refs = {p: [(f"r{k}", rnd.choice(t)[0], rnd.choice([None, *types[p]]), rnd.choice("xyzw"), rnd.randrange(30), rnd.random() < 0.3) for k in range(200)] for p, t in trees.items()}

    def distances(start, pairs):
        seen, level, d = {start: 0}, {start}, 0
        while level:
            d += 1
            level = {b for a, b in pairs if a in level} - set(seen)
            seen |= dict.fromkeys(level, d)
        return seen

    want = {}
    for p in trees:
        tree = {s[0]: s for s in trees[p]}
        for ref, scope, owner, name, at, fields in refs[p]:
            s, found = scope, None
            while s is not None and found is None:
                hits = [b for b in bindings[p] if b[0] == s and b[1] == name and (b[4] or not fields) and (tree[s][2] or b[2] <= at)]
                if hits and (tree[s][2] or not fields):
                    found = (max(hits, key=lambda b: (b[2], b[3]))[5], "scope")
                s = tree[s][1]
            if found is None and owner is not None:
                options = [(d, t) for t, d in distances(owner[0], supers[p]).items() if d and any(b[0] == t and b[4] and b[1] == name for b in bindings[p])]
                if options:
                    t = min(options)[1]
                    found = (next(b[5] for b in bindings[p] if b[0] == t and b[4] and b[1] == name), "inherited")
            if found:
                want[p, ref] = found

    frame = lambda data, schema: spark.createDataFrame([(p, *r) for p, rows in data.items() for r in rows], f"snapshot_id string, {schema}")
    scopes = frame(trees, SCOPES.removeprefix("snapshot_id string, "))
    owners = frame({p: [(t[0],) for t in ts] for p, ts in types.items()}, "symbol_id string")
    levels = rs.hierarchy(frame(supers, "from_id string, to_id string"), owners)
    asked = frame({p: [(r, s, o and o[0], n, a, f) for r, s, o, n, a, f in rows] for p, rows in refs.items()}, "ref_id string, scope_id string, type_id string, name string, at int, fields_only boolean")
    known = frame(bindings, "scope_id string, name string, at int, ord int, field boolean, type_name string")
    got = {(r.snapshot_id, r.ref_id): (r.type_name, r.via) for r in sc.binding_lookup(asked, known, sc.scope_paths(scopes), levels).collect()}
    assert got == want and {v for _, v in want.values()} == {"scope", "inherited"}


def test_ancestors_of_a_long_chain(spark):
    chain = spark.createDataFrame([("s", f"n{i}", f"n{i + 1}" if i < 30 else None) for i in range(31)], "snapshot_id string, symbol_id string, container_id string")
    assert g.ancestors(chain).where("symbol_id = 'n0'").count() == 30


class Plain:
    """Evaluates an expression recursively."""

    def __init__(self, scopes, values, imports, constants):
        self.scopes, self.values, self.imports, self.constants = {s[0]: s for s in scopes}, values, imports, constants

    def value(self, name, file, lang, scope, at):
        own, path = name.startswith("this."), name.removeprefix("this.").split(".")
        s = scope
        while s is not None:
            _, parent, is_type, _ = self.scopes[s]
            hits = [v for v in self.values if v["scope_id"] == s and v["name"] == path[0] and (is_type or v["at"] <= at)]
            if hits and (is_type or not own):
                return max(hits, key=lambda v: (v["at"] if not is_type else v["at"], v["ord"])), path[1:]
            s = parent
        top = lambda f, n: next((v for v in self.values if v["scope_id"] is None and v["file"] == f and v["name"] == n), None)
        if not own and top(file, path[0]):
            return top(file, path[0]), path[1:]
        if lang == "typescript":
            for f, local, exported, target in self.imports:
                if (f, local) == (file, path[0]) and target and top(target, exported):
                    return top(target, exported), path[1:]
        elif len(path) > 1:
            for f, t, n, v, _ in sorted(self.constants, key=lambda c: (c[4], c[3])):
                if (f, t, n) == (file, path[0], path[1]):
                    return next(x for x in self.values if x["value_id"] == v), path[2:]
        return None, []

    def parts(self, text, file, lang, scope, at, base, seen):
        out = []
        for kind, t, deep, down in tp._Parser(lang == "kotlin").expression(text):
            if base + deep > tp.MOST_DEPTH or kind == "any":
                out.append(None)
            elif kind == "text":
                out.append(t)
            else:
                v, rest = self.value(t, file, lang, scope, at)
                inner = tp.property_text(v["text"], rest) if v and v["value_id"] not in seen else None
                if inner is None:
                    out.append(None)
                    continue
                found = self.parts(inner, v["file"], v["lang"], v["scope_id"], v["at"], base + down + 1, seen | {v["value_id"]}) if base + down < tp.MOST_DEPTH else [None]
                out += [None] if all(x == "" for x in found) else found
        return out

    def template(self, *args):
        merged = []
        for p in self.parts(*args, 0, frozenset()):
            if merged and p is None and merged[-1] is None:
                continue
            if merged and p is not None and merged[-1] is not None:
                merged[-1] += p
            else:
                merged.append(p)
        return "".join("*" if p is None else p for p in merged)


def test_templates_equal_a_recursive_evaluation(spark):
    rnd = random.Random(12)
    data = {}
    for p in ("p", "q"):
        scopes = scope_tree(rnd, 25)
        langs = {f"f{i}": rnd.choice(("typescript", "kotlin", "java")) for i in range(4)}
        atom = lambda: rnd.choice(('"/a"', "'b'", '""', "x", "y", "z.k", "this.x", "this.y", "T.y", "u", "call(x + y)", "(x + '/')", "`${y}/${this.x}`", '"$x/${z}"', "y ?: 'd'", "x || z", "{k: x + '!', 'm': 1}"))
        text = lambda: " + ".join(atom() for _ in range(rnd.choice((1, 1, 2, 3))))
        values = []
        for k in range(60):
            s = rnd.choice([None, *scopes])
            file = s[3] if s else f"f{rnd.randrange(4)}"
            values.append(dict(value_id=f"v{k:02}", file=file, lang=langs[file], scope_id=s and s[0], name=rnd.choice("xyzu"), at=k, ord=k, text=text()))
        imports = [(f, local, rnd.choice("xyz"), rnd.choice(("f0", "f1", None))) for f in langs for local in ("u", "x")]
        constants = [(f, "T", "y", rnd.choice(values)["value_id"], k) for k, f in enumerate(langs)]
        exprs = []
        for k in range(150):
            s = rnd.choice([None, *scopes])
            file = s[3] if s else f"f{rnd.randrange(4)}"
            exprs.append((f"e{k}", file, langs[file], s and s[0], rnd.randrange(70), text()))
        data[p] = (scopes, values, imports, constants, exprs)
    frame = lambda k, schema: spark.createDataFrame([(p, *(r.values() if isinstance(r, dict) else r)) for p, d in data.items() for r in d[k]], f"snapshot_id string, {schema}")
    values = frame(1, "value_id string, file string, lang string, scope_id string, name string, at int, ord int, text string")
    got = tp.expand_templates(
        frame(4, "expr_id string, file string, lang string, scope_id string, at int, text string"), values, sc.scope_paths(frame(0, SCOPES.removeprefix("snapshot_id string, "))),
        frame(2, "file string, local string, name string, target_file string"), frame(3, "file string, type_name string, name string, value_id string, rank int"),
    )
    got = {(r.snapshot_id, r.expr_id): r.template for r in got.collect()}
    want = {(p, e): Plain(*d[:4]).template(text, file, lang, scope, at) for p, d in data.items() for e, file, lang, scope, at, text in d[4]}
    assert got == want and len({t for t in want.values() if "*" not in t}) > 10


def test_known_templates(spark):
    values = [("BASE", None, 1, "'/api'"), ("env", None, 2, "{url: BASE + '/v1', 'k-2': {deep: \"d\"}}"), ("loop", None, 3, "loop + 'x'"), ("unset", None, 4, "''")]
    v = spark.createDataFrame([("s", f"v{k}", "f", "typescript", s, n, a, a, t) for k, (n, s, a, t) in enumerate(values)], "snapshot_id string, value_id string, file string, lang string, scope_id string, name string, at int, ord int, text string")
    texts = {"`${env.url}/owners/${id}`": "/api/v1/owners/*", "env.none": "*", "(BASE + '/x') + f(1) + g": "/api/x*", "loop": "*x", "unset + '/y'": "*/y", "BASE ?? '/z'": "/api", None: "", "'it\\'s'": "it's"}
    exprs = spark.createDataFrame([("s", f"e{k}", "f", "typescript", None, 9, t) for k, t in enumerate(texts)], "snapshot_id string, expr_id string, file string, lang string, scope_id string, at int, text string")
    no = lambda schema: spark.createDataFrame([], f"snapshot_id string, {schema}")
    paths = no("scope_id string, outer_id string, dist int, outer_is_type boolean")
    out = tp.expand_templates(exprs, v, paths, no("file string, local string, name string, target_file string"), no("file string, type_name string, name string, value_id string, rank int"))
    assert [r.template for r in sorted(out.collect(), key=lambda r: r.expr_id)] == list(texts.values())


def test_uses_of_one_name_ask_the_scopes_around_once(spark, monkeypatch):
    """Uses in 60 callables of one type: the type and what is around it are asked once, with parents looked up or brought; scopes around each other end."""
    scopes = [("s", f"m{i}", "T", False) for i in range(60)] + [("s", "T", "O", True), ("s", "O", None, True), ("s", "x", "y", False), ("s", "y", "z", False), ("s", "z", "y", False)]
    tree = spark.createDataFrame(scopes, "snapshot_id string, scope_id string, parent_id string, is_type boolean")
    refs = [("s", f"r{i}", f"m{i}", "T", "a" if i % 2 else "b", 5, False) for i in range(60)] + [("s", "lost", "x", None, "a", 5, False), ("s", "none", "gone", "T", "c", 5, False)]
    refs = spark.createDataFrame(refs, "snapshot_id string, ref_id string, scope_id string, type_id string, name string, at int, fields_only boolean")
    known = spark.createDataFrame([("s", "O", "a", 1, 1, True, "A"), ("s", "m0", "b", 9, 1, False, "late"), ("s", "S", "c", 1, 1, True, "C")], "snapshot_id string, scope_id string, name string, at int, ord int, field boolean, type_name string")
    levels = spark.createDataFrame([("s", "T", "T", 0), ("s", "T", "S", 1)], "snapshot_id string, type_id string, relative_id string, dist int")
    stored = []
    monkeypatch.setattr(sc, "store", lambda df: stored.append(g.store(df)) or stored[-1])
    want = {(f"r{i}", "A", "scope") for i in range(1, 60, 2)} | {("none", "C", "inherited")}
    leaf = refs.join(tree.select("snapshot_id", "scope_id", "parent_id", "is_type"), ["snapshot_id", "scope_id"])
    for asked, around in ((refs, tree), (refs, sc.scope_paths(tree)), (leaf, tree.where("NOT scope_id LIKE 'm%'"))):
        stored.clear()
        got = {(r.ref_id, r.type_name, r.via) for r in sc.binding_lookup(asked, known, around, levels).collect()}
        assert got == (want if asked is refs else want - {("none", "C", "inherited")})
        sizes = sorted(df.count() for df in stored)
        assert sizes[-1] == asked.count() and sizes[-2] <= 6, sizes


def test_parents_in_scoped_bindings_are_not_listed_for_every_order(spark, monkeypatch):
    from changegraph.plans import code_queries as cq

    given = []
    monkeypatch.setattr(sc, "binding_lookup", lambda refs, bindings, scopes, levels: given.append((refs, scopes)) or refs)
    cq.scoped_bindings(spark, "/root/testdata/sf0.001")
    refs, scopes = given[0]
    assert scopes.where("scope_id LIKE 'o%'").isEmpty() and refs.where("parent_id IS NULL OR is_type").isEmpty()


def test_names_of_many_expressions_are_expanded_once(spark, monkeypatch):
    """Forty expressions over one name: what is stored besides the expressions does not grow with them; rows of one id stay apart."""
    values = spark.createDataFrame([("s", "v1", "f", "typescript", None, "A", 1, 1, "'/a' + B"), ("s", "v2", "f", "typescript", None, "B", 1, 1, "'/b'")], "snapshot_id string, value_id string, file string, lang string, scope_id string, name string, at int, ord int, text string")
    exprs = [("s", f"e{k // 2}", "f", "typescript", None, k, f"'/{k}' + A + x") for k in range(40)]
    exprs = spark.createDataFrame([*exprs, ("s", "plain", "f", "typescript", None, 1, "'/p'"), ("s", "null", "f", "typescript", None, 1, None)], "snapshot_id string, expr_id string, file string, lang string, scope_id string, at int, text string")
    no = lambda schema: spark.createDataFrame([], f"snapshot_id string, {schema}")
    stored = []
    monkeypatch.setattr(tp, "store", lambda df: stored.append(g.store(df)) or stored[-1])
    for most in (100, 0):
        monkeypatch.setattr(tp, "BROADCAST_NAMES", most)
        stored.clear()
        out = tp.expand_templates(exprs, values, no("scope_id string, outer_id string, dist int, outer_is_type boolean"), no("file string, local string, name string, target_file string"), no("file string, type_name string, name string, value_id string, rank int"))
        got = sorted((r.expr_id, r.template) for r in out.collect())
        assert got == sorted([(f"e{k // 2}", f"/{k}/a/b*") for k in range(40)] + [("plain", "/p"), ("null", "")])
        assert sorted(df.count() for df in stored)[-2:] == [2, 42]
