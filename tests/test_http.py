"""From references to endpoints: clients, calls, URLs and routes."""

import random

from pyspark.sql import functions as F

from changegraph.functions.text import url_segments
from changegraph.operators import http
from changegraph.operators import matching as m
from changegraph.operators import scopes as sc
from changegraph.operators import templates as tp
from tests.test_operators import rows

REFS = "snapshot_id string, ref_id string, file string, lang string, scope_id string, type_id string, at int, kind string, name string, receiver string, arg string"
BINDINGS = "snapshot_id string, scope_id string, name string, at int, ord int, field boolean, type_name string"
SCOPES = "snapshot_id string, scope_id string, parent_id string, is_type boolean, file string"
VALUES = "snapshot_id string, value_id string, file string, lang string, scope_id string, name string, at int, ord int, text string"


def linked(spark, refs, bindings, scopes, values, modules, endpoints):
    df = lambda data, schema: spark.createDataFrame([("s", *r) for r in data], schema)
    refs, bindings, scopes = df(refs, REFS), df(bindings, BINDINGS), df(scopes, SCOPES)
    paths = sc.scope_paths(scopes).cache()
    asked = http.receiver_names(refs).where("bound_name IS NOT NULL").select("snapshot_id", "ref_id", "scope_id", "type_id", F.col("bound_name").alias("name"), "at", "fields_only")
    bound = sc.binding_lookup(asked, bindings, paths, df([], "snapshot_id string, type_id string, relative_id string, dist int"))
    calls = http.http_calls(refs, bound, df(modules, "snapshot_id string, file string, module string")).cache()
    none = lambda schema: df([], f"snapshot_id string, {schema}")
    texts = tp.expand_templates(
        calls.select("snapshot_id", F.col("ref_id").alias("expr_id"), "file", "lang", "scope_id", "at", "text"), df(values, VALUES), paths,
        none("file string, local string, name string, target_file string"), none("file string, type_name string, name string, value_id string, rank int"),
    )
    out, tags = http.called_urls(calls, texts)
    ends = df(endpoints, "snapshot_id string, endpoint_id string, method string, path string, context string")
    ends = ends.select("snapshot_id", "endpoint_id", "method", url_segments(F.col("path")).alias("segments"), url_segments(F.col("context")).alias("context"))
    return m.match_routes(out, ends), tags, calls


def test_every_call_of_a_front_finds_its_endpoint(spark):
    """Six resources with five calls each and a search: 31 of 31, all at 0.9."""
    refs, bindings, scopes, values, ends, want = [], [], [], [], [], []
    modules = []
    for res in ("owners", "pets", "pettypes", "specialties", "vets", "visits"):
        file, owner = f"web/{res}.ts", f"{res}Service"
        scopes.append((owner, None, True, file))
        bindings.append((owner, "http", 1, 1, True, "HttpClient"))
        values += [(f"{res}-url", file, "typescript", owner, "url", 2, 2, f"environment.api + '{res}'"), (f"{res}-env", file, "typescript", None, "environment", 1, 1, "{api: 'http://localhost:9966/petclinic/api/'}")]
        modules.append((file, http.HTTP_MODULE))
        calls = [("list", "get", "this.url", "GET", f"/api/{res}"), ("one", "get", "this.url + '/' + id", "GET", f"/api/{res}/{{id}}"), ("add", "post", "this.url", "POST", f"/api/{res}"), ("save", "put", "`${this.url}/${id}`", "PUT", f"/api/{res}/{{id}}"), ("drop", "delete", "this.url + '/' + x.id", "DELETE", f"/api/{res}/{{id}}")]
        if res == "owners":
            calls.append(("search", "get", "`${this.url}/list?lastName=${name}`", "GET", "/api/owners/list"))
        for k, (fn, verb, arg, method, path) in enumerate(calls):
            scope, ref = f"{owner}.{fn}", f"{res}.{fn}"
            scopes.append((scope, owner, False, file))
            refs.append((ref, file, "typescript", scope, owner, 10 + k, "call", verb, "this.http", arg))
            ends.append((f"{res}Controller.{fn}", method, path, "/petclinic"))
            want.append((ref, f"{res}Controller.{fn}", 0.9))
    got, tags, _ = linked(spark, refs, bindings, scopes, values, modules, ends)
    assert len(want) == 31
    assert [(a, b, round(c, 6)) for a, b, c in rows(got, "call_id", "endpoint_id", "confidence")] == sorted(want)
    assert ("ownersService.one", "GET /petclinic/api/owners/*") in rows(tags, "scope_id", "value")


def test_unknown_bases_and_missing_prefixes_are_less_sure(spark):
    scopes = [("S", None, True, "f"), ("S.all", "S", False, "f")]
    refs = [(f"r{k}", "f", "typescript", "S.all", "S", k, "call", verb, "this.http", arg) for k, (verb, arg) in enumerate((("get", "this.base + '/vets'"), ("get", "'/vets/' + id"), ("delete", "'/vets/1'")))]
    got, tags, _ = linked(spark, refs, [("S", "http", 0, 0, True, "HttpClient")], scopes, [], [], [("all", "GET", "/api/vets", None), ("one", "GET", "/api/vets/{id}", None)])
    assert [(a, b, round(c, 3)) for a, b, c in rows(got, "call_id", "endpoint_id", "confidence")] == [("r0", "all", 0.765), ("r1", "one", 0.54)]
    assert rows(tags, "value")[-1] == ("GET /vets/*",) and ("GET */vets",) in rows(tags, "value")


def test_which_calls_are_http_calls(spark):
    scopes = [("C", None, True, "f"), ("C.m", "C", False, "f"), ("D", None, True, "g"), ("D.m", "D", False, "g")]
    bindings = [("C", "rest", 0, 0, True, "RestTemplate"), ("C", "webClientBuilder", 0, 1, True, "Builder"), ("C", "map", 0, 2, True, "Map"), ("D", "api", 0, 0, True, "AxiosInstance")]
    data = [
        ("C.m", "java", "getForObject", "rest", "GET"), ("C.m", "java", "exchange", "this.rest", "ANY"), ("C.m", "java", "put", "map", None), ("C.m", "java", "put", "webClientBuilder", "PUT"),
        ("C.m", "kotlin", "uri", "client.get().foo.post()", "POST"), ("C.m", "kotlin", "uri", "client", None), ("D.m", "typescript", "fetch", None, "ANY"), ("D.m", "typescript", "fetch", "db", None),
        ("D.m", "typescript", "post", "axios", "POST"), ("D.m", "typescript", "get", "this.api", "GET"), ("D.m", "typescript", "get", "httpClient", "GET"), ("D.m", "typescript", "get", "params", None), ("D.m", "typescript", "close", "axios", None),
    ]
    refs = [(f"r{k:02}", s[0], lang, s, s[0], 9, "call", name, recv, "'/x'") for k, (s, lang, name, recv, _) in enumerate(data)]
    _, _, calls = linked(spark, refs, bindings, scopes, [], [("D", http.HTTP_MODULE)], [])
    assert rows(calls, "ref_id", "method") == [(f"r{k:02}", x[4]) for k, x in enumerate(data) if x[4]]


def test_clients_give_tags_and_roles(spark):
    df = lambda data, schema: spark.createDataFrame([("s", *r) for r in data], schema)
    refs = df([("r1", "f", "java", "C.m", "C", 3, "call", "get", "client.get().x", None), ("r2", "f", "java", "C.n", "C", 4, "call", "create", "WebClient", None), ("r3", "f", "java", "C.o", "C", 5, "call", "go", "list", None)], REFS)
    bindings = df([("C", "client", 0, 0, True, "RestClient"), ("C.n", "local", 1, 1, False, "RestTemplate")], BINDINGS)
    bound = df([("r1", "RestClient")], "snapshot_id string, ref_id string, type_name string")
    owners = df([("C", "C"), ("C.n", "C"), ("C.m", "C")], "snapshot_id string, scope_id string, type_id string")
    tags, roles = http.http_clients(refs, bindings, bound, owners)
    assert rows(tags, "scope_id", "value") == [("C", "rest_client"), ("C", "rest_template"), ("C.m", "rest_client"), ("C.n", "web_client")]
    assert rows(roles, "scope_id") == [("C",)]


def test_routes_equal_a_comparison_of_all_pairs(spark):
    rnd = random.Random(6)
    seg = lambda: rnd.choice(("api", "v1", "a", "b", "c", "{}", "{}"))
    made = lambda n: [[seg() for _ in range(rnd.randint(1, 5))] for _ in range(n)]
    calls = [(f"c{i}", f"e{rnd.randrange(60)}", rnd.choice(("GET", "POST", "ANY")), s, rnd.random() < 0.3) for i, s in enumerate(made(80)) if set(s) != {"{}"}]
    ends = [(f"e{i}", rnd.choice(("GET", "POST", "ANY")), s, rnd.choice((None, ["api"], ["ctx", "v1"]))) for i, s in enumerate(made(60))]

    def aligned(c, e, is_open):
        score, literal = 1.0, False
        for x, y in zip(reversed(c), reversed(e)):
            if x != "{}" and y != "{}":
                if x != y:
                    return 0.0
                literal = True
            score *= 1 if x == y else 0.85 if y == "{}" else 0.6
        more = len(e) - len(c)
        return score * literal * (1 if not more else (0.85 if is_open else 0.6) if more > 0 else 0.7)

    want = []
    for c, own, method, s, is_open in calls:
        scored = []
        for e, verb, t, ctx in ends:
            by = 1.0 if verb == method else 0.8 if "ANY" in (verb, method) else 0.0
            scored.append((max(aligned(s, x, is_open) for x in ([t] if ctx is None else [t, ctx + t])) * by, e))
        scored = [(x, e) for x, e in scored if x > 0 and e != own]
        top = [(e, x) for x, e in scored if x >= max(scored)[0] - 1e-4]
        if 0 < len(top) <= 5:
            want += [(c, e, round(0.9 * x / len(top), 9)) for e, x in top]
    c = spark.createDataFrame([("s", *x) for x in calls], "snapshot_id string, call_id string, from_id string, method string, segments array<string>, open boolean")
    e = spark.createDataFrame([("s", *x) for x in ends], "snapshot_id string, endpoint_id string, method string, segments array<string>, context array<string>")
    assert [(a, b, round(x, 9)) for a, b, x in rows(m.match_routes(c, e), "call_id", "endpoint_id", "confidence")] == sorted(want) and want
