"""HTTP clients and the calls they make, from references and the types of their receivers.

References: (snapshot_id, ref_id, file, lang, scope_id, at, kind, name, receiver, arg), ``arg`` being the text of the first
argument; bound: (ref_id, type_name), what ``binding_lookup`` finds for the names that
``receiver_names`` asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegraph.operators.graph import P

SCRIPTS = ("typescript", "tsx", "javascript")
JVM = ("java", "kotlin")
# Client types with their tags, types and modules of script clients, verbs and client methods.
CLIENTS = {"RestTemplate": "rest_template", "WebClient": "web_client", "RestClient": "rest_client"}
SCRIPT_CLIENTS = ("HttpClient", "AxiosInstance")
HTTP_MODULE = "@angular/common/http"
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
CLIENT_METHODS = {
    "getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "postForLocation": "POST",
    "put": "PUT", "delete": "DELETE", "patchForObject": "PATCH", "exchange": "ANY",
}
#: An unknown part of a URL.
WILD = "\u0000"


def _map(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def client_tag(type_name: Column, name: Column) -> Column:
    """The tag of a client type; of a ``Builder`` the one that the variable's name tells."""
    told = F.coalesce(*[F.when(F.contains(F.lower(name), F.lit(t.lower())), tag) for t, tag in CLIENTS.items()])
    return F.coalesce(_map(CLIENTS, type_name), F.when(type_name == "Builder", told))


def receiver_names(refs: DataFrame, root: bool = False) -> DataFrame:
    """Adds ``bound_name`` and ``fields_only``: the variable before a call (``this.http``, ``http``), null if that is no name.

    root: the first part of a chain of calls (``client`` of ``client.get().uri``)."""
    text = F.regexp_extract("receiver", r"^([^.(]*)", 1) if root else F.col("receiver")
    own = text.rlike(r"^this\??\.")
    name = F.regexp_replace(text, r"^this\??\.", "")
    return refs.withColumn("bound_name", F.when(name.rlike(r"^[\p{L}_$][\p{L}\p{N}_$]*$"), name)).withColumn("fields_only", F.coalesce(own, F.lit(False)))


def http_clients(refs: DataFrame, bindings: DataFrame, bound: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, roles): (scope_id, tag ``external``, value) of whatever holds or calls a client, (scope_id, role) of types with a client field.

    bindings: (scope_id, name, field, type_name); owners: (scope_id, type_id), the types around scopes; bound: for references with
    ``receiver_names(refs, root=True)``."""
    held = bindings.withColumn("value", client_tag(F.col("type_name"), F.col("name"))).where("value IS NOT NULL")
    held = held.join(owners, [P, "scope_id"], "left").withColumn("scope_id", F.coalesce("type_id", "scope_id"))
    calls = receiver_names(refs.where("kind = 'call' AND receiver IS NOT NULL"), root=True)
    calls = calls.join(bound.select(P, "ref_id", "type_name"), [P, "ref_id"], "left")
    root = F.regexp_extract("receiver", r"^([^.(]*)", 1)
    calls = calls.withColumn("value", F.coalesce(_map(CLIENTS, root), client_tag(F.col("type_name"), F.col("bound_name")))).where("value IS NOT NULL")
    tags = held.select(P, "scope_id", "value").unionByName(calls.select(P, "scope_id", "value")).distinct()
    roles = held.where("field").select(P, "scope_id", F.lit("external").alias("role")).distinct()
    return tags.select(P, "scope_id", F.lit("external").alias("tag"), "value"), roles


def http_calls(refs: DataFrame, bound: DataFrame, modules: DataFrame) -> DataFrame:
    """(ref_id, file, lang, scope_id, at, method, text): the references that are HTTP calls, with the expression of the URL.

    Scripts: ``fetch`` (ANY), a verb on axios, on a client by type, or on something named http in a file that
    imports the HTTP module. JVM: a client's methods by its type, and ``uri`` at the end of a chain with a verb, the
    last one. modules: (file, module), what files import."""
    rows = receiver_names(refs.where("kind = 'call' AND arg IS NOT NULL")).join(bound.select(P, "ref_id", "type_name"), [P, "ref_id"], "left")
    using = modules.where(F.col("module") == HTTP_MODULE).select(P, "file", F.lit(True).alias("_using")).distinct()
    rows = rows.join(using, [P, "file"], "left")
    verb = F.when(F.col("name").isin(*VERBS), F.upper("name"))
    typed = F.coalesce(F.col("type_name").isin(*SCRIPT_CLIENTS), F.lit(False))
    named = F.coalesce(F.contains(F.lower("bound_name"), F.lit("http")) & F.col("_using"), F.lit(False))
    script = F.when((F.col("name") == "fetch") & (F.col("receiver").isNull() | (F.col("receiver") == "window")), "ANY").when((F.col("receiver") == "axios") | typed | named, verb)
    last = F.upper(F.regexp_extract("receiver", rf"^.*\.({'|'.join(VERBS)})\(\)", 1))
    client = client_tag(F.col("type_name"), F.col("bound_name")).isNotNull()
    jvm = F.when(F.col("name") == "uri", F.nullif(last, F.lit(""))).when(client, _map(CLIENT_METHODS, F.col("name")))
    method = F.when(F.col("lang").isin(*SCRIPTS), script).when(F.col("lang").isin(*JVM), jvm)
    return rows.withColumn("method", method).where("method IS NOT NULL").select(P, "ref_id", "file", "lang", "scope_id", "at", "method", F.col("arg").alias("text"))


def template_url(parts: Column) -> Column:
    """(segments, open, path) of a template's parts: variables as ``{}``, ``open`` if an unknown base leads; segments are null without a literal one.

    Query, fragment, scheme and host go. ``path`` is for people, with ``*`` for what is unknown."""
    text = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(WILD))), "")
    text = F.trim(F.regexp_replace(text, r"(?s)[?#].*$", ""))
    path = F.when(text.rlike(r"^(https?:)?//"), F.regexp_replace(text, r"^(https?:)?//[^/]*", "")).otherwise(text)
    tail = F.regexp_replace(path, rf"^{WILD}+", "")
    variable = lambda x: x.rlike(rf"^[{{:*]|{WILD}")
    segments = F.transform(F.filter(F.split(tail, "/"), lambda x: x != ""), lambda x: F.when(variable(x), "{}").otherwise(x))
    shown = F.when((path == "") & (text != ""), "/").otherwise(F.translate(path, WILD, "*"))
    return F.struct(F.when(F.exists(segments, lambda x: x != "{}"), segments).alias("segments"), path.startswith(WILD).alias("open"), shown.alias("path"))


def called_urls(calls: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls for ``match_routes``, tags): the URLs of ``http_calls`` once ``expand_templates`` has worked out their texts (expr_id = ref_id)."""
    rows = calls.join(templates.select(P, F.col("expr_id").alias("ref_id"), "parts"), [P, "ref_id"]).withColumn("_u", template_url(F.col("parts")))
    tags = rows.select(P, "scope_id", F.lit("http.calls").alias("tag"), F.concat_ws(" ", "method", "_u.path").alias("value")).distinct()
    out = rows.where("_u.segments IS NOT NULL").select(P, F.col("ref_id").alias("call_id"), F.col("scope_id").alias("from_id"), "method", "_u.segments", "_u.open", F.col("at").alias("line"))
    return out, tags
