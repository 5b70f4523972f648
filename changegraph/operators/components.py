"""User interface components: decorators, selectors in templates, provided types, routes with their prefixes.

Definitions: (snapshot_id, symbol_id, file, kind, annotations), annotations being (name, line, args of (key, value)), values as
they stand in the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changegraph.functions.text import unquote
from changegraph.operators.graph import P, store
from changegraph.operators.resolution import resolve_types

TEMPLATE, INJECT, MEMBER = 0.9, 0.9, 0.95
# What lists of modules name, and names in them that say nothing.
LISTS = ("declarations", "imports", "providers", "bootstrap", "exports")
EVERYWHERE = ("RouterModule", "BrowserModule")
PROVIDED = r"provide:\s*([\p{L}_$][\p{L}\p{N}_$]*)\s*,[^}]*?(?:useClass|useExisting):\s*([\p{L}\p{N}_$]+)"
NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"
#: Rounds of prefixes over lazy links, and prefixes of a file.
ROUNDS, MOST_PREFIXES = 6, 8


def selector_elements(selector: Column) -> Column:
    """The element names of a selector list: ``app-a, app-b[x], [y]`` gives app-a and app-b."""
    names = F.transform(F.split(selector, ","), lambda x: F.regexp_extract(F.lower(F.trim(x)), r"^([A-Za-z][\w-]*)", 1))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def ui_components(defs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(facts, selectors, templates, uses, providers) of decorated classes.

    facts: (symbol_id, kind role or tag, name, value); selectors: (element, component_id); templates: (symbol_id, url, inline, line); uses: (symbol_id,
    file, name, line), types that a component imports or a module lists; providers: (file, token, name)."""
    rows = defs.where("kind = 'class'").select(P, "symbol_id", "file", F.explode("annotations").alias("a"))
    args = rows.select(P, "symbol_id", "file", F.col("a.name").alias("decorator"), F.col("a.line").alias("line"), F.explode("a.args").alias("arg"))
    args = store(args.select(P, "symbol_id", "file", "decorator", "line", F.col("arg.key").alias("key"), F.col("arg.value").alias("value"), unquote(F.trim("arg.value")).alias("text")))
    kind = rows.select(P, "symbol_id", F.col("a.name").alias("decorator"))
    fact = lambda df, what, name, value: df.select(P, "symbol_id", F.lit(what).alias("kind"), F.lit(name).alias("name"), value.alias("value"))
    none = F.lit(None).cast("string")
    visible = ("Component", "Directive")
    at = lambda decorators, key: args.where(F.col("decorator").isin(*decorators) & (F.col("key") == key))
    injectable = kind.where("decorator = 'Injectable'").join(at(["Injectable"], "providedIn").select(P, "symbol_id", "text"), [P, "symbol_id"], "left")
    parts = [
        fact(kind.where(F.col("decorator").isin(*visible, "Pipe", "Injectable")), "role", "component", none), fact(kind.where("decorator = 'Component'"), "role", "view", none),
        fact(kind.where("decorator = 'NgModule'"), "role", "config", none), fact(at(visible, "selector"), "tag", "angular.selector", F.col("text")),
        fact(at(visible, "templateUrl"), "tag", "angular.template", F.col("text")), fact(at(["Pipe"], "name"), "tag", "angular.pipe", F.col("text")),
        fact(injectable, "tag", "angular.provided_in", F.coalesce("text", F.lit("module"))),
    ]
    facts = parts[0]
    for df in parts[1:]:
        facts = facts.unionByName(df)
    selectors = at(visible, "selector").select(P, F.explode(selector_elements(F.col("text"))).alias("element"), F.col("symbol_id").alias("component_id")).distinct()
    templates = args.where(F.col("decorator").isin(*visible) & F.col("key").isin("templateUrl", "template"))
    templates = templates.select(P, "symbol_id", F.when(F.col("key") == "templateUrl", F.col("text")).alias("url"), F.when(F.col("key") == "template", F.col("text")).alias("inline"), "line")
    named = args.where((F.col("decorator").isin(*visible) & (F.col("key") == "imports")) | ((F.col("decorator") == "NgModule") & F.col("key").isin(*LISTS)))
    uses = named.select(P, "symbol_id", "file", F.explode(F.regexp_extract_all("value", F.lit(NAME), F.lit(0))).alias("name"), "line").where(~F.col("name").isin(*EVERYWHERE)).distinct()
    return facts.distinct(), selectors, templates, uses, providers(at([*visible, "NgModule"], "providers").select(P, "file", F.col("value").alias("text")))


def providers(texts: DataFrame) -> DataFrame:
    """(file, token, name) of ``{provide: Token, useClass: Name}`` and ``useExisting`` in texts (file, text)."""
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(PROVIDED), F.lit(1)).alias("token"), F.regexp_extract_all("text", F.lit(PROVIDED), F.lit(2)).alias("name"))
    return texts.select(P, "file", F.explode(found).alias("p")).select(P, "file", "p.token", "p.name").distinct()


def component_injection(points: DataFrame, provided: DataFrame, symbols: DataFrame, imports: DataFrame, wildcards: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, confidence, line) of injection points (point_id, from_id, file, package, name, line).

    A token that providers name gives what they provide, each as surely as its name resolves where it is provided, shared
    among all; else the type of that name; else a top-level constant of the file or one that it imports."""
    refs = provided.select(P, F.concat_ws("|", "file", "token", "name").alias("ref_id"), "file", F.lit(None).cast("string").alias("package"), "name", "token").distinct()
    made = resolve_types(refs.drop("token"), symbols, imports, wildcards, most=None).join(refs.select(P, "ref_id", "token"), [P, "ref_id"])
    made = made.withColumn("confidence", F.col("confidence") / F.count("*").over(Window.partitionBy(P, "token"))).select(P, F.col("token").alias("name"), "symbol_id", "confidence")
    asked = points.withColumn("ref_id", F.col("point_id").cast("string"))
    first = store(asked.join(made, [P, "name"]).select(P, "ref_id", "symbol_id", "confidence"))
    left = asked.join(first.select(P, "ref_id").distinct(), [P, "ref_id"], "left_anti")
    second = store(resolve_types(left, symbols, imports, wildcards, most=None).select(P, "ref_id", "symbol_id", "confidence"))
    left = left.join(second.select(P, "ref_id").distinct(), [P, "ref_id"], "left_anti").select(P, "ref_id", "file", "name")
    top = symbols.where("container_id IS NULL OR container_id = file").select(P, "file", "name", "symbol_id")
    own = left.join(top, [P, "file", "name"]).select(P, "ref_id", "symbol_id", F.lit(0).alias("far"))
    exported = F.col("exported") if "exported" in imports.columns else F.col("name")
    target = F.col("target_file") if "target_file" in imports.columns else F.lit(None).cast("string")
    brought = left.join(imports.select(P, "file", "name", exported.alias("_name"), target.alias("_file")), [P, "file", "name"])
    brought = brought.join(top.select(P, F.col("file").alias("_file"), F.col("name").alias("_name"), "symbol_id"), [P, "_file", "_name"]).select(P, "ref_id", "symbol_id", F.lit(1).alias("far"))
    third = own.unionByName(brought).groupBy(P, "ref_id").agg(F.min_by("symbol_id", F.struct("far", "symbol_id")).alias("symbol_id")).withColumn("confidence", F.lit(1.0))
    rows = first.unionByName(second).unionByName(third).join(asked.select(P, "ref_id", "from_id", "line"), [P, "ref_id"])
    return rows.select(P, "from_id", F.col("symbol_id").alias("to_id"), F.lit("injects").alias("kind"), (INJECT * F.col("confidence")).alias("confidence"), "line")


def template_component_edges(elements: DataFrame, selectors: DataFrame, templates: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, confidence, line): components that templates use, and the owners of the templates with them.

    elements: (file, name, line), of template files or, under a component's id, of its inline template; selectors: (element,
    component_id); templates: (symbol_id, file, line), owners of template files. An element that several selectors name is shared."""
    k = F.count("*").over(Window.partitionBy(P, "element"))
    known = selectors.distinct().withColumn("confidence", F.lit(TEMPLATE) / k).withColumnRenamed("element", "name")
    own = elements.join(known, [P, "name"]).select(P, F.col("file").alias("from_id"), F.col("component_id").alias("to_id"), "confidence", "line")
    used = own.groupBy(P, F.col("from_id").alias("file"), "to_id").agg(F.max("confidence").alias("confidence"))
    lifted = templates.join(used, [P, "file"]).select(P, F.col("symbol_id").alias("from_id"), "to_id", "confidence", "line")
    return own.unionByName(lifted).select(P, "from_id", "to_id", F.lit("routes").alias("kind"), "confidence", "line").distinct()


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.split(F.concat_ws("/", *parts), "/"), lambda x: x != ""), "/")


def own_paths(routes: DataFrame) -> DataFrame:
    """(route_id, file, path): each route's path through its parents; paths double in each round."""
    rows = store(routes.select(P, "route_id", "file", "path", F.col("parent_id").alias("up")))
    while not rows.where("up IS NOT NULL").isEmpty():
        above = rows.select(P, F.col("route_id").alias("up"), F.col("path").alias("_path"), F.col("up").alias("_up"))
        rows = store(rows.join(above, [P, "up"], "left").select(P, "route_id", "file", _joined(F.coalesce("_path", F.lit("")), F.col("path")).alias("path"), F.col("_up").alias("up")))
    return rows.select(P, "route_id", "file", _joined(F.col("path")).alias("path"))


def route_prefixes(routes: DataFrame, lazy: DataFrame) -> DataFrame:
    """(route_id, full_path): every path that a route is reached by.

    routes: (route_id, file, path, parent_id); lazy: (route_id, target_file, ord), routes that load a file's routes below
    them. Prefixes of files spread over lazy links until nothing changes, at most six rounds, so cycles end; a
    file keeps the first eight, by the order of the links and then of the prefixes they had."""
    paths = store(own_paths(routes))
    links = store(lazy.join(paths, [P, "route_id"]).select(P, "file", "target_file", "ord", "path"))
    prefixes = store(links.where("false").select(P, "file", F.lit("").alias("prefix"), F.lit(0).alias("rank")))
    for _ in range(ROUNDS):
        found = links.join(prefixes, [P, "file"], "left")
        found = found.select(P, F.col("target_file").alias("file"), _joined(F.coalesce("prefix", F.lit("")), F.col("path")).alias("prefix"), F.struct("ord", F.coalesce("rank", F.lit(0)).alias("rank")).alias("_at"))
        found = found.groupBy(P, "file", "prefix").agg(F.min("_at").alias("_at"))
        rank = F.row_number().over(Window.partitionBy(P, "file").orderBy("_at", "prefix"))
        later = store(found.withColumn("rank", rank).where(F.col("rank") <= MOST_PREFIXES).select(P, "file", "prefix", "rank"))
        same = later.exceptAll(prefixes).isEmpty() and prefixes.exceptAll(later).isEmpty()
        prefixes = later
        if same:
            break
    out = paths.join(prefixes, [P, "file"], "left")
    return out.select(P, "route_id", F.concat(F.lit("/"), _joined(F.coalesce("prefix", F.lit("")), F.col("path"))).alias("full_path")).distinct()
