"""Rules that classify symbols by their annotations: roles, tags and edges as DataFrames.

defs: (snapshot_id, symbol_id, kind, parent_id, annotations array<struct<name, args:
array<struct<key, value>>>>).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegraph.functions.text import join_path
from changegraph.operators.graph import CALLABLE_KINDS, TYPE_KINDS, P, closure

# Annotations that give a class its role.
STEREOTYPES = {
    "Component": "component", "Service": "service", "Repository": "repository", "Controller": "controller", "RestController": "controller",
    "Configuration": "configuration", "Entity": "entity", "Document": "entity", "MappedSuperclass": "entity",
}
# Annotations of request handlers, with their method.
VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "ANY"}
# Annotations of listeners, with their kind.
LISTENERS = {
    "KafkaListener": "listener", "RabbitListener": "listener", "JmsListener": "listener", "SqsListener": "listener", "EventListener": "listener",
    "TransactionalEventListener": "listener", "Scheduled": "scheduled",
}


@dataclass
class RuleOutput:
    edges: DataFrame | None = None
    roles: DataFrame | None = None
    tags: DataFrame | None = None


class Rule(Protocol):
    """A plug-in: facts and the graph so far in, edges, roles and tags out."""

    name: str

    def apply(self, facts: dict[str, DataFrame], graph: dict[str, DataFrame]) -> RuleOutput: ...


def apply_rules(rules: list[Rule], facts: dict[str, DataFrame], graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Runs rules in order; each sees what earlier ones added."""
    for rule in rules:
        out = rule.apply(facts, graph)
        for key in ("edges", "roles", "tags"):
            more = getattr(out, key)
            if more is not None:
                graph = graph | {key: graph[key].unionByName(more) if key in graph else more}
    return graph


def annotations(defs: DataFrame) -> DataFrame:
    return defs.select(P, "symbol_id", "parent_id", "kind", F.explode("annotations").alias("a")).select(P, "symbol_id", "parent_id", "kind", "a.name", "a.args")


def _dimension(df: DataFrame, values: dict[str, str], name: str) -> DataFrame:
    """Rows whose annotation is in a small fixed dictionary, with its value."""
    known = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return df.withColumn(name, F.try_element_at(known, F.col("name"))).where(F.col(name).isNotNull())


def assign_roles(defs: DataFrame) -> DataFrame:
    """(snapshot_id, symbol_id, role) from stereotype annotations."""
    return _dimension(annotations(defs), STEREOTYPES, "role").select(P, "symbol_id", "role").distinct()


def _argument(*keys: str) -> Column:
    """Values of an annotation's arguments by key (none counts as ``value``)."""
    return F.transform(F.filter("args", lambda x: F.coalesce(x["key"], F.lit("value")).isin(*keys)), lambda x: x["value"])


def endpoint_routes(defs: DataFrame) -> DataFrame:
    """(symbol_id, method, route) of request handlers: prefixes of the class times the method's own paths."""
    found = _dimension(annotations(defs), VERBS, "method").withColumn("path", F.explode_outer(_argument("value", "path")))
    prefixes = found.where("kind = 'class'").select(P, F.col("symbol_id").alias("parent_id"), F.coalesce("path", F.lit("")).alias("prefix"))
    own = found.where("kind <> 'class'").join(prefixes, [P, "parent_id"], "left")
    route = join_path(F.coalesce("prefix", F.lit("")), F.coalesce("path", F.lit("")))
    clean = F.regexp_replace(F.concat(F.lit("/"), route), "/+", "/")
    return own.select(P, "symbol_id", "method", F.when(clean == "/", clean).otherwise(F.regexp_replace(clean, "/$", "")).alias("route")).distinct()


def entry_points(defs: DataFrame) -> DataFrame:
    """(symbol_id, entry_kind, target) of listeners and scheduled methods."""
    found = _dimension(annotations(defs), LISTENERS, "entry_kind")
    return found.select(P, "symbol_id", "entry_kind", F.array_join(_argument("value", "topics", "queues", "destination", "cron", "fixedRate"), ",").alias("target")).distinct()


def repository_closure(supers: DataFrame, repositories: DataFrame, cap: int = 64) -> DataFrame:
    """(symbol_id, role): types that extend a repository, at any distance up to ``cap``. supers: (from_id sub, to_id super)."""
    down = supers.select(P, F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    reach = closure(down, repositories.select(P, F.col("symbol_id").alias("start_id")), cap)
    return reach.select(P, F.col("node_id").alias("symbol_id"), F.lit("repository").alias("role")).distinct()


def merge_tags(*tags: DataFrame) -> DataFrame:
    """One row for each (symbol_id, key, value)."""
    return reduce(DataFrame.unionByName, tags).dropDuplicates([P, "symbol_id", "key", "value"])


def test_naming_edges(files: DataFrame, types: DataFrame) -> DataFrame:
    """``FooTest`` (Tests, IT, TestCase) tests the type ``Foo`` of its package: (from_id, to_id, kind, confidence)."""
    stem = F.regexp_extract("name", r"^(.+?)(Tests|Test|IT|TestCase)$", 1)
    tests = files.withColumn("stem", stem).where("stem <> ''").select(P, "package", F.col("symbol_id").alias("from_id"), F.col("stem").alias("name"))
    return tests.join(types.select(P, "package", "name", F.col("symbol_id").alias("to_id")), [P, "package", "name"]).select(P, "from_id", "to_id", F.lit("tests").alias("kind"), F.lit(0.8).alias("confidence"))


def test_file_edges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``x.spec.ts`` and ``x.test.ts`` test the top-level types and callables of ``x.ts``: (from_id, to_id, kind, confidence, line).

    files: (path, is_test), a file's symbol having its path as id."""
    tests = files.where("is_test").withColumn("file", F.regexp_replace("path", r"^(.*?)\.(spec|test)\.(.*)$", "$1.$3")).where("file <> path")
    top = symbols.where((F.col("container_id").isNull() | (F.col("container_id") == F.col("file"))) & F.col("kind").isin(*TYPE_KINDS, *CALLABLE_KINDS))
    return tests.join(top.select(P, "file", F.col("symbol_id").alias("to_id")), [P, "file"]).select(P, F.col("path").alias("from_id"), "to_id", F.lit("tests").alias("kind"), F.lit(0.8).alias("confidence"), F.lit(1).alias("line"))


def inject_targets(points: DataFrame, beans: DataFrame, supers: DataFrame, most: int = 5) -> DataFrame:
    """(from_id, to_id, confidence): managed subtypes of an injection point's type; narrowed by qualifier, primary, then parameter name.

    points: (point_id, from_id, type_id, qualifier, name); beans: (symbol_id, bean, is_primary)."""
    down = supers.select(P, F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    reach = closure(down, points.select(P, F.col("type_id").alias("start_id")).distinct(), 64)
    sub = reach.select(P, F.col("start_id").alias("type_id"), F.col("node_id").alias("symbol_id"))
    rows = points.join(sub, [P, "type_id"]).join(beans, [P, "symbol_id"])
    rank = F.when(F.col("bean") == F.col("qualifier"), 0).when(F.col("is_primary"), 1).when(F.col("bean") == F.col("name"), 2).otherwise(3)
    best = rows.withColumn("_rank", rank).groupBy(P, "point_id").agg(F.min("_rank").alias("_rank"))
    rows = rows.withColumn("_rank", rank).join(best, [P, "point_id", "_rank"])
    n = rows.groupBy(P, "point_id").agg(F.count("*").alias("_n")).where(F.col("_n") <= most)
    return rows.join(n, [P, "point_id"]).select(P, "from_id", F.col("symbol_id").alias("to_id"), (0.9 / F.col("_n")).alias("confidence"))
