"""Links that frameworks make: events, operations of specifications, environment files, repositories and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changegraph.functions.text import join_path
from changegraph.operators.graph import P, store
from changegraph.operators.resolution import hierarchy, resolve_types

# Annotations of entities, supertypes of generated repositories, verbs of specifications.
ENTITIES = ("Entity", "Document", "Embeddable", "MappedSuperclass", "Table")
DATA_REPOSITORIES = (
    "Repository", "CrudRepository", "ListCrudRepository", "PagingAndSortingRepository", "ListPagingAndSortingRepository", "JpaRepository", "MongoRepository",
    "ReactiveCrudRepository", "ReactiveMongoRepository", "ReactiveSortingRepository", "R2dbcRepository", "CoroutineCrudRepository", "CoroutineSortingRepository", "ElasticsearchRepository", "Neo4jRepository", "CassandraRepository",
    "KeyValueRepository",
)
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")


def match_publishers_to_listeners(publishes: DataFrame, listeners: DataFrame, symbols: DataFrame, imports: DataFrame, wildcards: DataFrame, inherits: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, confidence, line): who publishes an event that a listener listens to.

    publishes: (from_id, file, package, event, line); listeners: (symbol_id, file, package, types). A listener of the event's type or
    of a supertype at 0.85. A listener none of whose types is known, by name, at 0.6."""
    sent = store(publishes.withColumn("ref_id", F.concat_ws("|", "file", "event")))
    heard = store(listeners.select(P, "symbol_id", "file", "package", F.explode("types").alias("name")).withColumn("ref_id", F.concat_ws("|", "symbol_id", "name")))
    find = lambda df: resolve_types(df.select(P, "ref_id", "file", "package", "name").distinct(), symbols, imports, wildcards, most=None).select(P, "ref_id", F.col("symbol_id").alias("type_id"))
    event = store(find(sent.withColumnRenamed("event", "name")))
    types = store(find(heard).join(heard.select(P, "ref_id", "symbol_id"), [P, "ref_id"]).select(P, "symbol_id", "type_id").distinct())
    levels = hierarchy(inherits, event.select(P, F.col("type_id").alias("symbol_id")).distinct())
    family = store(event.join(levels, [P, "type_id"]).select(P, "ref_id", F.col("relative_id").alias("type_id")).distinct())
    sure = family.join(types, [P, "type_id"]).select(P, "ref_id", "symbol_id", F.lit(0.85).alias("confidence"))
    names = family.join(symbols.select(P, F.col("symbol_id").alias("type_id"), "name"), [P, "type_id"]).select(P, "ref_id", "name")
    names = names.union(sent.select(P, "ref_id", F.col("event").alias("name"))).distinct()
    unknown = heard.join(types.select(P, "symbol_id").distinct(), [P, "symbol_id"], "left_anti").select(P, "symbol_id", "name")
    guess = names.join(unknown, [P, "name"]).select(P, "ref_id", "symbol_id", F.lit(0.6).alias("confidence"))
    best = sure.unionByName(guess).groupBy(P, "ref_id", "symbol_id").agg(F.max("confidence").alias("confidence"))
    return sent.select(P, "ref_id", "from_id", "line").join(best, [P, "ref_id"]).select(P, "from_id", F.col("symbol_id").alias("to_id"), F.lit("publishes").alias("kind"), "confidence", "line").distinct()


def bind_operations(config: DataFrame, controllers: DataFrame, methods: DataFrame, routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, tags): operations of API specifications and the controller methods of their names.

    config: (file, key, value, line) of YAML; a file with a key ``openapi`` or ``swagger`` is a specification, its keys
    ``paths.<path>.<verb>.operationId`` name operations; controllers: (symbol_id, prefixes, context), those with a supertype outside; methods:
    (symbol_id, container_id, name); routed: (symbol_id), methods that have a route already."""
    specs = config.where("key IN ('openapi', 'swagger')").select(P, "file").distinct()
    key = r"^paths\.(.*)\.([^.]*)\.operationId$"
    ops = config.where(F.col("key").rlike(key) & F.col("value").isNotNull()).join(specs, [P, "file"], "left_semi")
    ops = ops.select(P, "file", "line", F.col("value").alias("name"), F.regexp_extract("key", key, 1).alias("path"), F.upper(F.regexp_extract("key", key, 2)).alias("verb")).where(F.col("verb").isin(*HTTP_METHODS))
    own = methods.join(controllers.select(P, F.col("symbol_id").alias("container_id"), "prefixes", "context"), [P, "container_id"]).join(routed.select(P, "symbol_id"), [P, "symbol_id"], "left_anti")
    rows = store(own.join(ops, [P, "name"]))
    edges = rows.select(P, F.col("file").alias("from_id"), F.col("symbol_id").alias("to_id"), F.lit("configures").alias("kind"), F.lit(0.8).alias("confidence"), "line").distinct()
    tag = lambda df, k, v: df.select(P, "symbol_id", F.lit(k).alias("key"), v.alias("value"))
    prefixed = rows.withColumn("prefix", F.explode(F.when(F.size("prefixes") > 0, F.col("prefixes")).otherwise(F.array(F.lit("")))))
    route = F.concat(F.lit("/"), F.regexp_replace(join_path(F.col("prefix"), F.col("path")), "^/+", ""))
    tags = tag(prefixed, "http.route", F.concat("verb", F.lit(" "), route)).unionByName(tag(rows, "http.spec", F.col("file"))).unionByName(tag(rows, "entry", F.lit("http")))
    return edges, tags.unionByName(tag(rows.where("context IS NOT NULL"), "http.context_path", F.col("context"))).distinct()


def environment_edges(files: DataFrame, imports: DataFrame, texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, confidence, line): what an environment file, and its variants in the same folder, configure.

    files: (path); imports: (file, local, name, target_file, line); texts: (file, scope_id, line, text), values and arguments. Whoever writes
    ``local.`` reads the imported file (0.9) and may read its variants (0.6); if nobody does, the importing file does. The edge
    leaves the file's top-level symbol of the imported name, else the file."""
    folder = lambda c: F.regexp_extract(c, r"^(.*/)?[^/]*$", 1)
    envs = store(files.where(F.col("path").rlike(r"(^|/)environment[^/]*$")).select(P, F.col("path").alias("target_file"), folder("path").alias("folder")))
    # The environment files are few, but the imports of each name are not: imports are dealt by their target.
    used = store(imports.join(envs, [P, "target_file"]).join(envs.select(P, F.col("target_file").alias("file")), [P, "file"], "left_anti").select(P, "file", "local", "name", "target_file", "folder", "line"))
    read = used.select(P, "file", "local").distinct().join(texts, [P, "file"]).where(F.contains("text", F.concat("local", F.lit(".")))).select(P, "file", "local", F.coalesce("scope_id", "file").alias("to_id")).distinct()
    reads = used.join(read, [P, "file", "local"], "left").withColumn("to_id", F.coalesce("to_id", "file"))
    rows = reads.join(envs.select(P, "folder", F.col("target_file").alias("variant")), [P, "folder"])
    top = symbols.where("container_id IS NULL OR container_id = file").groupBy(P, F.col("file").alias("variant"), "name").agg(F.min_by(F.struct("symbol_id", "line"), "line").alias("_s"))
    rows = rows.join(top, [P, "variant", "name"], "left")
    sure = F.when(F.col("variant") == F.col("target_file"), 0.9).otherwise(0.6)
    return rows.groupBy(P, F.coalesce("_s.symbol_id", "variant").alias("from_id"), "to_id", F.lit("configures").alias("kind")).agg(F.max(sure).alias("confidence"), F.min(F.coalesce("_s.line", F.lit(1))).alias("line"))


def persistence_facts(defs: DataFrame, supers: DataFrame, symbols: DataFrame, imports: DataFrame, wildcards: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roles, tags, edges) of entities and of repositories that a framework generates.

    defs: (symbol_id, kind, line, annotations); supers: (symbol_id, file, package, name, argument), the supertypes of types as written with the first type
    argument. An entity annotation makes an entity, with its table. An interface that extends a repository type which
    is not in the code is a repository; it works on its type argument (``uses``, 0.95 times the type)."""
    notes = defs.select(P, "symbol_id", F.explode("annotations").alias("a"))
    entity = notes.where(F.col("a.name").isin(*ENTITIES)).select(P, "symbol_id").distinct()
    argument = lambda k: F.get(F.filter("a.args", lambda x: F.coalesce(x["key"], F.lit("value")) == k), 0)["value"]
    table = notes.where("a.name = 'Table'").join(entity, [P, "symbol_id"], "left_semi").select(P, "symbol_id", F.lit("persistence.table").alias("key"), F.coalesce(argument("name"), argument("value")).alias("value")).where("value IS NOT NULL")
    interfaces = defs.where("kind = 'interface'").select(P, "symbol_id", "line")
    based = supers.where(F.col("name").isin(*DATA_REPOSITORIES)).join(interfaces, [P, "symbol_id"]).withColumn("ref_id", F.concat_ws("|", "symbol_id", "name"))
    known = resolve_types(based.select(P, "ref_id", "file", "package", "name").distinct(), symbols, imports, wildcards, most=None).select(P, "ref_id").distinct()
    repos = store(based.join(known, [P, "ref_id"], "left_anti"))
    role = lambda df, r: df.select(P, "symbol_id", F.lit(r).alias("role"))
    roles = role(entity, "entity").unionByName(role(repos, "repository")).distinct()
    tag = lambda df, k, v: df.select(P, "symbol_id", F.lit(k).alias("key"), v.alias("value"))
    tags = table.unionByName(tag(repos, "persistence", F.lit("spring_data"))).unionByName(tag(repos.where("argument IS NOT NULL"), "persistence.entity", F.col("argument"))).distinct()
    asked = repos.where("argument IS NOT NULL").select(P, "symbol_id", "line", F.concat_ws("|", "symbol_id", "argument").alias("ref_id"), "file", "package", F.col("argument").alias("name")).distinct()
    found = resolve_types(asked.select(P, "ref_id", "file", "package", "name"), symbols, imports, wildcards, most=None).select(P, "ref_id", F.col("symbol_id").alias("to_id"), "confidence")
    edges = asked.select(P, "ref_id", F.col("symbol_id").alias("from_id"), "line").join(found, [P, "ref_id"])
    return roles, tags, edges.select(P, "from_id", "to_id", F.lit("uses").alias("kind"), (0.95 * F.col("confidence")).alias("confidence"), "line")
