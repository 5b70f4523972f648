"""Fact tables: reading, choosing sources, reuse by content, keys, elements, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegraph.functions.paths import language, matches_any
from changegraph.operators.graph import store

#: Fields of each list of a file's facts.
FACTS = {
    "defs": "name string, kind string, span struct<start:int,`end`:int>, line int, parent_pos int, params int, variadic boolean, type_name string, modifiers array<string>",
    "refs": "kind string, name string, receiver string, arity int, line int, scope int, arg string",
    "imports": "module string, names array<struct<name:string,alias:string>>, wildcard boolean, alias string, is_static boolean, line int",
    "bindings": "name string, type_name string, scope int, field boolean, line int",
    "values": "name string, text string, scope int, line int",
    "routes": "route string, component string, redirect string, parent_pos int, line int, scope int",
    "config": "key string, value string, line int",
    "elements": "name string, line int",
}


def file_index_schema() -> str:
    """Schema of a JSON document of one file's facts."""
    struct = lambda fields: ", ".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in _fields(fields)))
    return "snapshot_id string, path string, " + ", ".join(f"`{k}` array<struct<{struct(v)}>>" for k, v in FACTS.items())


def _fields(text: str) -> list[str]:
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def read_fact_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One table for each list of facts, with (snapshot_id, path, pos), from JSON documents."""
    docs = spark.read.schema(file_index_schema()).json(path)
    return {k: docs.select("snapshot_id", "path", F.posexplode(k).alias("pos", "x")).select("snapshot_id", "path", "pos", "x.*") for k in FACTS}


def select_sources(tree: DataFrame, skip: tuple[str, ...] = (), max_bytes: int = 512 * 1024) -> tuple[DataFrame, DataFrame]:
    """(files to read, counts of the skipped by reason) of (snapshot_id, path, size)."""
    reason = F.when(language(F.col("path")).isNull(), "language").when(F.col("size") > max_bytes, "size").when(matches_any(F.col("path"), skip), "glob")
    rows = tree.withColumn("_reason", reason)
    return rows.where("_reason IS NULL").drop("_reason"), rows.where("_reason IS NOT NULL").groupBy("snapshot_id", F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))


def dedupe_by_content(tree: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blob, lang) still to be processed, once each, and those that earlier results cover; tree: (path, blob, lang)."""
    blobs = tree.select("blob", "lang").distinct()
    return blobs.join(known, ["blob", "lang"], "left_anti"), blobs.join(known, ["blob", "lang"], "left_semi")


def fan_out(tree: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of a blob for every path that holds it."""
    return tree.join(facts, ["blob", "lang"])


def union_snapshots(a: DataFrame, b: DataFrame, prefix: str) -> DataFrame:
    """Both repositories in one snapshot; paths of the second go below ``prefix``."""
    return a.unionByName(b.withColumn("path", F.concat(F.lit(prefix + "/"), F.col("path"))))


def json_keys(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, key, value) of the leaves of a JSON object, keys dotted, level by level."""
    level = df.select(F.col(id_col).alias("id"), F.lit("").alias("prefix"), F.try_parse_json(json_col).alias("v"))
    out = None
    while True:
        rows = store(_exploded(level))
        key = F.concat("prefix", "key")
        leaf = rows.where("NOT startswith(schema_of_variant(value), 'OBJECT')").select("id", key.alias("key"), F.expr("try_variant_get(value, '$', 'string')").alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        deeper = rows.where("startswith(schema_of_variant(value), 'OBJECT')")
        if deeper.isEmpty():
            return out
        level = deeper.select("id", F.concat(key, F.lit(".")).alias("prefix"), F.col("value").alias("v"))


def _exploded(level: DataFrame) -> DataFrame:
    return level.selectExpr("id", "prefix", "v").withColumn("_m", F.expr("try_variant_get(v, '$', 'map<string,variant>')")).select("id", "prefix", F.explode("_m").alias("key", "value"))


def properties_keys(files: DataFrame) -> DataFrame:
    """(file, key, value, line) of ``key=value`` text; comments and blank lines left out."""
    rows = files.select("file", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(~F.col("text").rlike(r"^\s*([#!]|$)"))
    parts = r"^\s*([^=:\s]+)\s*[=:]\s*(.*?)\s*$"
    return rows.where(F.col("text").rlike(parts)).select("file", F.regexp_extract("text", parts, 1).alias("key"), F.substring(F.regexp_extract("text", parts, 2), 1, 200).alias("value"), (F.col("pos") + 1).alias("line"))


def yaml_keys(files: DataFrame) -> DataFrame:
    """(file, key, value, line) of indented ``key: value`` text: dotted keys of the leaves.

    A fold over a file's lines keeps the open keys with their indents; ``---`` starts anew,
    block scalars give their key without a value."""
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("line"), F.regexp_replace(t, r"\s+#.*$", "").alias("t")))
    pattern = r"^(\s*)(?:- )?\s*([A-Za-z0-9_.\"'/-]+)\s*:(?:\s+(.*?))?\s*$"
    zero = F.expr("named_struct('stack', cast(array() as array<struct<indent:int,key:string>>), 'out', cast(array() as array<struct<key:string,value:string,line:int>>))")

    def fold(acc, x):
        text = x["t"]
        hit = text.rlike(pattern) & ~text.rlike(r"^\s*(#|$)")
        indent = F.length(F.regexp_extract(text, pattern, 1)).cast("int")
        open_ = F.filter(acc["stack"], lambda s: s["indent"] < indent)
        name = F.regexp_replace(F.regexp_extract(text, pattern, 2), "[\"']", "")
        value = F.regexp_extract(text, pattern, 3)
        stack = F.array_append(open_, F.struct(indent.alias("indent"), name.alias("key")))
        key = F.array_join(F.transform(stack, lambda s: s["key"]), ".")
        leaf = value != ""
        plain = F.when(~value.rlike(r"^[|>][+-]?$"), F.substring(F.regexp_replace(value, "^[\"'](.*)[\"']$", "$1"), 1, 200))
        out = F.when(leaf, F.array_append(acc["out"], F.struct(key.alias("key"), plain.alias("value"), x["line"].cast("int").alias("line")))).otherwise(acc["out"])
        empty = F.expr("cast(array() as array<struct<indent:int,key:string>>)")
        return F.when(text.startswith("---"), F.struct(empty.alias("stack"), acc["out"].alias("out"))).when(hit, F.struct(stack.alias("stack"), out.alias("out"))).otherwise(acc)

    return files.select("file", F.explode(F.aggregate(lines, zero, fold)["out"]).alias("x")).select("file", "x.*")


def html_elements(pages: DataFrame, id_col: str, html_col: str, name_pattern: str = "-") -> DataFrame:
    """(id, name, line): elements opened on each line, lower case, once a line, whose name fits the pattern."""
    rows = pages.select(F.col(id_col).alias("id"), F.posexplode(F.split(html_col, "\n")).alias("pos", "t"))
    rows = rows.select("id", (F.col("pos") + 1).alias("line"), F.explode(F.regexp_extract_all("t", F.lit("<([A-Za-z][A-Za-z0-9_-]*)"), F.lit(1))).alias("name"))
    return rows.withColumn("name", F.lower("name")).where(F.col("name").rlike(name_pattern)).distinct()


def result_key(rows: DataFrame, part: str, *columns: str, params: str = "") -> DataFrame:
    """(part, key): identity of a partition's inputs, whatever their order."""
    one = F.sha2(F.concat_ws("\u0000", *columns).cast("binary"), 256)
    # Digests of rows are added up before they meet, so that a large partition is no long list.
    hi = F.sum(F.conv(F.substring(one, 1, 12), 16, 10).cast("decimal(38,0)"))
    lo = F.sum(F.conv(F.substring(one, 13, 12), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy(part).agg(F.count("*").alias("n"), hi.alias("hi"), lo.alias("lo")).select(
        part, F.sha2(F.concat_ws("|", "n", "hi", "lo", F.lit(params)).cast("binary"), 256).alias("key")
    )


def stale_results(keys: DataFrame, done: DataFrame, part: str) -> DataFrame:
    """Partitions whose key no finished result has."""
    return keys.join(done, [part, "key"], "left_anti")


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").format(fmt).partitionBy(*partition_by).save(path)
