"""What a name means: symbols by qualified name, in tiers, and anywhere as long as that is not ambiguous.

References: (ref_id, file, package, name, lang, arity, is_test), of which ``lang``, ``arity`` and ``is_test`` may be missing.
Imports: (file, name, package) and optionally ``exported`` (the name there, if ``name`` is an alias), ``is_static``, and for
scripts ``target_file`` with ``is_script``; an import whose target is unknown means something outside.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changegraph.operators.graph import P, store

#: A name with more candidates than this is ambiguous and gives no edge.
MOST_CANDIDATES = 5


def qualified_names(symbols: DataFrame) -> DataFrame:
    """Adds ``qname``: ``package.Outer.Inner.member``, by the names of the containers up to the file; null without a package.

    Paths double in each round, so there are as many rounds as the logarithm of the deepest nesting."""
    if "container_id" not in symbols.columns:
        return symbols.withColumn("qname", F.concat(F.col("package").cast("string"), F.lit("."), "name"))
    inner = symbols.where("kind <> 'file'") if "kind" in symbols.columns else symbols
    own = inner.select(P, "symbol_id", F.col("name").alias("path"), "container_id")
    known = inner.select(P, F.col("symbol_id").alias("container_id"), F.col("symbol_id").alias("up")).distinct()
    paths = store(own.join(known, [P, "container_id"], "left").select(P, "symbol_id", "path", "up"))
    while not paths.where("up IS NOT NULL").isEmpty():
        above = paths.select(P, F.col("symbol_id").alias("up"), F.col("path").alias("_path"), F.col("up").alias("_up"))
        longer = F.when(F.col("_path").isNotNull(), F.concat("_path", F.lit("."), "path")).otherwise(F.col("path"))
        paths = store(paths.join(above, [P, "up"], "left").select(P, "symbol_id", longer.alias("path"), F.col("_up").alias("up")))
    paths = paths.select(P, "symbol_id", "path").dropDuplicates([P, "symbol_id"])
    return symbols.join(paths, [P, "symbol_id"], "left").withColumn("qname", F.concat(F.col("package").cast("string"), F.lit("."), "path")).drop("path")


def _or(df: DataFrame, name: str, default: Column) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, default)


def questions(refs: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """(asks, of): what references ask, once each, with a struct of it as ``ref_id``, and (ref_id, _ask) of every reference.

    A name means the same wherever it stands in a file, so it is looked up once and not for each reference. ``more``: columns
    that the answer also depends on."""
    what = ["file", "package", "name", *[c for c in ("is_test", *more) if c in refs.columns]]
    key = F.struct(*what)
    return refs.select(P, *what).distinct().withColumn("ref_id", key), refs.select(P, "ref_id", key.alias("_ask")).distinct()


def answers(of: DataFrame, out: DataFrame) -> DataFrame:
    """What was found for each ask, for every reference that asks it."""
    return of.join(out.withColumnRenamed("ref_id", "_ask"), [P, "_ask"]).drop("_ask")


def one_too_many(defs: DataFrame, most: int | None, *key: str) -> DataFrame:
    """(key, symbol_id), of which a key with more than ``most`` symbols keeps ``most`` + 1: enough to see that it is ambiguous and gives nothing."""
    if most is None:
        return defs.select(P, *key, "symbol_id")
    r = F.row_number().over(Window.partitionBy(P, *key).orderBy("symbol_id"))
    return defs.select(P, *key, "symbol_id").distinct().withColumn("_r", r).where(F.col("_r") <= most + 1).drop("_r")


def by_tiers(refs: DataFrame, defs: DataFrame, imports: DataFrame, wildcards: DataFrame, static: bool = False, most: int | None = None) -> DataFrame:
    """(ref_id, symbol_id, tier) of the first tier that decides: 0 same file, 1 explicit import, 2 same package, 3 wildcard import.

    defs: with ``qname``. An explicit import decides even if its target is unknown: then symbol_id is null. Imported names
    are qualified, so a nested type is found by its full name alone. static: static imports count too. In
    scripts an import means the top-level symbols of its file: the exported one, or all for ``default``. most: for callers that
    drop references with more candidates; of those not all are listed, but more than ``most``."""
    key = lambda package: F.concat(F.col(package).cast("string"), F.lit("."))
    tier = lambda df, n: df.select(P, "ref_id", "symbol_id", F.lit(n).alias("tier"))
    imports = _or(_or(_or(_or(imports, "exported", F.col("name")), "is_static", F.lit(False)), "is_script", F.lit(False)), "target_file", F.lit(None).cast("string"))
    by_name = one_too_many(defs, most, "qname")
    same_file = refs.join(one_too_many(defs, most, "file", "name"), [P, "file", "name"])
    explicit = imports if static else imports.where("NOT is_static")
    explicit = refs.select(P, "ref_id", "file", "name").join(explicit.select(P, "file", "name", key("package").alias("_package"), "exported", "is_script", "target_file"), [P, "file", "name"])
    jvm = explicit.where("NOT is_script").withColumn("qname", F.concat("_package", "exported")).select(P, "ref_id", "qname").join(by_name, [P, "qname"], "left")
    top = defs.where("container_id IS NULL OR container_id = file") if "container_id" in defs.columns else defs
    top = top.select(P, F.col("file").alias("target_file"), F.col("name").alias("_name"), "symbol_id")
    script = explicit.where("is_script").select(P, "ref_id", "target_file", "exported")
    script = script.join(top, [P, "target_file"], "left").withColumn("symbol_id", F.when((F.col("exported") == "default") | (F.col("exported") == F.col("_name")), F.col("symbol_id")))
    found = script.where("symbol_id IS NOT NULL").select(P, "ref_id", "symbol_id")
    script = found.unionByName(script.join(found.select(P, "ref_id"), [P, "ref_id"], "left_anti").select(P, "ref_id", F.lit(None).cast(defs.schema["symbol_id"].dataType).alias("symbol_id")))
    package = refs.withColumn("qname", F.concat(key("package"), "name")).select(P, "ref_id", "qname").join(by_name, [P, "qname"])
    wild = refs.select(P, "ref_id", "file", "name").join(wildcards.select(P, "file", key("package").alias("_package")), [P, "file"])
    wild = wild.withColumn("qname", F.concat("_package", "name")).select(P, "ref_id", "qname").join(by_name, [P, "qname"])
    rows = reduce(DataFrame.unionByName, [tier(same_file, 0), tier(jvm, 1), tier(script, 1), tier(package, 2), tier(wild, 3)]).distinct()
    best = rows.groupBy(P, "ref_id").agg(F.min("tier").alias("tier"))
    rows = rows.join(best, [P, "ref_id", "tier"])
    known = F.bool_or(F.col("symbol_id").isNotNull())
    # Of several explicit imports of one name those with a target count.
    some = rows.groupBy(P, "ref_id").agg(known.alias("_some"))
    return rows.join(some, [P, "ref_id"]).where("symbol_id IS NOT NULL OR NOT _some").select(P, "ref_id", "symbol_id", "tier")


def anywhere(refs: DataFrame, defs: DataFrame, most: int | None = MOST_CANDIDATES) -> DataFrame:
    """(ref_id, symbol_id): symbols of the name anywhere, if there are at most ``most``; main code does not see tests.

    Candidates are counted by name before any is joined, so a frequent name costs nothing."""
    refs, defs = _or(refs, "is_test", F.lit(False)), _or(defs, "is_test", F.lit(False))
    n = defs.groupBy(P, "name").agg(F.count("*").alias("_all"), F.count_if(~F.col("is_test")).alias("_main"))
    asked = refs.select(P, "ref_id", "name", "is_test").join(n, [P, "name"])
    if most is not None:
        asked = asked.where(F.when(F.col("is_test"), F.col("_all")).otherwise(F.col("_main")) <= most)
    hit = asked.join(defs.select(P, "name", "symbol_id", F.col("is_test").alias("_test")), [P, "name"]).where("is_test OR NOT _test")
    return hit.select(P, "ref_id", "symbol_id")


def _fits(arity: str = "arity") -> Column:
    a, p = F.col(arity), F.col("params")
    return F.coalesce(a.isNull() | p.isNull() | (a == p) | (F.col("variadic") & (a + 1 >= p)), F.lit(False))


def _loose(arity: str = "arity") -> Column:
    """Languages with default values may leave parameters out."""
    return F.coalesce((F.coalesce(F.col("lang"), F.lit("")) != "java") & (F.col("params") > F.col(arity)), F.lit(False))


def fitting_counts(refs: DataFrame, options: DataFrame) -> DataFrame:
    """(name, arity, lang, is_test, any_fits, n): for what references ask, whether an option of the name fits the arity, and how many are left.

    Options are counted by (name, params, variadic, is_test) first, so what is asked meets kinds of options and not each one."""
    kinds = options.groupBy(P, "name", "params", "variadic", F.col("is_test").alias("_test")).agg(F.count("*").alias("_k"))
    rows = refs.select(P, "name", "arity", "lang", "is_test").distinct().join(kinds, [P, "name"]).where("is_test OR NOT _test").withColumns({"_fits": _fits(), "_may": _loose()})
    n = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("_k"))), F.lit(0))
    out = rows.groupBy(P, "name", "arity", "lang", "is_test").agg(n("_fits").alias("_f"), n("_may").alias("_m"))
    return out.select(P, "name", "arity", "lang", "is_test", (F.col("_f") > 0).alias("any_fits"), F.when(F.col("_f") > 0, F.col("_f")).otherwise(F.col("_m")).alias("n"))


def fits_and_may() -> dict[str, Column]:
    """Of rows with arity, params, variadic and lang: whether an option fits, and whether it may where none fits."""
    return {"_fits": _fits(), "_may": _loose()}


def still_fits() -> Column:
    """Of rows with arity, params, variadic, lang and any_fits: whether the option is left."""
    return _fits() | (~F.col("any_fits") & _loose())


def fitting_anywhere(refs: DataFrame, options: DataFrame, group: str | None = None, most: int = MOST_CANDIDATES) -> DataFrame:
    """(ref_id, symbol_id, group): callables of the name anywhere that fit the arity, if at most ``most`` do.

    options: (name, symbol_id, params, variadic, is_test). With ``group``, a column of options (a type), fitting is judged within each
    group, where the group itself (symbol_id = group) only counts if nothing else fits. How many fit is worked out once
    for each (name, arity, language) that is asked, not for each reference, so neither a frequent name nor a name of
    many callables is cut before its arity is looked at."""
    refs, options = _or(refs, "is_test", F.lit(False)), _or(options, "is_test", F.lit(False))
    part = [group] if group else []
    asks = refs.select(P, "name", "arity", "lang", "is_test").distinct()
    rows = asks.join(options.withColumnRenamed("is_test", "_test"), [P, "name"]).where("is_test OR NOT _test")
    rows = rows.withColumns({"_fits": _fits(), "_may": _loose()})
    same = [P, "name", "arity", "lang", "is_test"]
    own = F.col("symbol_id") != F.col(group) if group else F.lit(True)
    keys = lambda a: F.struct(*[F.col(c).alias(c) for c in [*a]])
    rows = rows.withColumns({"_ask": keys(same), "_part": keys([*same, *part])})
    found = rows.groupBy("_part").agg(F.bool_or("_fits").alias("_any"))
    rows = rows.join(found, "_part").where("_fits OR (NOT _any AND _may)").withColumn("_own", own)
    explicit = rows.groupBy("_part").agg(F.bool_or("_own").alias("_explicit"))
    rows = rows.join(explicit, "_part").where("_own OR NOT _explicit")
    n = rows.groupBy("_ask").agg(F.count("*").alias("_n")).where(F.col("_n") <= most)
    kept = rows.join(n, "_ask").select("_ask", "symbol_id", *part)
    return refs.select(P, "ref_id", keys(same).alias("_ask")).join(kept, "_ask").select(P, "ref_id", "symbol_id", *part)
