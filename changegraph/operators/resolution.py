"""From references to edges: calls, constructors, imports, inheritance, overrides, and the symbols of hunks.

Symbols: (snapshot_id, symbol_id, name, kind, file, package, container_id, params, variadic,
is_test); references: (snapshot_id, ref_id, file, package, lang, kind, name, receiver, arity,
scope_id, type_id, line, is_test), ``scope_id`` being the symbol around the reference and
``type_id`` the type around it. Every step is a join; nothing walks a reference on its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changegraph.operators.graph import CALLABLE_KINDS, TYPE_KINDS, P, ancestors, closure, store
from changegraph.operators.matching import innermost_span, renormalise
from changegraph.operators.names import MOST_CANDIDATES, answers, anywhere, by_tiers, fits_and_may, fitting_anywhere, fitting_counts, qualified_names, questions, still_fits

TYPE_TIERS = (1.0, 0.95, 0.9, 0.85, 0.3)
FUNCTION_TIERS = (0.95, 0.9, 0.85, 0.8, 0.3)
# Method names too common to guess from when the receiver's type is unknown.
COMMON_NAMES = (
    "get", "set", "add", "put", "remove", "delete", "clear", "contains", "size", "length", "isEmpty", "equals", "hashCode", "toString", "compareTo",
    "valueOf", "of", "from", "map", "flatMap", "filter", "reduce", "forEach", "collect", "stream", "toList", "sort", "find", "findFirst", "first", "last",
    "orElse", "orElseThrow", "ifPresent", "then", "catch", "finally", "subscribe", "pipe", "next", "error", "complete", "emit", "push", "pop", "join",
    "split", "trim", "replace", "format", "append", "build", "builder", "apply", "let", "run", "also", "use", "close", "open", "start", "stop", "init",
    "update", "create", "save", "load", "read", "write", "send", "call", "invoke", "execute", "handle", "process", "log", "debug", "info", "warn",
    "print", "println", "assertThat", "assertEquals", "expect", "toBe", "toEqual", "when", "verify", "mock", "spyOn", "describe", "it", "test", "beforeEach",
)


def _is(kinds: tuple[str, ...], column: str = "kind"):
    return F.col(column).isin(*kinds)


def _share(rows: DataFrame, factor, *keys: str) -> DataFrame:
    """(ref_id, symbol_id, confidence): ``factor`` shared out among the candidates of each key."""
    n = F.count("*").over(Window.partitionBy(P, *keys))
    return rows.withColumn("confidence", factor / n).select(P, "ref_id", "symbol_id", "confidence")


def hierarchy(inherits: DataFrame, types: DataFrame) -> DataFrame:
    """(type_id, relative_id, dist): each type itself and its supertypes, at the least distance."""
    out = closure(inherits, types.select(P, F.col("symbol_id").alias("start_id")), None)
    return out.select(P, F.col("start_id").alias("type_id"), F.col("node_id").alias("relative_id"), "dist")


def nearest_members(wanted: DataFrame, levels: DataFrame, members: DataFrame) -> DataFrame:
    """Adds symbol_id to ``wanted`` (ref_id, type_id, name): members of the name in the type or, if it has none, in its nearest supertypes."""
    own = members.select(P, F.col("container_id").alias("relative_id"), "name", "symbol_id")
    rows = wanted.join(levels, [P, "type_id"]).join(own, [P, "relative_id", "name"])
    best = rows.groupBy(P, "ref_id", "type_id").agg(F.min("dist").alias("dist"))
    return rows.join(best, [P, "ref_id", "type_id", "dist"]).drop("relative_id", "dist").distinct()


def _valued(rows: DataFrame, tiers: tuple[float, ...], script: float | None = None) -> DataFrame:
    """Candidates (ref_id, symbol_id, tier) with the tier's confidence, shared out."""
    value = F.element_at(F.array(*map(F.lit, tiers)), F.col("tier") + 1)
    if script is not None:
        value = F.when((F.col("tier") == 1) & ~F.coalesce("lang", F.lit("")).isin("java", "kotlin") & F.col("lang").isNotNull(), script).otherwise(value)
    n = F.count("*").over(Window.partitionBy(P, "ref_id"))
    return rows.withColumn("confidence", value / n)


def _types(symbols: DataFrame) -> DataFrame:
    return (symbols if "qname" in symbols.columns else qualified_names(symbols)).where(_is(TYPE_KINDS))


def resolve_types(refs: DataFrame, symbols: DataFrame, imports: DataFrame, wildcards: DataFrame, most: int | None = MOST_CANDIDATES) -> DataFrame:
    """(ref_id, symbol_id, confidence, tier): the types that a name means, by tiers; more than ``most`` are ambiguous and give none.

    Imports, packages and wildcards find types by qualified name, static imports do not count. A name is looked up once a
    file, and a name of many types is not joined with them all, so the work follows the references and the types."""
    types = _types(symbols)
    asks, of = questions(refs)
    near = store(by_tiers(asks, types, imports, wildcards, most=most))
    left = asks.join(near.select(P, "ref_id").distinct(), [P, "ref_id"], "left_anti")
    rows = near.where("symbol_id IS NOT NULL").unionByName(anywhere(left, types, most).withColumn("tier", F.lit(4)))
    out = _valued(rows, TYPE_TIERS)
    if most is not None:
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy(P, "ref_id"))).where(F.col("_n") <= most)
    return answers(of, out).select(P, "ref_id", "symbol_id", "confidence", "tier")


def resolve_functions(refs: DataFrame, symbols: DataFrame, imports: DataFrame, wildcards: DataFrame) -> DataFrame:
    """(ref_id, symbol_id, confidence, tier): top-level callables by tiers; Java does not look anywhere else.

    Top-level symbols are those whose container is their file or nothing; in the JVM's tiers by name any callable of
    the qualified name counts, so static imports reach methods. Scripts are as sure of an import (0.95) as of their own
    file. Anywhere else, callables that fit the arity count, if they are few."""
    named = symbols if "qname" in symbols.columns else qualified_names(symbols)
    callables = named.where(_is(CALLABLE_KINDS))
    top = callables.where(F.col("container_id").isNull() | (F.col("container_id") == F.col("file")))
    refs = refs if "arity" in refs.columns else refs.withColumn("arity", F.lit(None).cast("int"))
    # Only the tiers by qualified name see callables that are not top-level.
    inner = callables.join(top.select(P, "symbol_id"), [P, "symbol_id"], "left_anti").withColumn("file", F.lit(None).cast("string"))
    near = store(by_tiers(refs, top.unionByName(inner), imports, wildcards, static=True))
    left = refs.join(near.select(P, "ref_id").distinct(), [P, "ref_id"], "left_anti").where("lang <> 'java' OR lang IS NULL")
    rows = near.where("symbol_id IS NOT NULL").unionByName(fitting_anywhere(left, top).withColumn("tier", F.lit(4)))
    return _valued(rows.join(refs.select(P, "ref_id", "lang"), [P, "ref_id"]), FUNCTION_TIERS, script=0.95).select(P, "ref_id", "symbol_id", "confidence", "tier")


def resolve_constructors(refs: DataFrame, symbols: DataFrame, imports: DataFrame, wildcards: DataFrame) -> DataFrame:
    """(ref_id, symbol_id, confidence): constructors of the named type that fit the arity; the type itself only if none does.

    At most five over all types that the name may mean, counted after the arity has been looked at."""
    symbols, refs = (df if "is_test" in df.columns else df.withColumn("is_test", F.lit(False)) for df in (symbols, refs))
    types = _types(symbols)
    own = symbols.where("kind = 'constructor'").select(P, F.col("container_id").alias("type_id"), "symbol_id", "params", "variadic")
    whole = types.select(P, F.col("symbol_id").alias("type_id"), "symbol_id", "params", "variadic")
    options = own.join(whole.select(P, "type_id"), [P, "type_id"]).unionByName(whole)
    options = options.select(P, "type_id", "symbol_id", F.struct("params", "variadic", (F.col("symbol_id") != F.col("type_id")).alias("own")).alias("kind"))
    kinds = store(options.groupBy(P, "type_id", "kind").agg(F.count("*").alias("_k")))

    # The types that a name means (``_name``) in a file, else those of the name anywhere.
    names, _ = questions(refs)
    near = store(by_tiers(names, types, imports, wildcards))
    named = _valued(near.where("symbol_id IS NOT NULL"), TYPE_TIERS).select(P, F.col("ref_id").alias("_name"), F.col("symbol_id").alias("type_id"), "confidence")
    none = F.lit(None)
    far = F.struct(none.cast(refs.schema["file"].dataType).alias("file"), none.cast(refs.schema["package"].dataType).alias("package"), "name", "is_test")
    places = names.join(near.select(P, "ref_id", F.lit(True).alias("_near")).distinct(), [P, "ref_id"], "left").select(P, F.col("ref_id").alias("_place"), F.when(F.col("_near"), F.col("ref_id")).otherwise(far).alias("_name"), "_near", "name", "is_test")
    places = store(places)
    seen = types.select(P, "name", F.col("symbol_id").alias("type_id"), F.col("is_test").alias("_test"))
    wide = places.where("_near IS NULL").select(P, "_name", "name", "is_test").distinct().join(seen, [P, "name"]).where("is_test OR NOT _test")
    # As many types as the name has share its confidence, whether or not their constructors fit.
    n = types.groupBy(P, "name").agg(F.count("*").alias("_all"), F.count_if(~F.col("is_test")).alias("_main"))
    wide = wide.join(n, [P, "name"]).select(P, "_name", "type_id", (F.lit(TYPE_TIERS[4]) / F.when(F.col("is_test"), F.col("_all")).otherwise(F.col("_main"))).alias("confidence"))
    meant = store(named.unionByName(wide))

    # What is asked of a name: constructors of so many arguments. Each type's kinds of options are fitted apart and counted.
    asks, of = questions(refs, "arity", "lang")
    asks = asks.withColumn("_place", F.struct("file", "package", "name", "is_test")).select(P, "ref_id", "_place", "arity", "lang").join(places.select(P, "_place", "_name"), [P, "_place"])
    asks = store(asks.select(P, "ref_id", "_name", "arity", "lang"))
    wanted = asks.select(P, "_name", "arity", "lang").distinct().withColumn("_ask", F.struct("_name", "arity", "lang"))
    both = lambda df: df.join(kinds, [P, "type_id"]).select("*", "kind.*").withColumns(fits_and_may())
    k = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("_k"))), F.lit(0))
    fitted = both(wanted.join(meant, [P, "_name"])).groupBy(P, "_ask", "type_id", "confidence").agg(
        F.sum("_k").alias("_before"), F.bool_or("_fits").alias("any_fits"), k(F.col("_fits")).alias("_f"), k(F.col("_may")).alias("_m"),
        k(F.col("_fits") & F.col("own")).alias("_fo"), k(F.col("_may") & F.col("own")).alias("_mo"),
    )
    pick = lambda f, m: F.when(F.col("any_fits"), F.col(f)).otherwise(F.col(m))
    fitted = fitted.withColumns({"_after": pick("_f", "_m"), "_explicit": pick("_fo", "_mo")}).where("_after > 0")
    fitted = store(fitted.withColumn("_left", F.when(F.col("_explicit") > 0, F.col("_explicit")).otherwise(F.col("_after"))).drop("_f", "_m", "_fo", "_mo"))
    few = fitted.groupBy(P, "_ask").agg(F.sum("_left").alias("_n")).where(F.col("_n") <= MOST_CANDIDATES)
    c = F.col("confidence") * F.when(F.col("any_fits"), 1.0).otherwise(0.8)
    c = F.when(F.col("_after") == F.col("_before"), c).otherwise(F.least(F.lit(1.0), c * F.col("_before") / F.col("_after")))
    kept = fitted.join(few, [P, "_ask"]).withColumn("confidence", c).select(P, "_ask", F.col("_ask.arity").alias("arity"), F.col("_ask.lang").alias("lang"), "type_id", "confidence", "any_fits", "_explicit")
    kept = both(kept).where(still_fits()).where("own OR _explicit = 0").join(options, [P, "type_id", "kind"]).select(P, "_ask", "symbol_id", "confidence")
    out = asks.withColumn("_ask", F.struct("_name", "arity", "lang")).join(kept, [P, "_ask"]).select(P, "ref_id", "symbol_id", "confidence")
    return answers(of, out).select(P, "ref_id", "symbol_id", "confidence")


def unknown_receivers(refs: DataFrame, symbols: DataFrame, visible: DataFrame, common: tuple[str, ...] = COMMON_NAMES, often: int = 1000) -> DataFrame:
    """(ref_id, symbol_id, confidence): methods of the name anywhere; 0.5 shared by those of visible types, else 0.3 if there are one or two.

    visible: (file, type_id), types declared in, imported by or of the package of a file. Common
    and very short names are not guessed; main code does not see tests. Methods that fit the arity are counted
    before any is joined. A name of up to ``often`` methods finds the visible ones through the name, any other through
    the file's types; both give the same."""
    asked = refs.where(~F.col("name").isin(*common) & (F.length("name") >= 3))
    methods = symbols.where("kind = 'method'").select(P, "name", "symbol_id", F.col("container_id").alias("type_id"), "params", "variadic", "is_test")
    counts = fitting_counts(asked, methods).where("n > 0")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (P, "name", "arity", "lang", "is_test")]
    asked = asked.alias("a").join(counts.alias("c"), reduce(lambda x, y: x & y, same)).select("a.*", "c.any_fits", "c.n")
    asked = store(asked.select(P, "ref_id", "file", "name", "arity", "lang", "is_test", "any_fits", "n"))
    m = methods.withColumnRenamed("is_test", "_test")
    in_file = asked.select(P, "file", "name").distinct().join(methods.groupBy(P, "name").agg(F.count("*").alias("_all")), [P, "name"])
    by_name = in_file.where(F.col("_all") <= often).join(m, [P, "name"]).join(visible.select(P, "file", "type_id").distinct(), [P, "file", "type_id"])
    by_type = in_file.where(F.col("_all") > often).join(visible.select(P, "file", "type_id").distinct(), [P, "file"]).join(m, [P, "type_id", "name"])
    columns = (P, "file", "name", "symbol_id", "params", "variadic", "_test")
    seen = by_name.select(*columns).unionByName(by_type.select(*columns))
    close = store(asked.join(seen, [P, "file", "name"]).where("is_test OR NOT _test").where(still_fits()).select(P, "ref_id", "symbol_id"))
    left = asked.where("n <= 2").join(close.select(P, "ref_id").distinct(), [P, "ref_id"], "left_anti")
    other = left.join(m, [P, "name"]).where("is_test OR NOT _test").where(still_fits()).select(P, "ref_id", "symbol_id")
    return _share(close, F.lit(0.5), "ref_id").unionByName(_share(other, F.lit(0.3), "ref_id"))


def visible_types(files: DataFrame, symbols: DataFrame, imports: DataFrame, wildcards: DataFrame) -> DataFrame:
    """(file, type_id): types declared in, imported by, or in the package of each file. files: (file, package)."""
    types = symbols.where(_is(TYPE_KINDS)).select(P, F.col("symbol_id").alias("type_id"), F.col("file").alias("_file"), "package", "name")
    own = types.select(P, F.col("_file").alias("file"), "type_id")
    package = files.where("package IS NOT NULL").join(types, [P, "package"]).select(P, "file", "type_id")
    named = imports.join(types, [P, "package", "name"]).select(P, "file", "type_id")
    wild = wildcards.join(types, [P, "package"]).select(P, "file", "type_id")
    return reduce(DataFrame.unionByName, (own, package, named, wild)).distinct()


def resolve_calls(
    refs: DataFrame, symbols: DataFrame, levels: DataFrame, inherits: DataFrame, outer: DataFrame, bound: DataFrame,
    imports: DataFrame, wildcards: DataFrame, namespaces: DataFrame, visible: DataFrame,
) -> DataFrame:
    """(ref_id, symbol_id, confidence) of calls, by what stands before the name.

    Nothing: the own type's hierarchy, then outer types' (0.9), then functions, then for a
    capitalised name constructors. ``this`` and ``self``: the own hierarchy (0.9). ``super``: the
    supertypes' (0.9 times the inheritance). A name: the members of its bound type, or of the type
    of that name if it is capitalised (0.95 times the type); else a namespace import's top-level
    symbols (0.9). Anything else: methods of the name anywhere.

    outer: (type_id, outer_id, dist) with each type itself at 0; bound: (ref_id, type_name);
    namespaces: (file, name, target_file). Candidates then have to fit the arity. What several
    steps read is stored once, so it is neither computed again nor planned again."""
    calls = refs.withColumn("_via", F.regexp_replace("receiver", r"^this\??\.", ""))
    named = F.col("_via").rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$")
    form = F.when(F.col("receiver").isNull(), "none").when(F.col("receiver").isin("this", "self"), "own").when(F.col("receiver") == "super", "super").when(named, "name").otherwise("other")
    calls = calls.withColumn("_form", form)
    members = symbols.where(_is(CALLABLE_KINDS))
    plain = lambda df: df.drop("_via", "_form")

    none = calls.where("_form = 'none'")
    around = none.select(P, "ref_id", "type_id", "name").join(outer, [P, "type_id"]).select(P, "ref_id", F.col("outer_id").alias("type_id"), "name", F.col("dist").alias("_out"))
    found = store(nearest_members(around, levels, members))
    first = found.groupBy(P, "ref_id").agg(F.min("_out").alias("_out"))
    inside = _share(found.join(first, [P, "ref_id", "_out"]), F.lit(0.9), "ref_id")
    outside = store(plain(none.join(found.select(P, "ref_id").distinct(), [P, "ref_id"], "left_anti")))
    functions = store(resolve_functions(outside, symbols, imports, wildcards).drop("tier"))
    left = outside.join(functions.select(P, "ref_id").distinct(), [P, "ref_id"], "left_anti").where(F.col("name").rlike("^[A-Z]"))
    made = store(resolve_constructors(left, symbols, imports, wildcards))

    own = nearest_members(calls.where("_form = 'own'").select(P, "ref_id", "type_id", "name"), levels, members)
    above = calls.where("_form = 'super'").select(P, "ref_id", F.col("type_id").alias("from_id"), "name").join(inherits.select(P, "from_id", F.col("to_id").alias("type_id"), "confidence"), [P, "from_id"])
    above = nearest_members(above.drop("from_id"), levels, members)

    names = calls.where("_form = 'name'").join(bound.select(P, "ref_id", "type_name"), [P, "ref_id"], "left")
    names = names.withColumn("type_name", F.coalesce("type_name", F.when(F.col("_via").rlike("^[A-Z]"), F.col("_via"))))
    names = store(names)
    typed = names.where("type_name IS NOT NULL")
    types = store(resolve_types(plain(typed.withColumn("name", F.col("type_name")).drop("type_name")), symbols, imports, wildcards))
    on = typed.select(P, "ref_id", "name").join(types.select(P, "ref_id", F.col("symbol_id").alias("type_id"), "confidence"), [P, "ref_id"])
    on = nearest_members(on, levels, members)
    untyped = names.where("type_name IS NULL").drop("type_name")
    spaces = store(untyped.join(namespaces.withColumnRenamed("name", "_via"), [P, "file", "_via"]))
    tops = symbols.where("container_id IS NULL OR container_id = file").select(P, F.col("file").alias("target_file"), "name", "symbol_id")
    exported = spaces.join(tops, [P, "target_file", "name"])
    unknown = calls.where("_form = 'other'").unionByName(untyped.join(spaces.select(P, "ref_id").distinct(), [P, "ref_id"], "left_anti").select(*calls.columns))

    out = [
        inside, functions, _share(own, F.lit(0.9), "ref_id"), _share(above, 0.9 * F.col("confidence"), "ref_id", "type_id"),
        _share(on, 0.95 * F.col("confidence"), "ref_id", "type_id"), _share(exported, F.lit(0.9), "ref_id"), unknown_receivers(plain(unknown), symbols, visible),
    ]
    rows = reduce(DataFrame.unionByName, out).groupBy(P, "ref_id", "symbol_id").agg(F.max("confidence").alias("confidence"))
    rows = store(rows)
    rows = rows.join(symbols.select(P, "symbol_id", "params", "variadic"), [P, "symbol_id"]).join(refs.select(P, "ref_id", "arity", "lang"), [P, "ref_id"])
    return renormalise(rows).select(P, "ref_id", "symbol_id", "confidence").unionByName(made)


def reference_edges(refs: DataFrame, resolved: DataFrame, above: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, stats): calls and instantiations give ``calls``, type mentions ``uses`` unless the target is around the source.

    above: (symbol_id, ancestor_id). stats: (snapshot_id, refs, resolved)."""
    kind = F.when(F.col("kind").isin("call", "new"), "calls").when(F.col("kind") == "type", "uses")
    asked = refs.withColumn("kind", kind).where("kind IS NOT NULL").select(P, "ref_id", F.col("scope_id").alias("from_id"), "kind", "line")
    rows = asked.join(resolved.select(P, "ref_id", F.col("symbol_id").alias("to_id"), "confidence"), [P, "ref_id"])
    around = above.select(P, F.col("symbol_id").alias("from_id"), F.col("ancestor_id").alias("to_id"))
    uses = rows.where("kind = 'uses' AND from_id <> to_id").join(around, [P, "from_id", "to_id"], "left_anti")
    kept = rows.where("kind = 'calls'").unionByName(uses)
    done = kept.groupBy(P).agg(F.countDistinct("ref_id").alias("resolved"))
    stats = asked.groupBy(P).agg(F.countDistinct("ref_id").alias("refs")).join(done, P, "left").withColumn("resolved", F.coalesce("resolved", F.lit(0)))
    return kept.select(P, "from_id", "to_id", "kind", "confidence", "line"), stats


def import_edges(imports: DataFrame, symbols: DataFrame, module_files: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, confidence, line): from a file to what it imports.

    imports: (import_id, file, package, name, line, is_jvm), a row a name (null: none), as it is called where it
    comes from. On the JVM the symbols of the qualified name share it (a class is not its constructor); in scripts the top-level symbols of the
    resolved file (module_files: import_id, path), or that file where none is named."""
    named = symbols if "qname" in symbols.columns else qualified_names(symbols)
    jvm = imports.where("is_jvm").withColumn("qname", F.concat(F.col("package").cast("string"), F.lit("."), "name")).join(named.select(P, "qname", F.col("symbol_id").alias("to_id")), [P, "qname"]).drop("qname")
    jvm = jvm.withColumn("confidence", 1.0 / F.count("*").over(Window.partitionBy(P, "import_id", "name")))
    script = imports.where("NOT is_jvm").join(module_files, [P, "import_id"])
    tops = symbols.where("kind <> 'file' AND (container_id IS NULL OR container_id = file)").select(P, F.col("file").alias("path"), "name", F.col("symbol_id").alias("to_id"))
    named = script.where("name <> 'default'").join(tops, [P, "path", "name"])
    bare = script.join(named.select(P, "import_id").distinct(), [P, "import_id"], "left_anti").withColumn("to_id", F.col("path"))
    out = lambda df, c: df.select(P, F.col("file").alias("from_id"), "to_id", F.lit("imports").alias("kind"), c.alias("confidence"), "line")
    return out(jvm, F.col("confidence")).unionByName(out(named, F.lit(1.0))).unionByName(out(bare, F.lit(1.0))).distinct()


def inheritance_edges(refs: DataFrame, symbols: DataFrame, imports: DataFrame, wildcards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, external): ``inherits`` edges of types' extends and implements clauses, and (symbol_id) of types with an unknown supertype."""
    types = symbols.where(_is(TYPE_KINDS)).select(P, F.col("symbol_id").alias("scope_id"))
    clauses = refs.where(_is(("extends", "implements"))).join(types, [P, "scope_id"], "left_semi")
    found = resolve_types(clauses, symbols, imports, wildcards)
    edges = clauses.select(P, "ref_id", F.col("scope_id").alias("from_id"), "line").join(found.select(P, "ref_id", F.col("symbol_id").alias("to_id"), "confidence"), [P, "ref_id"])
    external = clauses.join(found.select(P, "ref_id").distinct(), [P, "ref_id"], "left_anti").select(P, F.col("scope_id").alias("symbol_id")).distinct()
    return edges.select(P, "from_id", "to_id", F.lit("inherits").alias("kind"), "confidence", "line"), external


def override_edges(symbols: DataFrame, inherits: DataFrame, levels: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, confidence, line): methods that a type's method overrides: of the same name, in the nearest supertype that has it, with as many parameters; 0.9 times the inheritance."""
    methods = symbols.where("kind = 'method'")
    own = methods.select(P, F.col("symbol_id").alias("ref_id"), F.col("container_id").alias("from_id"), "name", "params", "line")
    wanted = own.join(inherits.select(P, "from_id", F.col("to_id").alias("type_id"), "confidence"), [P, "from_id"]).drop("from_id")
    found = nearest_members(wanted, levels, symbols.where("kind <> 'file'"))
    target = symbols.select(P, "symbol_id", F.col("params").alias("_params"))
    rows = found.join(target, [P, "symbol_id"]).where(F.col("params").eqNullSafe(F.col("_params")) & (F.col("ref_id") != F.col("symbol_id")))
    return rows.groupBy(P, F.col("ref_id").alias("from_id"), F.col("symbol_id").alias("to_id"), F.lit("overrides").alias("kind"), "line").agg((0.9 * F.max("confidence")).alias("confidence"))


def map_hunks_to_symbols(lines: DataFrame, head: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hunk_symbols, changed, removed): the innermost symbols around the changed lines of each hunk.

    lines: (snapshot_id, hunk_id, path, old_path, kind, old_line, new_line); head and base: symbols
    of the new and old version with (symbol_id, file, kind, container_id, start, stop, pos), a
    row of kind ``file`` a file. Added lines lie in head symbols. Removed lines lie in base symbols,
    which stand for the head symbol of the same id (after a rename, of the id under the new path),
    else for a removed symbol; removed ones come with their missing containers."""

    def around(points: DataFrame, symbols: DataFrame) -> DataFrame:
        spans = symbols.where("kind <> 'file'").select(P, "file", "start", "stop", "pos", F.col("symbol_id").alias("span_id"))
        files = symbols.where("kind = 'file'").select(P, "file", F.col("symbol_id").alias("_file"))
        inner = innermost_span(points.select(P, "file", "line", F.struct("file", "line").alias("point_id")).distinct(), spans)
        inner = inner.select(P, F.col("point_id.file").alias("file"), F.col("point_id.line").alias("line"), "span_id")
        return points.join(files, [P, "file"]).join(inner, [P, "file", "line"], "left").withColumn("symbol_id", F.coalesce("span_id", "_file")).drop("span_id", "_file")

    added = around(lines.where("kind = 'added'").select(P, "hunk_id", F.col("path").alias("file"), F.col("new_line").alias("line")), head)
    old_path = F.coalesce("old_path", "path")
    gone = around(lines.where("kind = 'removed'").select(P, "hunk_id", "path", old_path.alias("file"), F.col("old_line").alias("line")), base)

    # Every base symbol by its id now: under the new path of a renamed file, else its own.
    paths = lines.select(P, old_path.alias("file"), F.col("path").alias("_path")).distinct()
    known = head.select(P, F.col("symbol_id").alias("_id"))
    moved = base.select(P, "symbol_id", "file", "container_id").join(paths, [P, "file"])
    moved = moved.withColumn("_new", F.concat("_path", F.substr("symbol_id", F.length("file") + 1)))
    moved = moved.join(known.select(P, F.col("_id").alias("_new"), F.lit(True).alias("_a")), [P, "_new"], "left").join(known.select(P, F.col("_id").alias("symbol_id"), F.lit(True).alias("_b")), [P, "symbol_id"], "left")
    moved = moved.withColumn("now", F.when(F.col("_a"), F.col("_new")).when(F.col("_b"), F.col("symbol_id")))
    now = moved.select(P, "symbol_id", F.col("_path").alias("path"), "now")

    touched = gone.select(P, "hunk_id", "path", "symbol_id").distinct().join(now, [P, "symbol_id", "path"])
    hunk_symbols = added.select(P, "hunk_id", "symbol_id").union(touched.select(P, "hunk_id", F.coalesce("now", "symbol_id"))).distinct()
    changed = hunk_symbols.select(P, "symbol_id").distinct()

    lost = touched.where("now IS NULL").select(P, "symbol_id", "path").distinct()
    up = lost.join(ancestors(base), [P, "symbol_id"]).join(now.select(P, F.col("symbol_id").alias("ancestor_id"), "path", "now"), [P, "ancestor_id", "path"])
    kept = F.min(F.when(F.col("now").isNotNull(), F.col("dist"))).over(Window.partitionBy(P, "symbol_id", "path"))
    missing = up.withColumn("_kept", kept).where("_kept IS NULL OR dist < _kept").select(P, F.col("ancestor_id").alias("symbol_id"), "path")
    every = lost.unionByName(missing).distinct()
    inner = base.join(every, [P, "symbol_id"]).join(now.select(P, F.col("symbol_id").alias("container_id"), "path", F.col("now").alias("_now")), [P, "container_id", "path"], "left")
    removed = inner.withColumn("container_id", F.coalesce("_now", "container_id")).drop("_now", "path").dropDuplicates([P, "symbol_id"])
    return hunk_symbols, changed, removed
