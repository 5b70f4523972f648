"""Joins: spans, scoped bindings, name resolution, routes, keys, comments and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changegraph.operators.graph import P
from changegraph.operators.names import MOST_CANDIDATES, answers, one_too_many, questions


def innermost_span(points: DataFrame, spans: DataFrame, bucket: int = 256) -> DataFrame:
    """(snapshot_id, point_id, span_id): the shortest span of the same file around each point's line, the first on a tie.

    points: (file, line, point_id); spans: (file, start, stop, pos, span_id). Spans are
    listed under every bucket of lines they touch, which turns the range join into an equi-join."""
    p = points.withColumn("_b", F.floor(F.col("line") / bucket))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("stop") / bucket))))
    rows = p.join(s, [P, "file", "_b"]).where(F.col("line").between(F.col("start"), F.col("stop")))
    return rows.groupBy(P, "point_id").agg(F.min_by("span_id", F.struct(F.col("stop") - F.col("start"), F.col("pos"), F.col("span_id"))).alias("span_id"))


def last_binding(refs: DataFrame, bindings: DataFrame) -> DataFrame:
    """(snapshot_id, ref_id, type_name): the last binding of the name in the scope at or before the reference's place.

    refs: (scope, name, at, ref_id); bindings: (scope, name, at, type_name, ord). Both are put
    in one order and the last binding is carried forward, so no pairs are made."""
    b = bindings.select(P, "scope", "name", "at", F.lit(0).alias("side"), "ord", F.lit(None).cast("string").alias("ref_id"), F.struct("type_name").alias("bound"))
    r = refs.select(P, "scope", "name", "at", F.lit(1).alias("side"), F.lit(0).cast("long").alias("ord"), F.col("ref_id").cast("string").alias("ref_id"), F.lit(None).cast("struct<type_name:string>").alias("bound"))
    w = Window.partitionBy(P, "scope", "name").orderBy("at", "side", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = b.unionByName(r).withColumn("_last", F.last("bound", ignorenulls=True).over(w)).where("side = 1")
    return out.select(P, "ref_id", F.col("_last.type_name").alias("type_name"))


def resolve_names(refs: DataFrame, defs: DataFrame, imports: DataFrame, wildcards: DataFrame, confidences: tuple[float, ...] = (1.0, 0.95, 0.9, 0.85, 0.3)) -> DataFrame:
    """(ref_id, symbol_id, confidence, tier): the first tier with candidates wins, its confidence split among them.

    refs: (ref_id, file, package, name); defs: (symbol_id, file, package, name); imports:
    (file, name, package), where an import of an unknown name ends the search; wildcards:
    (file, package). Tiers: same file, explicit import, same package, wildcard import, anywhere. A name is
    looked up once a file and not for each reference."""
    refs, of = questions(refs)
    d = defs.select(P, "name", "symbol_id")
    tier = lambda df, n: df.select(P, "ref_id", "symbol_id", F.lit(n).alias("tier"))
    # A name known in many places is ambiguous: one candidate too many tells as much as all.
    in_file, in_package = one_too_many(defs, MOST_CANDIDATES, "file", "name"), one_too_many(defs, MOST_CANDIDATES, "package", "name")
    same_file = refs.join(in_file, [P, "file", "name"])
    other = in_package.withColumnRenamed("package", "def_package")
    named = refs.join(imports.withColumnRenamed("package", "def_package"), [P, "file", "name"]).join(other, [P, "def_package", "name"], "left")
    package = refs.join(in_package, [P, "package", "name"])
    wild = refs.join(wildcards.withColumnRenamed("package", "def_package"), [P, "file"]).join(other, [P, "def_package", "name"])
    # Only names within the limit are looked up anywhere.
    few = lambda df: df.join(df.groupBy(P, "name").count().where(F.col("count") <= MOST_CANDIDATES).drop("count"), [P, "name"])
    if "is_test" in refs.columns and "is_test" in defs.columns:  # main code does not see tests
        main = defs.where("NOT is_test").select(P, "name", "symbol_id")
        anywhere = refs.where("NOT is_test").join(few(main), [P, "name"]).select(P, "ref_id", "symbol_id")
        anywhere = anywhere.union(refs.where("is_test").join(few(d), [P, "name"]).select(P, "ref_id", "symbol_id"))
    else:
        anywhere = refs.join(few(d), [P, "name"])
    rows = tier(same_file, 0)
    for n, df in enumerate((named, package, wild, anywhere), 1):
        rows = rows.unionByName(tier(df, n))
    rows = rows.distinct()
    best = rows.groupBy(P, "ref_id").agg(F.min("tier").alias("tier"))
    rows = rows.join(best, [P, "ref_id", "tier"]).where("symbol_id IS NOT NULL")
    n = F.count("*").over(Window.partitionBy(P, "ref_id"))
    value = F.element_at(F.array(*map(F.lit, confidences)), F.col("tier") + 1)
    out = rows.withColumn("_n", n).where(F.col("_n") <= MOST_CANDIDATES).select(P, "ref_id", "symbol_id", (value / F.col("_n")).alias("confidence"), "tier")
    return answers(of, out).select(P, "ref_id", "symbol_id", "confidence", "tier")


def renormalise(candidates: DataFrame, cap: int | None = MOST_CANDIDATES) -> DataFrame:
    """Candidates that fit the arity, with the others' confidence shared out (at most 1); more than ``cap`` left is ambiguous.

    candidates: (ref_id, symbol_id, confidence, arity, params, variadic, lang). Where none fits,
    languages with default values keep callables of more parameters at 0.8 times, Java none. An
    unknown arity or number of parameters fits."""
    fits = F.col("arity").isNull() | F.col("params").isNull() | (F.col("arity") == F.col("params")) | (F.col("variadic") & (F.col("arity") + 1 >= F.col("params")))
    w = Window.partitionBy(P, "ref_id")
    rows = candidates.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("_before", F.count("*").over(w))
    loose = ~F.bool_or("_fits").over(w) & (F.coalesce(F.col("lang"), F.lit("")) != "java") & (F.col("params") > F.col("arity"))
    rows = rows.withColumn("_loose", F.coalesce(loose, F.lit(False))).where("_fits OR _loose").withColumn("_after", F.count("*").over(w))
    if cap is not None:
        rows = rows.where(F.col("_after") <= cap)
    c = F.col("confidence") * F.when(F.col("_loose"), 0.8).otherwise(1.0)
    c = F.when(F.col("_after") == F.col("_before"), c).otherwise(F.least(F.lit(1.0), c * F.col("_before") / F.col("_after")))
    return rows.withColumn("confidence", c).drop("_before", "_after", "_fits", "_loose")


def resolve_module_path(imports: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")) -> DataFrame:
    """(import_id, path): relative specifiers against the importing file's directory; the first suffix that exists wins.

    imports: (import_id, file, spec)."""
    base = F.slice(F.split("file", "/"), F.lit(1), F.size(F.split("file", "/")) - 1)

    def step(acc: Column, x: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(x.isin(".", ""), acc).when(x == "..", up).otherwise(F.array_append(acc, x))

    rows = imports.where(F.col("spec").startswith(".")).withColumn("_path", F.array_join(F.aggregate(F.split("spec", "/"), base, step), "/"))
    options = F.transform(F.array(*map(F.lit, suffixes)), lambda s: F.concat("_path", s))
    rows = rows.select(P, "import_id", F.posexplode(options).alias("_pos", "path")).join(files.select(P, "path"), [P, "path"], "left_semi")
    return rows.groupBy(P, "import_id").agg(F.min_by("path", "_pos").alias("path"))


def match_routes(calls: DataFrame, endpoints: DataFrame, most: int = 5) -> DataFrame:
    """(call_id, endpoint_id, confidence): the best endpoints of each call, by segments aligned from the end.

    calls: (call_id, method, segments) and optionally ``open`` (an unknown base leads) and ``from_id`` (a symbol does not
    call itself); endpoints: (endpoint_id, method, segments) and optionally ``context``, segments that may stand before;
    variables are ``{}`` and the method ``ANY`` fits all. More than ``most`` equally good endpoints give none.

    The first place from the end where both have a literal must hold the same one. A pair meets there and
    nowhere else: by the place, the literal, and which of the places after it are variables in either. So a literal that
    many routes share, such as a common prefix, pairs only what could match."""
    calls = calls if "open" in calls.columns else calls.withColumn("open", F.lit(False))
    calls = calls if "from_id" in calls.columns else calls.withColumn("from_id", F.lit(None).cast("string"))
    ends = endpoints.select(P, "endpoint_id", "method", "segments")
    if "context" in endpoints.columns:
        ends = ends.unionByName(endpoints.where("context IS NOT NULL").select(P, "endpoint_id", "method", F.concat("context", "segments").alias("segments")))

    def literals(df: DataFrame, key: str) -> DataFrame:
        """A row for each literal: its place from the end and a mark for each place after it (v: variable)."""
        back = df.withColumn("_back", F.reverse("segments"))
        marks = F.array_join(F.transform("_back", lambda x: F.when(x == "{}", "v").otherwise("l")), "")
        rows = back.withColumn("_marks", marks).select("*", F.posexplode("_back").alias("_d", "_s")).where("_s <> '{}'")
        rows = rows.withColumn("_m", F.substr("_marks", F.lit(1), F.col("_d")))
        return rows.select(P, "_d", "_s", F.col("_m").alias(f"_{key}m"), *[F.col(c).alias(f"{key}_{c}") for c in df.columns if c != P])

    c, e = literals(calls, "c"), literals(ends, "e")
    # Which marks can meet: at each place at least one variable. There are only as many as kinds of routes.
    fits = c.select("_d", "_cm").distinct().join(e.select("_d", "_em").distinct(), "_d")
    fits = fits.where(~F.exists(F.arrays_zip(F.split("_cm", "").alias("x"), F.split("_em", "").alias("y")), lambda z: (z["x"] == "l") & (z["y"] == "l")))
    pairs = c.join(fits, ["_d", "_cm"]).join(e, [P, "_d", "_s", "_em"])
    if dict(calls.dtypes)["from_id"] == dict(endpoints.dtypes)["endpoint_id"]:
        pairs = pairs.where(~F.col("c_from_id").eqNullSafe(F.col("e_endpoint_id")))
    aligned = F.arrays_zip(F.reverse("c_segments").alias("c"), F.reverse("e_segments").alias("e"))
    aligned = F.slice(aligned, F.lit(1), F.least(F.size("c_segments"), F.size("e_segments")))

    def score(acc: Column, x: Column) -> Column:
        one = F.when(x["c"] == x["e"], 1.0).when(x["e"] == "{}", 0.85).when(x["c"] == "{}", 0.6).otherwise(0.0)
        return acc * one

    more = F.size("e_segments") - F.size("c_segments")
    length = F.when(more == 0, 1.0).when((more > 0) & F.col("c_open"), 0.85).when(more > 0, 0.6).otherwise(0.7)
    method = F.when(F.col("c_method") == F.col("e_method"), 1.0).when((F.col("c_method") == "ANY") | (F.col("e_method") == "ANY"), 0.8).otherwise(0.0)
    rows = pairs.withColumn("_score", F.aggregate(aligned, F.lit(1.0), score) * length * method).where("_score > 0")
    rows = rows.groupBy(P, "c_call_id", "e_endpoint_id").agg(F.max("_score").alias("_score"))
    w = Window.partitionBy(P, "c_call_id")
    rows = rows.withColumn("_best", F.max("_score").over(w)).where(F.col("_score") >= F.col("_best") - 1e-4)
    rows = rows.withColumn("_k", F.count("*").over(w)).where(F.col("_k") <= most)
    return rows.select(P, F.col("c_call_id").alias("call_id"), F.col("e_endpoint_id").alias("endpoint_id"), (0.9 * F.col("_score") / F.col("_k")).alias("confidence"))


def bind_config_keys(uses: DataFrame, config: DataFrame) -> DataFrame:
    """(symbol, file, key, confidence): keys a symbol consumes, whole or as a prefix; files of its own module (0.9) or, if none, others (0.6).

    uses: (symbol, key, is_prefix, module); config: (file, module, key, line)."""
    parts = F.split("key", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    listed = config.select(P, "file", F.col("module").alias("_module"), F.col("key").alias("full"), "line", F.explode(prefixes).alias("key"))
    rows = uses.join(listed, [P, "key"]).where((F.col("key") == F.col("full")) | F.col("is_prefix"))
    rows = rows.withColumn("_same", F.col("module") == F.col("_module"))
    own = rows.groupBy(P, "symbol").agg(F.bool_or("_same").alias("_any"))
    rows = rows.join(own, [P, "symbol"]).where(F.col("_same") | ~F.col("_any"))
    first = rows.groupBy(P, "symbol", "file").agg(F.min_by(F.struct("full", "_same"), F.struct("line", "full")).alias("x"))
    return first.select(P, "symbol", "file", F.col("x.full").alias("key"), F.when(F.col("x._same"), 0.9).otherwise(0.6).alias("confidence"))


def pair_tests_with_subjects(tests: DataFrame, subjects: DataFrame) -> DataFrame:
    """(review_id, test, subject, by): the subject of the test's stem, else the longest subject stem (3 or more) that begins it.

    tests: (review_id, test, stem, dir); subjects: (review_id, subject, stem, dir). The same directory is preferred.
    Of each stem only the best subject in each directory, and overall, is joined."""
    prefixes = F.transform(F.sequence(F.lit(3), F.length("stem")), lambda i: F.substring(F.col("stem"), F.lit(1), i))
    t = tests.where("length(stem) >= 3").select("review_id", "test", F.col("dir").alias("_dir"), F.col("stem").alias("_stem"), F.explode(prefixes).alias("stem"))
    here = subjects.groupBy("review_id", "stem", F.col("dir").alias("_dir")).agg(F.min("subject").alias("_here"))
    anywhere = subjects.groupBy("review_id", "stem").agg(F.min("subject").alias("_any"))
    rows = t.join(anywhere, ["review_id", "stem"]).join(here, ["review_id", "stem", "_dir"], "left")
    found = F.struct(F.coalesce("_here", "_any").alias("subject"), (F.col("stem") == F.col("_stem")).alias("exact"))
    out = rows.groupBy("review_id", "test").agg(F.max_by(found, F.length("stem")).alias("x"))
    return out.select("review_id", "test", F.col("x.subject").alias("subject"), F.when(F.col("x.exact"), "stem").otherwise("prefix").alias("by"))


def carry_over_reviewed(reviewed: DataFrame, hunks: DataFrame, hunkless: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Reviewed hashes that are still there, and (review_id, path, done) of files whose hunks all are; a file without hunks (path, file_key) by its own key."""
    own = hunks.select("review_id", "path", "content_hash")
    if hunkless is not None:
        own = own.unionByName(hunkless.select("review_id", "path", F.col("file_key").alias("content_hash")))
    kept = reviewed.join(own.select("review_id", "content_hash").distinct(), ["review_id", "content_hash"], "left_semi").distinct()
    marked = own.join(kept.withColumn("_done", F.lit(True)), ["review_id", "content_hash"], "left")
    return kept, marked.groupBy("review_id", "path").agg(F.bool_and(F.coalesce("_done", F.lit(False))).alias("done"))


def reanchor_comments(drafts: DataFrame, lines: DataFrame) -> DataFrame:
    """(review_id, draft_id, hunk_id, idx, start_idx, moved, stale): where a comment's line is now.

    drafts: (review_id, draft_id, path, side, hunk_hash, idx, kind, text, line, start_idx, start_kind,
    start_text); lines: (review_id, hunk_id, content_hash, path, idx, kind, text, old_line, new_line).
    A hunk of the same content keeps the index (not moved). Else it is the nearest line of the
    same path, kind and text; a tie or none is stale. The start of a range is kept if the same text
    stands at the same distance before. Drafts and lines are put in one order by line, so that no
    pairs of equal texts are made."""
    key = ["review_id", "draft_id"]
    first = lines.groupBy("review_id", F.col("content_hash").alias("hunk_hash"), "idx", "kind", "text").agg(F.min("hunk_id").alias("hunk_id"))
    same = drafts.join(first, ["review_id", "hunk_hash", "idx", "kind", "text"]).select(*key, "hunk_id", F.col("idx").alias("at"), F.lit(False).alias("moved"))
    rest = drafts.join(same.select(*key), key, "left_anti")

    sided = lines.withColumn("_s", F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col("old_line").alias("n")), F.struct(F.lit("new").alias("side"), F.col("new_line").alias("n")))))
    group = ["review_id", "path", "kind", "text", "side"]
    places = sided.select("review_id", "path", "kind", "text", F.col("_s.side").alias("side"), F.coalesce("_s.n", F.lit(0)).cast("long").alias("n"), "hunk_id", "idx")
    places = places.groupBy(*group, "n").agg(F.struct(F.col("n").alias("n"), F.count("*").alias("many"), F.min(F.struct("hunk_id", "idx")).alias("place")).alias("here"))
    asked = rest.select(*group, F.col("line").cast("long").alias("n"), "draft_id")
    rows = places.withColumn("draft_id", F.lit(None).cast(asked.schema["draft_id"].dataType)).unionByName(asked.withColumn("here", F.lit(None).cast(places.schema["here"].dataType)))
    order = Window.partitionBy(*group).orderBy("n", F.col("here").isNull())
    below = F.last("here", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.first("here", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumns({"_b": below, "_a": above}).where("draft_id IS NOT NULL")
    far = lambda c: F.abs(F.col(f"{c}.n") - F.col("n"))
    rows = rows.withColumns({"_fb": far("_b"), "_fa": far("_a")})
    nearer = F.when(F.col("_a").isNull() | (F.col("_fb") < F.col("_fa")), F.col("_b")).when(F.col("_b").isNull() | (F.col("_fa") < F.col("_fb")), F.col("_a"))
    near = rows.withColumn("_x", nearer).where("_x.many = 1").select(*key, F.col("_x.place.hunk_id").alias("hunk_id"), F.col("_x.place.idx").alias("at"), F.lit(True).alias("moved"))

    out = drafts.join(same.unionByName(near), key, "left").withColumn("_start", F.col("at") - (F.col("idx") - F.col("start_idx")))
    starts = lines.select("review_id", "hunk_id", F.col("idx").alias("_start"), F.col("kind").alias("start_kind"), F.col("text").alias("start_text"), F.lit(True).alias("_kept"))
    out = out.join(starts, ["review_id", "hunk_id", "_start", "start_kind", "start_text"], "left")
    start = F.when(F.col("_kept") & (F.col("_start") < F.col("at")), F.col("_start"))
    return out.select(*key, "hunk_id", F.col("at").alias("idx"), start.alias("start_idx"), F.coalesce("moved", F.lit(False)).alias("moved"), F.col("at").isNull().alias("stale"))


def locate_positions(positions: DataFrame, lines: DataFrame) -> DataFrame:
    """(position_id, idx): the line of the new number on a row not removed, else of the old number on a removed row, else null."""
    new = lines.where("kind <> 'removed'").select("review_id", "path", "new_line", F.col("idx").alias("_new"))
    old = lines.where("kind = 'removed'").select("review_id", "path", "old_line", F.col("idx").alias("_old"))
    rows = positions.join(new, ["review_id", "path", "new_line"], "left").join(old, ["review_id", "path", "old_line"], "left")
    return rows.groupBy("review_id", "position_id").agg(F.min(F.coalesce("_new", "_old")).alias("idx"))


def validate_citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """(answer_id, cited, line, valid) of every ``path:line`` in a text; a path may be an unambiguous suffix.

    answers: (answer_id, text); context: (path, side, line)."""
    cited = answers.select("review_id", "answer_id", F.explode(F.regexp_extract_all("text", F.lit(r"([\w./-]+\.\w+:\d+(?: \(old\))?)"), F.lit(1))).alias("cited"))
    cited = cited.withColumn("suffix", F.regexp_extract("cited", r"^(.*):\d+", 1)).withColumn("line", F.regexp_extract("cited", r":(\d+)", 1).cast("int"))
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    paths = context.select("review_id", "path").distinct().withColumn("suffix", F.explode(ends))
    only = paths.groupBy("review_id", "suffix").agg(F.count("*").alias("n"), F.min("path").alias("path"), F.max(F.when(F.col("path") == F.col("suffix"), F.col("path"))).alias("exact"))
    rows = cited.join(only, ["review_id", "suffix"], "left").withColumn("path", F.coalesce("exact", F.when(F.col("n") == 1, F.col("path"))))
    seen = context.groupBy("review_id", "path", "line").agg(F.bool_or(F.col("side") == "old").alias("_old"), F.count("*").alias("_any"))
    rows = rows.join(seen, ["review_id", "path", "line"], "left")
    marked = F.col("cited").endswith("(old)")
    return rows.select("review_id", "answer_id", "cited", "line", F.when(marked, F.coalesce("_old", F.lit(False))).otherwise(F.col("_any").isNotNull()).alias("valid"))
