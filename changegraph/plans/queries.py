"""One query for each operator that the tables can exercise, with SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegraph.functions import paths as fp
from changegraph.functions import text as ft
from changegraph.operators import graph as g
from changegraph.operators import groups as gr
from changegraph.operators import lines as ln
from changegraph.operators import matching as m
from changegraph.operators import resolution as rs
from changegraph.plans import views as v
from changegraph.plans.views import sql, table
from changegraph.sources import diffs as sd
from changegraph.sources import facts as sf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = oracle
        return f

    return add


# Graph: merging and statistics


@query(sql("SELECT snapshot_id, from_id, to_id, kind, round(confidence, 6) AS confidence, line FROM edges", "candidates", "edges"))
def merge_edges(spark, d):
    return v.edges(spark, d).withColumn("confidence", F.round("confidence", 6))


@query(sql("SELECT snapshot_id, 'symbol' AS what, kind, count(*) AS n FROM symbols GROUP BY ALL UNION ALL SELECT snapshot_id, 'edge', kind, count(*) FROM edges GROUP BY ALL", "symbols", "candidates", "edges"))
def graph_stats(spark, d):
    return g.graph_stats(v.symbols(spark, d), v.edges(spark, d))


@query(sql(""", b AS (
    SELECT snapshot_id, CASE WHEN line = 1 AND confidence > 0.9 THEN 'confirmed' WHEN confidence >= 1 THEN '1.0' WHEN confidence >= 0.85 THEN '0.85-1' WHEN confidence >= 0.5 THEN '0.5-0.85' ELSE '<0.5' END AS bucket FROM edges)
SELECT snapshot_id, bucket, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT snapshot_id, 'total', count(*) FROM b GROUP BY ALL""", "candidates", "edges"))
def confidence_buckets(spark, d):
    return g.confidence_buckets(v.edges(spark, d).withColumn("confirmed", (F.col("line") == 1) & (F.col("confidence") > 0.9)))


_MODULES = """, me AS (
    SELECT e.snapshot_id, a.module AS from_module, b.module AS to_module, e.kind, count(*) AS k
    FROM edges e JOIN symbols a ON e.from_id = a.symbol_id JOIN symbols b ON e.to_id = b.symbol_id
    WHERE e.kind <> 'tests' AND a.module <> b.module GROUP BY ALL),
mm AS (
    SELECT snapshot_id, from_module, to_module, sum(k)::BIGINT AS n, string_agg(kind || '=' || k, ',' ORDER BY kind) AS kinds FROM me GROUP BY ALL)
"""


@query(sql("SELECT snapshot_id, module, count(*) AS symbols, count_if(changed)::BIGINT AS changed_symbols FROM symbols GROUP BY ALL", "symbols"))
def module_nodes(spark, d):
    return g.module_nodes(v.symbols(spark, d))


@query(sql(_MODULES + "SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY n DESC, from_module, to_module)::INT AS rank FROM mm", "symbols", "candidates", "edges"))
def module_map(spark, d):
    out = g.module_edges(v.edges(spark, d), v.symbols(spark, d))
    text = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.withColumn("kinds", text)


@query(sql(_MODULES + """SELECT DISTINCT snapshot_id, module FROM (
    SELECT snapshot_id, module FROM symbols WHERE changed AND module LIKE 'NATION_1%'
    UNION ALL SELECT snapshot_id, to_module FROM mm WHERE n > 20 AND from_module LIKE 'NATION_1%' AND from_module IN (SELECT module FROM symbols WHERE changed)
    UNION ALL SELECT snapshot_id, from_module FROM mm WHERE n > 20 AND to_module LIKE 'NATION_1%' AND to_module IN (SELECT module FROM symbols WHERE changed))""", "symbols", "candidates", "edges"))
def impacted_modules(spark, d):
    s = v.symbols(spark, d)
    nodes = g.module_nodes(s).withColumn("changed_symbols", F.when(F.col("module").startswith("NATION_1"), F.col("changed_symbols")).otherwise(0))
    return g.impacted_modules(nodes, g.module_edges(v.edges(spark, d), s).where("n > 20"))


@query(None)
def impacted_modules_all(spark, d):
    """Over all modules and edges; the query above keeps its SQL's filters."""
    s = v.symbols(spark, d)
    return g.impacted_modules(g.module_nodes(s), g.module_edges(v.edges(spark, d), s))


@query(sql(""", x AS (
    SELECT e.snapshot_id, e.kind, CASE WHEN a.module = 'NATION_3' THEN e.from_id ELSE a.module END AS a, CASE WHEN b.module = 'NATION_3' THEN e.to_id ELSE b.module END AS b
    FROM edges e JOIN symbols a ON e.from_id = a.symbol_id JOIN symbols b ON e.to_id = b.symbol_id WHERE a.module = 'NATION_3' OR b.module = 'NATION_3')
SELECT snapshot_id, a, b, count(*) AS n, count(DISTINCT kind) AS kinds FROM x WHERE a <> b GROUP BY ALL""", "symbols", "candidates", "edges"))
def fold_level(spark, d):
    return g.fold_level(v.edges(spark, d), v.symbols(spark, d), "NATION_3")


@query(sql("""SELECT DISTINCT e.snapshot_id, e.from_id, 'c' || c_custkey AS to_id, e.kind, e.to_id AS via
FROM edges e JOIN supplier ON e.to_id = 's' || s_suppkey JOIN customer ON c_nationkey = s_nationkey AND c_custkey % 50 = s_suppkey % 50
WHERE e.from_id <> 'c' || c_custkey AND e.kind NOT IN ('inherits', 'overrides')""", "candidates", "edges"))
def interface_links(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    pairs = s.join(c, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_custkey") % 50 == F.col("s_suppkey") % 50))
    implements = pairs.select(F.lit("s1").alias("snapshot_id"), F.concat(F.lit("s"), "s_suppkey").alias("interface_id"), F.concat(F.lit("c"), "c_custkey").alias("impl_id"))
    return g.interface_links(v.edges(spark, d), implements)


@query(sql(""", x AS (
    SELECT e.snapshot_id, a.module AS from_module, b.module AS to_module, e.to_id, count(*) AS n
    FROM edges e JOIN symbols a ON e.from_id = a.symbol_id JOIN symbols b ON e.to_id = b.symbol_id WHERE a.module <> b.module GROUP BY ALL)
SELECT snapshot_id, from_module, to_module, to_id AS node FROM x QUALIFY row_number() OVER (PARTITION BY snapshot_id, from_module, to_module ORDER BY n DESC, to_id) = 1""", "symbols", "candidates", "edges"))
def follow_link(spark, d):
    return g.follow_link(v.edges(spark, d), v.symbols(spark, d))


@query(sql("""SELECT x.snapshot_id, x.to_id AS symbol_id, count(*) AS n, count_if(NOT a.changed)::BIGINT AS n_untouched
FROM (SELECT DISTINCT e.snapshot_id, to_id, from_id FROM edges e JOIN symbols b ON e.to_id = b.symbol_id WHERE b.changed) x JOIN symbols a ON x.from_id = a.symbol_id GROUP BY ALL""", "symbols", "candidates", "edges"))
def impact(spark, d):
    return g.impact(v.edges(spark, d), v.symbols(spark, d))


@query(sql("SELECT snapshot_id, from_id, to_id, kind, round(confidence, 6) AS confidence, line FROM edges QUALIFY row_number() OVER (PARTITION BY snapshot_id, from_id, to_id ORDER BY confidence DESC, kind) = 1", "candidates", "edges"))
def best_link_per_symbol(spark, d):
    return g.best_link_per_symbol(v.edges(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query(sql("""SELECT e.snapshot_id, from_id, to_id, e.kind, b.changed, round(confidence, 6) AS confidence,
    row_number() OVER (PARTITION BY e.snapshot_id, from_id ORDER BY b.changed DESC, confidence DESC, to_id, e.kind)::INT AS rank
FROM edges e JOIN symbols b ON e.to_id = b.symbol_id""", "symbols", "candidates", "edges"))
def rank_neighbours(spark, d):
    return g.rank_neighbours(v.edges(spark, d), v.symbols(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query(sql(""", r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, to_id, kind ORDER BY confidence DESC, from_id) AS rank, count(*) OVER (PARTITION BY snapshot_id, to_id, kind) AS c FROM edges)
SELECT snapshot_id, to_id AS subject, kind AS section, from_id AS other, round(confidence, 6) AS confidence, rank::INT AS rank, greatest(c - 12, 0) AS more FROM r WHERE rank <= 12""", "candidates", "edges"))
def context_top_k(spark, d):
    links = v.edges(spark, d).select("snapshot_id", F.col("to_id").alias("subject"), F.col("kind").alias("section"), F.col("from_id").alias("other"), "confidence")
    return g.context_top_k(links, 12).withColumn("confidence", F.round("confidence", 6))


@query(sql(""", x AS (SELECT snapshot_id, to_id AS parent_id, from_id AS child_id, max(confidence) AS confidence, min(line) AS line, bool_or(kind = 'calls') AS reaches FROM edges GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, parent_id ORDER BY reaches DESC, confidence DESC, line, child_id) AS r, count(*) OVER (PARTITION BY snapshot_id, parent_id) AS c FROM x)
SELECT snapshot_id, parent_id, child_id, reaches, line, greatest(c - 12, 0) AS truncated, row_number() OVER (PARTITION BY snapshot_id, parent_id ORDER BY line, child_id)::INT AS pos FROM r WHERE r <= 12""", "candidates", "edges"))
def max_children(spark, d):
    children = v.edges(spark, d).groupBy("snapshot_id", F.col("to_id").alias("parent_id"), F.col("from_id").alias("child_id")).agg(F.max("confidence").alias("confidence"), F.min("line").alias("line"), F.bool_or(F.col("kind") == "calls").alias("reaches"))
    return g.max_children(g.spread(children, v.n_candidates(spark, d), "parent_id")).drop("confidence")


@query("""WITH x AS (SELECT 's1' AS snapshot_id, p_brand AS path, p_type AS name, p_partkey AS pos, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM part)
SELECT snapshot_id, path, name, pos, path || '#' || name || CASE WHEN k = 1 THEN '' ELSE '~' || k END AS symbol_id FROM x""")
def stable_symbol_ids(spark, d):
    return g.stable_symbol_ids(table(spark, d, "part").select(F.lit("s1").alias("snapshot_id"), F.col("p_brand").alias("path"), F.col("p_type").alias("name"), F.col("p_partkey").alias("pos")))


@query(sql("SELECT symbol_id, name, module FROM symbols WHERE lower(name) LIKE '%supplier%00%' OR lower(symbol_id) LIKE '%supplier%'", "symbols").replace("lower(name) LIKE '%supplier%00%' OR lower(symbol_id) LIKE '%supplier%'", "contains(lower(name), 'supplier') OR contains(lower(module), 'supplier') OR contains(lower(symbol_id), 'supplier')"))
def find_flows(spark, d):
    s = v.symbols(spark, d).select(F.col("symbol_id").alias("entry_id"), "name", F.col("module").alias("label"))
    return g.find_flows(s, "Supplier").select(F.col("entry_id").alias("symbol_id"), "name", F.col("label").alias("module"))


@query(sql(""", x AS (
    SELECT e.snapshot_id, e.from_id, b.name AS to_name, e.line, e.to_id, e.kind, CASE WHEN a.changed AND b.changed THEN 0 WHEN b.changed THEN 1 ELSE 2 END AS priority
    FROM edges e JOIN symbols a ON e.from_id = a.symbol_id JOIN symbols b ON e.to_id = b.symbol_id WHERE confidence < 1 AND line > 0 AND (a.changed OR b.changed))
SELECT snapshot_id, from_id, to_name, line, priority FROM x QUALIFY row_number() OVER (PARTITION BY snapshot_id, from_id, line, to_name ORDER BY priority, to_id, kind) = 1""", "symbols", "candidates", "edges"))
def uncertain_edges(spark, d):
    return g.uncertain_edges(v.edges(spark, d), v.symbols(spark, d), v.n_candidates(spark, d))


@query(sql("""SELECT e.snapshot_id, from_id, to_id, 'tests' AS kind, round(confidence, 6) AS confidence, line
FROM edges e JOIN symbols a ON from_id = a.symbol_id JOIN symbols b ON to_id = b.symbol_id WHERE e.kind = 'calls' AND a.is_test AND NOT b.is_test""", "symbols", "candidates", "edges"))
def test_edges(spark, d):
    return g.test_edges(v.edges(spark, d), v.symbols(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query(sql(""", said AS (
    SELECT 's1' AS snapshot_id, 'c' || o_custkey AS from_id, 's' || l_suppkey AS to_id, CASE l_returnflag WHEN 'R' THEN 'calls' ELSE 'uses' END AS kind,
        CASE WHEN l_tax < 0.02 THEN 'confirm' WHEN l_tax < 0.05 THEN 'contradict' ELSE 'add' END AS verdict
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 2),
s AS (SELECT snapshot_id, from_id, to_id, kind, bool_or(verdict = 'confirm') AS yes, bool_or(verdict = 'contradict') AS no, bool_or(verdict = 'add') AS new FROM said GROUP BY ALL),
j AS (SELECT snapshot_id, from_id, to_id, kind, e.confidence, yes, no, new FROM edges e FULL JOIN s USING (snapshot_id, from_id, to_id, kind)),
c AS (SELECT *, CASE WHEN confidence IS NULL AND (new OR yes) THEN 'added' WHEN confidence IS NULL THEN 'ignored' WHEN yes THEN 'confirmed' WHEN no THEN 'removed' ELSE 'kept' END AS change FROM j)
SELECT snapshot_id, from_id, to_id, kind, change, round(CASE WHEN change IN ('added', 'confirmed') THEN 1.0 WHEN change = 'kept' THEN confidence END, 6) AS confidence FROM c WHERE change <> 'ignored'""", "candidates", "edges"))
def reconcile_edges(spark, d):
    return _reconciled(spark, d, table(spark, d, "lineitem").where("l_linenumber = 2"))


@query(None)
def reconcile_edges_all(spark, d):
    """With evidence from all line items; the query above keeps its SQL's filter."""
    return _reconciled(spark, d, table(spark, d, "lineitem"))


def _reconciled(spark, d, items):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    verdict = F.when(F.col("l_tax") < 0.02, "confirm").when(F.col("l_tax") < 0.05, "contradict").otherwise("add")
    said = items.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("s1").alias("snapshot_id"), F.concat(F.lit("c"), "o_custkey").alias("from_id"), F.concat(F.lit("s"), "l_suppkey").alias("to_id"),
        F.when(F.col("l_returnflag") == "R", "calls").otherwise("uses").alias("kind"), verdict.alias("verdict"),
    )
    return g.reconcile_edges(v.edges(spark, d), said).select("snapshot_id", "from_id", "to_id", "kind", "change", F.round("confidence", 6).alias("confidence"))


# Graph: traversal


@query(sql(""", a AS (
    SELECT snapshot_id, symbol_id, container_id AS ancestor_id, 1 AS dist FROM containers
    UNION ALL SELECT a.snapshot_id, a.symbol_id, c.container_id, a.dist + 1 FROM a JOIN containers c ON a.ancestor_id = c.symbol_id)
SELECT * FROM a""", "containers", recursive=True))
def ancestors(spark, d):
    return g.ancestors(v.containers(spark, d))


@query(sql("""SELECT snapshot_id, to_id AS symbol_id, from_id AS caller_id, round(max(confidence), 6) AS confidence FROM edges WHERE kind = 'calls' GROUP BY ALL""", "candidates", "edges"))
def callers(spark, d):
    e = v.edges(spark, d).where("kind = 'calls'")
    return g.callers(e, e.where("false")).select("snapshot_id", "symbol_id", "caller_id", F.round("confidence", 6).alias("confidence"))


@query(None)
def nation_closure(spark, d):
    # A few rows, read three times: without a copy all edges are merged anew for each.
    e = g.store(v.nation_graph(spark, d))
    start = e.select("snapshot_id", F.col("from_id").alias("start_id")).distinct()
    return g.closure(e, start, 6)


@query(None)
def reach_back(spark, d):
    return g.reach_back(v.edges(spark, d), v.symbols(spark, d).where("changed"))


@query(sql(""", seeds AS (SELECT DISTINCT to_id AS symbol_id FROM edges WHERE to_id = 's1'),
pairs AS (SELECT from_id AS a, to_id AS b FROM edges UNION SELECT to_id, from_id FROM edges),
h1 AS (SELECT DISTINCT a AS symbol_id FROM pairs JOIN seeds ON b = seeds.symbol_id WHERE a NOT IN (SELECT symbol_id FROM seeds)),
h2 AS (SELECT DISTINCT a AS symbol_id FROM pairs JOIN h1 ON b = h1.symbol_id WHERE a NOT IN (SELECT symbol_id FROM seeds) AND a NOT IN (SELECT symbol_id FROM h1))
SELECT 's1' AS snapshot_id, symbol_id, 0 AS dist FROM seeds UNION ALL SELECT 's1', symbol_id, 1 FROM h1 UNION ALL SELECT 's1', symbol_id, 2 FROM h2""", "candidates", "edges"))
def neighbourhood(spark, d):
    e = v.edges(spark, d)
    return g.neighbourhood(e, e.where("to_id = 's1'").select("snapshot_id", F.col("to_id").alias("symbol_id")).distinct(), hops=2, cap=1_000_000_000)


@query(None)
def neighbourhood_all(spark, d):
    """Of all changed symbols, three hops; the query above keeps its SQL's seed and hops."""
    return g.neighbourhood(v.edges(spark, d), v.symbols(spark, d).where("changed"), cap=None)


# Lines and hunks


@query(sql("SELECT review_id, hunk_id, count_if(kind = 'added')::BIGINT AS added, count_if(kind = 'removed')::BIGINT AS removed FROM lines GROUP BY ALL", "lines"))
def diff_stats(spark, d):
    return ln.diff_stats(v.lines(spark, d), "hunk_id")


@query(sql("""SELECT review_id, hunk_id, idx::INT AS idx, (1 + coalesce(sum((kind <> 'added')::INT) OVER w, 0))::BIGINT AS old_ctr, (1 + coalesce(sum((kind <> 'removed')::INT) OVER w, 0))::BIGINT AS new_ctr
FROM lines WINDOW w AS (PARTITION BY review_id, hunk_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "lines"))
def line_counters(spark, d):
    return ln.line_counters(v.lines(spark, d)).select("review_id", "hunk_id", "idx", "old_ctr", "new_ctr")


@query(sql("""SELECT review_id, hunk_id, (idx // 3)::BIGINT + 1 AS run, 1 AS k, min(idx) FILTER (kind = 'removed')::INT AS old_idx, min(idx) FILTER (kind = 'added')::INT AS new_idx
FROM lines WHERE kind <> 'context' GROUP BY ALL""", "lines"))
def pair_changed_lines(spark, d):
    return ln.pair_changed_lines(v.lines(spark, d))


@query(sql(""", t AS (SELECT review_id, hunk_id, idx, kind, source, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM lines),
r AS (SELECT *, row_number() OVER (PARTITION BY review_id, hunk_id ORDER BY idx) AS r FROM t WHERE kind <> 'context' AND t <> ''),
x AS (SELECT review_id, hunk_id, string_agg(CASE kind WHEN 'added' THEN '+' ELSE '-' END || CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '…' ELSE t END, ' ⏎ ' ORDER BY idx) AS digest FROM r WHERE r <= 3 GROUP BY ALL),
n AS (SELECT review_id, hunk_id, max(source) AS s, count_if(kind = 'added')::BIGINT AS added, count_if(kind = 'removed')::BIGINT AS removed, any_value(digest) AS digest FROM t LEFT JOIN x USING (review_id, hunk_id) GROUP BY review_id, hunk_id)
SELECT review_id, hunk_id, added, removed, CASE WHEN coalesce(s, '') = '' THEN '' ELSE '@@ ' || s || ' @@ ' END || '+' || added || ' -' || removed || coalesce(' | ' || digest, '') AS digest FROM n""", "lines").replace("\\\\", "\\"))
def hunk_digest(spark, d):
    return ln.hunk_digest(v.lines(spark, d).withColumn("section", F.col("source")))


@query(sql("""SELECT review_id, hunk_id, substr(sha256(path || chr(0) || string_agg(CASE kind WHEN 'added' THEN '+' WHEN 'removed' THEN '-' ELSE ' ' END || text, chr(10) ORDER BY idx)), 1, 16) AS content_hash
FROM lines GROUP BY review_id, hunk_id, path""", "lines"))
def hunk_content_hash(spark, d):
    return ln.hunk_content_hash(v.lines(spark, d))


@query(sql("""SELECT review_id, hunk_id, regexp_replace(coalesce(string_agg(text, '' ORDER BY idx) FILTER (kind = 'removed'), ''), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')
    = regexp_replace(coalesce(string_agg(text, '' ORDER BY idx) FILTER (kind = 'added'), ''), '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS whitespace_only FROM lines GROUP BY ALL""", "lines").replace("\\\\", "\\"))
def whitespace_only(spark, d):
    return ln.whitespace_only(v.lines(spark, d))


@query(sql("""SELECT doc_id, path, row_number() OVER (PARTITION BY review_id ORDER BY string_split(regexp_replace(path, '/[^/]*$', ''), '/'), regexp_extract(path, '[^/]*$'), path)::INT AS tree_pos FROM files""", "files"))
def tree_order(spark, d):
    return ln.tree_order(v.files(spark, d)).select("doc_id", "path", "tree_pos")


@query(sql(""", x AS (SELECT *, string_split(path, '/') AS p FROM files),
e AS (SELECT review_id, added, removed, reviewed, unnest(list_transform(range(0, len(p)), lambda i: CASE WHEN i = 0 THEN '.' ELSE array_to_string(p[1:i], '/') END)) AS dir FROM x)
SELECT review_id, dir, count(*) AS files, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, count_if(reviewed)::BIGINT AS done FROM e GROUP BY ALL""", "files"))
def directory_rollup(spark, d):
    return ln.directory_rollup(v.files(spark, d))


@query(None)
def group_by_directory(spark, d):
    return ln.group_by_directory(v.files(spark, d).select("review_id", "doc_id", "path", "weight"), most=400).select("review_id", "doc_id", "path", "dir")


@query(None)
def pack_batches(spark, d):
    f = v.files(spark, d)
    items = f.select("review_id", F.concat("review_id", F.lit("/"), "source").alias("dir"), F.col("doc_id").alias("ord"), "weight")
    return ln.pack_batches(items, 40)


@query(sql(""", x AS (SELECT review_id, source AS module, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS p FROM files),
y AS (SELECT review_id, module, min(p) AS a, max(p) AS z FROM x GROUP BY ALL)
SELECT review_id, module, array_to_string(a[1:len(list_filter(range(1, least(len(a), len(z)) + 1), lambda i: a[1:i] = z[1:i]))], '/') AS root FROM y""", "files"))
def package_roots(spark, d):
    f = v.files(spark, d).withColumn("module", F.col("source"))
    return ln.package_roots(f).withColumn("root", F.array_join("root", "/"))


@query(None)
def unified_diffs(spark, d):
    """Documents rendered as diffs and read back, with counts by file."""
    return _rendered(spark, d)[2].groupBy("review_id", "kind").agg(F.count("*").alias("lines"), F.sum(F.coalesce("old_line", F.lit(0))).alias("old_sum"), F.sum(F.coalesce("new_line", F.lit(0))).alias("new_sum"))


def _rendered(spark, d):
    rows = v.lines(spark, d)
    sign = F.when(F.col("kind") == "added", "+").when(F.col("kind") == "removed", "-").otherwise(" ")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat(sign, F.regexp_replace("text", "\r$", "")).alias("t")))), lambda x: x["t"])
    raw = rows.groupBy("hunk_id", "path").agg(F.array_join(ordered, "\n").alias("body"), F.count_if(F.col("kind") != "added").alias("o"), F.count_if(F.col("kind") != "removed").alias("n"))
    text = F.format_string("diff --git a/%s b/%s\n--- a/%s\n+++ b/%s\n@@ -1,%d +1,%d @@ f\n%s", "path", "path", "path", "path", "o", "n", "body")
    return sd.read_unified_diffs(raw.select(F.col("hunk_id").cast("string").alias("review_id"), text.alias("raw")))


SQL["unified_diffs"] = sql(""", n AS (
    SELECT hunk_id, kind, CASE WHEN kind <> 'added' THEN sum((kind <> 'added')::INT) OVER w END AS o, CASE WHEN kind <> 'removed' THEN sum((kind <> 'removed')::INT) OVER w END AS n
    FROM lines WINDOW w AS (PARTITION BY hunk_id ORDER BY idx))
SELECT hunk_id::VARCHAR AS review_id, kind, count(*) AS lines, coalesce(sum(o), 0)::BIGINT AS old_sum, coalesce(sum(n), 0)::BIGINT AS new_sum FROM n GROUP BY ALL""", "lines")


@query(sql("SELECT doc_id::VARCHAR AS review_id, 'src/main/java/' || source || '/D' || (doc_id % 7) || '/F' || doc_id || '.java' AS path, 'modified' AS status FROM documents", "versions"))
def diff_file_headers(spark, d):
    return _rendered(spark, d)[0].select("review_id", "path", "status")


# Paths and texts


@query(sql("""SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS module, (map {'java': 'java', 'ts': 'typescript', 'html': 'html', 'md': 'markdown', 'yml': 'yaml', 'sql': 'sql'})[regexp_extract(path, '[^.]*$')] AS language,
    regexp_matches(path, '(^|/)(test|tests|e2e)/') OR contains(regexp_extract(path, '[^/]*$'), '.spec.') OR regexp_matches(string_split(regexp_extract(path, '[^/]*$'), '.')[1], '.Test$') AS is_test FROM files""", "files"))
def path_facts(spark, d):
    p = F.col("path")
    return v.files(spark, d).select("doc_id", "path", fp.module_of(p, F.lit(None)).alias("module"), fp.language(p).alias("language"), fp.is_test_path(p).alias("is_test"))


@query("""WITH p AS (SELECT page_id, 'm' || (page_id % 5) || (['/package-lock.json', '/src/A.java', '/gradlew', '/generated/B.kt', '/x.min.js', '/y.js', '/a.g.dart', '/z.generated.ts', '/gradle/wrapper/w.jar', '/Cargo.lock', '/mvnw.txt'])[(page_id % 11 + 1)::INT] AS path FROM pages)
SELECT page_id, path, page_id % 11 NOT IN (1, 5, 10) AS is_generated FROM p""")
def mark_generated_defaults(spark, d):
    names = ("/package-lock.json", "/src/A.java", "/gradlew", "/generated/B.kt", "/x.min.js", "/y.js", "/a.g.dart", "/z.generated.ts", "/gradle/wrapper/w.jar", "/Cargo.lock", "/mvnw.txt")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % 11 + 1).cast("int"))
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("m"), (F.col("page_id") % 5).cast("string"), name).alias("path"))
    return pages.withColumn("is_generated", fp.matches_any(F.col("path"), fp.GENERATED))


@query(sql("""SELECT doc_id, (regexp_matches(path, '^docs/') OR path LIKE '%.map') AS is_generated FROM files""", "files"))
def mark_generated(spark, d):
    return v.files(spark, d).select("doc_id", fp.matches_any(F.col("path"), ("docs/**", "**/*.map")).alias("is_generated"))


@query(sql(""", x AS (SELECT doc_id, lower(path) AS p, regexp_extract(path, '[^.]*$') AS e FROM files)
SELECT doc_id, CASE WHEN contains(p, 'test') OR contains(p, 'spec') THEN 'tests' WHEN e = 'sql' THEN 'persistence' WHEN contains(p, 'docs/') OR e = 'md' THEN 'docs'
    WHEN e = 'yml' OR contains(p, 'config') THEN 'config' WHEN e = 'html' OR contains(p, 'component') THEN 'ui' ELSE 'core' END AS layer FROM x""", "files"))
def guess_layer(spark, d):
    return v.files(spark, d).select("doc_id", fp.guess_layer(F.col("path")).alias("layer"))


@query(sql(""", p AS (SELECT doc_id, string_split(path, '/') AS p FROM files)
SELECT doc_id, CASE WHEN p[1] = 'src' THEN p[2] END AS source_set, CASE WHEN p[1] = 'src' THEN p[3] END AS code, array_to_string(CASE WHEN p[1] = 'src' THEN p[4:len(p) - 1] ELSE p[1:len(p) - 1] END, '/') AS dirs, p[-1] AS name FROM p""", "files"))
def split_path(spark, d):
    s = fp.split_path(F.col("path"))
    return v.files(spark, d).withColumn("s", s).select("doc_id", "s.source_set", "s.code", F.array_join("s.dirs", "/").alias("dirs"), "s.name")


@query(sql("""SELECT doc_id, sha1(path) || '_' || added || '_' || removed AS position_id, path || ':' || added || CASE WHEN removed = 0 THEN '' ELSE '-' || (added + removed) END || CASE WHEN reviewed THEN ' (old)' ELSE '' END AS location FROM files""", "files"))
def position_ids(spark, d):
    return v.files(spark, d).select("doc_id", ft.position_id(F.col("path"), F.col("added"), F.col("removed")).alias("position_id"), ft.location(F.col("path"), F.col("added"), F.col("added") + F.col("removed"), F.col("reviewed")).alias("location"))


@query("""SELECT page_id, lower(n[1]) AS name, count(*) AS lines FROM (
    SELECT DISTINCT page_id, i, unnest(list_transform(regexp_extract_all(l, '<([A-Za-z][A-Za-z0-9_-]*)', 1), lambda x: [lower(x)])) AS n
    FROM (SELECT page_id, unnest(range(len(s))) AS i, unnest(s) AS l FROM (SELECT page_id, string_split(html, chr(10)) AS s FROM pages))) GROUP BY ALL""")
def html_elements(spark, d):
    return sf.html_elements(table(spark, d, "pages"), "page_id", "html", "").groupBy(F.col("id").alias("page_id"), "name").agg(F.count("*").alias("lines"))


@query(None)
def json_keys(spark, d):
    return sf.json_keys(table(spark, d, "events"), "event_id", "props").select(F.col("id").alias("event_id"), "key", "value")


SQL["json_keys"] = "SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"


# Versions, reviews, groups


@query(sql("""SELECT count(*) AS blobs, count_if(known)::BIGINT AS known FROM (
    SELECT DISTINCT content_hash, review_id, (content_hash, review_id) IN (SELECT (content_hash, review_id) FROM versions WHERE head = 0) AS known FROM versions WHERE head = 1)""", "versions"))
def dedupe_by_content(spark, d):
    base, head = v.versions(spark, d)
    tree = head.select(F.col("content_hash").alias("blob"), F.col("review_id").alias("lang"))
    todo, reused = sf.dedupe_by_content(tree, base.select(F.col("content_hash").alias("blob"), F.col("review_id").alias("lang")).distinct())
    both = todo.withColumn("known", F.lit(False)).unionByName(reused.withColumn("known", F.lit(True)))
    return both.agg(F.count("*").alias("blobs"), F.count_if("known").alias("known"))


@query(sql(""", r AS (SELECT DISTINCT review_id, content_hash FROM versions WHERE head = 0)
SELECT h.review_id, h.source AS path, bool_and(r.content_hash IS NOT NULL) AS done FROM versions h LEFT JOIN r USING (review_id, content_hash) WHERE h.head = 1 GROUP BY ALL""", "versions"))
def carry_over_reviewed(spark, d):
    base, head = v.versions(spark, d)
    return m.carry_over_reviewed(base.select("review_id", "content_hash"), head.withColumn("path", F.col("source")))[1]


@query(sql("SELECT review_id AS snapshot_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))) AS word FROM versions WHERE head = 0", "versions").replace("SELECT review_id", "SELECT DISTINCT review_id"))
def word_inventory(spark, d):
    base, _ = v.versions(spark, d)
    return gr.word_inventory(base.select(F.col("review_id").alias("snapshot_id"), "text"))


@query(sql(""", w AS (SELECT DISTINCT review_id, head, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM versions),
p AS (SELECT DISTINCT review_id, lower(word) AS hunk_id, word AS old, upper(word[1]) || word[2:] AS new FROM w),
c AS (SELECT p.*, old IN (SELECT word FROM w WHERE head = 1 AND w.review_id IS NOT DISTINCT FROM p.review_id) OR new IN (SELECT word FROM w WHERE head = 0 AND w.review_id IS NOT DISTINCT FROM p.review_id) AS doubt FROM p WHERE review_id IS NOT NULL)
SELECT review_id, hunk_id, old, new FROM c QUALIFY NOT bool_or(doubt) OVER (PARTITION BY review_id, hunk_id)""", "versions"))
def confirm_renames(spark, d):
    """Every word of a review may have got a capital; the spellings of a word are a hunk."""
    base, head = v.versions(spark, d)
    words = lambda df: gr.word_inventory(df.select(F.col("review_id").alias("snapshot_id"), "text")).withColumnRenamed("snapshot_id", "review_id")
    every = words(base).union(words(head)).distinct().where("review_id IS NOT NULL")
    new = F.concat(F.upper(F.substring("word", 1, 1)), F.substr("word", F.lit(2)))
    return gr.confirm_renames(every.select("review_id", F.lower("word").alias("hunk_id"), F.col("word").alias("old"), new.alias("new")), words(base), words(head))


def _assignment(spark, d):
    f = v.files(spark, d)
    return f.where("doc_id % 10 <> 0").select(
        "review_id", F.when(F.col("doc_id") % 4 == 0, "API").when(F.col("doc_id") % 4 == 1, "api").when(F.col("doc_id") % 4 == 2, "Model").otherwise("core").alias("layer"),
        (F.col("doc_id") % 23).alias("group_id"), F.when(F.col("doc_id") % 23 == 7, " ").otherwise("t").alias("title"), (F.col("doc_id") - F.col("doc_id") % 2).alias("item_id"), F.col("doc_id").alias("pos"),
    )


_ASSIGNED = """, a AS (
    SELECT review_id, CASE doc_id % 4 WHEN 0 THEN 'API' WHEN 1 THEN 'api' WHEN 2 THEN 'Model' ELSE 'core' END AS layer, doc_id % 23 AS group_id, CASE WHEN doc_id % 23 = 7 THEN ' ' ELSE 't' END AS title, doc_id - doc_id % 2 AS item_id, doc_id AS pos
    FROM files WHERE doc_id % 10 <> 0),
e AS (SELECT review_id, doc_id AS item_id FROM files WHERE doc_id % 3 <> 0)
"""


def _expected(spark, d):
    return v.files(spark, d).where("doc_id % 3 <> 0").select("review_id", F.col("doc_id").alias("item_id"))


@query(sql(_ASSIGNED + """SELECT DISTINCT review_id, 'unknown' AS problem, item_id::VARCHAR AS id FROM a ANTI JOIN e USING (review_id, item_id)
UNION ALL SELECT review_id, 'duplicate', item_id::VARCHAR FROM a GROUP BY review_id, item_id HAVING count(*) > 1
UNION ALL SELECT review_id, 'missing', item_id::VARCHAR FROM e ANTI JOIN a USING (review_id, item_id)
UNION ALL SELECT DISTINCT review_id, 'untitled', group_id::VARCHAR FROM a WHERE trim(title) = ''""", "files"))
def check_assignment(spark, d):
    return gr.check_assignment(_assignment(spark, d), _expected(spark, d))


@query(sql(_ASSIGNED + "SELECT review_id, item_id, layer, group_id, pos FROM a SEMI JOIN e USING (review_id, item_id) QUALIFY row_number() OVER (PARTITION BY review_id, item_id ORDER BY layer, group_id, pos) = 1", "files"))
def salvage_assignment(spark, d):
    return gr.salvage_assignment(_assignment(spark, d), _expected(spark, d))[0].select("review_id", "item_id", "layer", "group_id", "pos")


@query(sql(_ASSIGNED + """, f AS (SELECT review_id, lower(trim(layer)) AS layer, min(pos) AS p FROM a GROUP BY ALL)
SELECT DISTINCT review_id, layer, row_number() OVER (PARTITION BY review_id ORDER BY p, layer)::INT AS layer_pos FROM f""", "files"))
def normalize_layers(spark, d):
    return gr.normalize_layers(_assignment(spark, d)).select("review_id", "layer", "layer_pos").distinct()


@query(sql(_ASSIGNED + """, r AS (SELECT review_id, group_id, CASE WHEN lower(layer) = 'api' THEN 2 WHEN layer = 'Model' THEN 0 ELSE 1 END AS r, count(*) AS n FROM a GROUP BY ALL)
SELECT review_id, group_id, r::INT AS rank FROM r QUALIFY row_number() OVER (PARTITION BY review_id, group_id ORDER BY n DESC, r) = 1""", "files"))
def dominant_layer_rank(spark, d):
    return gr.dominant_layer_rank(_assignment(spark, d))


@query(sql(_ASSIGNED + "SELECT review_id, group_id, count_if(item_id % 4 = 0 AND EXISTS (SELECT 1 FROM e WHERE e.review_id = a.review_id AND e.item_id = a.item_id))::BIGINT AS done, count(*) AS total FROM a GROUP BY ALL", "files"))
def group_progress(spark, d):
    return gr.group_progress(_assignment(spark, d), _expected(spark, d).where("item_id % 4 = 0"))


@query(sql("""SELECT review_id, source AS old, (doc_id % 4)::VARCHAR AS new, count(DISTINCT doc_id) AS hunks FROM files GROUP BY ALL""", "files"))
def rename_counts(spark, d):
    return gr.rename_counts(v.files(spark, d).select("review_id", F.col("source").alias("old"), (F.col("doc_id") % 4).cast("string").alias("new"), F.col("doc_id").alias("hunk_id")))


@query(sql("""SELECT review_id, 'renamed' AS class, source AS old, (doc_id % 4)::VARCHAR AS new, count(DISTINCT doc_id) AS hunks,
    row_number() OVER (PARTITION BY review_id ORDER BY count(DISTINCT doc_id) DESC, source, (doc_id % 4)::VARCHAR)::INT AS rank FROM files GROUP BY review_id, source, doc_id % 4 QUALIFY rank <= 8""", "files"))
def aside_summary(spark, d):
    return gr.aside_summary(v.files(spark, d).select("review_id", F.lit("renamed").alias("class"), F.col("source").alias("old"), (F.col("doc_id") % 4).cast("string").alias("new"), F.col("doc_id").alias("hunk_id")))


@query(sql(""", x AS (SELECT lang, source, doc_id % 50 AS step, (doc_id % 3)::VARCHAR AS parent, doc_id % 2 AS head FROM documents),
b AS (SELECT lang AS entry_id, step AS step_id, list_sort(list_distinct(list(parent))) AS p FROM x WHERE head = 0 AND source < 'src2' GROUP BY ALL), a AS (SELECT lang AS entry_id, step - 1 AS step_id, list_sort(list_distinct(list(parent))) AS p FROM x WHERE head = 1 GROUP BY ALL)
SELECT 's1' AS snapshot_id, entry_id, step_id, CASE WHEN b.p IS NULL THEN 'added' WHEN a.p IS NULL THEN 'removed' ELSE 'rerouted' END AS change FROM b FULL JOIN a USING (entry_id, step_id) WHERE b.p IS NULL OR a.p IS NULL OR b.p <> a.p""", "versions"))
def step_changes(spark, d):
    x = table(spark, d, "documents").select(F.lit("s1").alias("snapshot_id"), F.col("lang").alias("entry_id"), "source", (F.col("doc_id") % 50).alias("step_id"), (F.col("doc_id") % 3).cast("string").alias("parent_id"), (F.col("doc_id") % 2).alias("head"))
    return gr.step_changes(x.where("head = 0 AND source < 'src2'"), x.where("head = 1").withColumn("step_id", F.col("step_id") - 1))


# Joins


@query("""WITH p AS (SELECT user_id::VARCHAR AS file, event_id AS point_id, (epoch(ts)::BIGINT // 60)::BIGINT AS line FROM events WHERE event_type = 'purchase'),
s AS (SELECT user_id::VARCHAR AS file, event_id AS span_id, event_id AS pos, (epoch(ts)::BIGINT // 60)::BIGINT - 30 * (event_id % 40) AS start, (epoch(ts)::BIGINT // 60)::BIGINT + 60 * (event_id % 40) AS stop FROM events WHERE event_type <> 'purchase')
SELECT 's1' AS snapshot_id, point_id, span_id FROM p JOIN s USING (file) WHERE line BETWEEN start AND stop QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY stop - start, pos, span_id) = 1""")
def innermost_span(spark, d):
    # The SQL rounds seconds (half to even) before it takes minutes.
    second = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    e = table(spark, d, "events").select(F.lit("s1").alias("snapshot_id"), F.col("user_id").cast("string").alias("file"), "event_id", "event_type", (second / 60).cast("long").alias("line"))
    points = e.where("event_type = 'purchase'").select("snapshot_id", "file", "line", F.col("event_id").alias("point_id"))
    w = F.col("event_id") % 40
    spans = e.where("event_type <> 'purchase'").select("snapshot_id", "file", F.col("event_id").alias("span_id"), F.col("event_id").alias("pos"), (F.col("line") - 30 * w).alias("start"), (F.col("line") + 60 * w).alias("stop"))
    return m.innermost_span(points, spans, bucket=1440)


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT 's1' AS snapshot_id, p.event_id::VARCHAR AS ref_id, s.event_id::VARCHAR AS type_name FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def last_binding(spark, d):
    e = table(spark, d, "events").select(F.lit("s1").alias("snapshot_id"), F.col("user_id").alias("scope"), F.lit("x").alias("name"), F.col("ts").alias("at"), "event_id", "event_type")
    refs = e.where("event_type = 'purchase'").withColumn("ref_id", F.col("event_id").cast("string"))
    bindings = e.where("event_type = 'signup'").withColumn("type_name", F.col("event_id").cast("string")).withColumn("ord", F.col("event_id").cast("long"))
    return m.last_binding(refs, bindings)


_RESOLVE = """WITH r AS (SELECT c_custkey AS ref_id, c_mktsegment AS file, c_nationkey AS package, 'S' || (c_custkey % 40) AS name FROM customer),
d AS (SELECT s_suppkey AS symbol_id, CASE WHEN s_suppkey % 3 = 0 THEN 'BUILDING' ELSE 'f' || s_suppkey END AS file, s_nationkey AS package, 'S' || (s_suppkey % 40) AS name FROM supplier),
i AS (SELECT 'MACHINERY' AS file, 'S' || k AS name, k AS package FROM range(25) t(k)),
w AS (SELECT 'FURNITURE' AS file, n_nationkey AS package FROM nation WHERE n_regionkey = 1),
few AS (SELECT name FROM d GROUP BY name HAVING count(*) <= 5),
t AS (
    SELECT ref_id, symbol_id, 0 AS tier FROM r JOIN d USING (file, name)
    UNION SELECT ref_id, d.symbol_id, 1 FROM r JOIN i USING (file, name) LEFT JOIN d ON d.package = i.package AND d.name = r.name
    UNION SELECT ref_id, symbol_id, 2 FROM r JOIN d USING (package, name)
    UNION SELECT ref_id, symbol_id, 3 FROM r JOIN w USING (file) JOIN d ON d.package = w.package AND d.name = r.name
    UNION SELECT ref_id, symbol_id, 4 FROM r JOIN d USING (name) JOIN few USING (name)),
b AS (SELECT *, min(tier) OVER (PARTITION BY ref_id) AS best FROM t),
k AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS n FROM b WHERE tier = best AND symbol_id IS NOT NULL)
SELECT 's1' AS snapshot_id, ref_id, symbol_id, tier, round([1.0, 0.95, 0.9, 0.85, 0.3][tier + 1]::DOUBLE / n, 6) AS confidence FROM k WHERE n <= 5"""


@query(_RESOLVE)
def resolve_names(spark, d):
    p = F.lit("s1").alias("snapshot_id")
    refs = table(spark, d, "customer").select(p, F.col("c_custkey").alias("ref_id"), F.col("c_mktsegment").alias("file"), F.col("c_nationkey").cast("long").alias("package"), F.concat(F.lit("S"), F.col("c_custkey") % 40).alias("name"))
    file = F.when(F.col("s_suppkey") % 3 == 0, "BUILDING").otherwise(F.concat(F.lit("f"), "s_suppkey"))
    defs = table(spark, d, "supplier").select(p, F.col("s_suppkey").alias("symbol_id"), file.alias("file"), F.col("s_nationkey").cast("long").alias("package"), F.concat(F.lit("S"), F.col("s_suppkey") % 40).alias("name"))
    imports = spark.range(25).select(p, F.lit("MACHINERY").alias("file"), F.concat(F.lit("S"), "id").alias("name"), F.col("id").alias("package"))
    wild = table(spark, d, "nation").where("n_regionkey = 1").select(p, F.lit("FURNITURE").alias("file"), F.col("n_nationkey").cast("long").alias("package"))
    out = m.resolve_names(refs, defs, imports, wild)
    return out.select("snapshot_id", "ref_id", "symbol_id", "tier", F.round("confidence", 6).alias("confidence"))


def _facts(spark, d):
    """Customers as classes that refer to suppliers by name: (references, symbols, imports, wildcards) of the view of resolve_names."""
    p = F.lit("s1").alias("snapshot_id")
    c = table(spark, d, "customer")
    own = F.concat(F.lit("c"), "c_custkey")
    refs = c.select(
        p, F.col("c_custkey").alias("ref_id"), F.col("c_mktsegment").alias("file"), F.col("c_nationkey").cast("long").alias("package"), F.concat(F.lit("S"), F.col("c_custkey") % 40).alias("name"),
        own.alias("scope_id"), (F.col("c_custkey") % 9).cast("int").alias("line"), F.element_at(F.array(*map(F.lit, ("extends", "call", "type", "new"))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("kind"),
    )
    file = F.when(F.col("s_suppkey") % 3 == 0, "BUILDING").otherwise(F.concat(F.lit("f"), "s_suppkey"))
    symbols = table(spark, d, "supplier").select(
        p, F.concat(F.lit("s"), "s_suppkey").alias("symbol_id"), file.alias("file"), F.col("s_nationkey").cast("long").alias("package"), F.concat(F.lit("S"), F.col("s_suppkey") % 40).alias("name"), F.lit("interface").alias("kind"))
    symbols = symbols.unionByName(c.select(p, own.alias("symbol_id"), F.col("c_mktsegment").alias("file"), F.lit(-1).cast("long").alias("package"), F.col("c_name").alias("name"), F.lit("class").alias("kind")))
    imports = spark.range(25).select(p, F.lit("MACHINERY").alias("file"), F.concat(F.lit("S"), "id").alias("name"), F.col("id").alias("package"))
    wild = table(spark, d, "nation").where("n_regionkey = 1").select(p, F.lit("FURNITURE").alias("file"), F.col("n_nationkey").cast("long").alias("package"))
    return refs, symbols, imports, wild


_RESOLVED = _RESOLVE[: _RESOLVE.rindex("SELECT 's1' AS snapshot_id")].rstrip() + """,
res AS (SELECT ref_id, 's' || symbol_id AS to_id, [1.0, 0.95, 0.9, 0.85, 0.3][tier + 1]::DOUBLE / n AS confidence FROM k WHERE n <= 5)
"""


@query(_RESOLVED + "SELECT 's1' AS snapshot_id, 'c' || ref_id AS from_id, to_id, 'inherits' AS kind, round(confidence, 6) AS confidence, (ref_id % 9)::INT AS line FROM res WHERE ref_id % 4 = 0")
def inheritance_edges(spark, d):
    return rs.inheritance_edges(*_facts(spark, d))[0].withColumn("confidence", F.round("confidence", 6))


@query(_RESOLVED + """SELECT 's1' AS snapshot_id, 'c' || ref_id AS from_id, to_id, CASE WHEN ref_id % 4 = 2 THEN 'uses' ELSE 'calls' END AS kind, round(confidence, 6) AS confidence, (ref_id % 9)::INT AS line
FROM res WHERE ref_id % 4 <> 0 AND NOT (ref_id % 4 = 2 AND to_id = 's' || (ref_id % 40))""")
def reference_edges(spark, d):
    """Calls, instantiations and type mentions; a customer lies inside the supplier whose number ends like its own."""
    refs, symbols, imports, wild = _facts(spark, d)
    above = refs.select("snapshot_id", F.col("scope_id").alias("symbol_id"), F.concat(F.lit("s"), F.col("ref_id") % 40).alias("ancestor_id"))
    edges, _ = rs.reference_edges(refs, rs.resolve_types(refs, symbols, imports, wild), above)
    return edges.withColumn("confidence", F.round("confidence", 6))


@query(_RESOLVED + """, inh AS (SELECT 'c' || ref_id AS f, to_id AS sup, confidence AS c FROM res WHERE ref_id % 4 = 0 UNION ALL SELECT 's' || s_suppkey, 's' || (s_suppkey % 7 + 1), 1.0 FROM supplier WHERE s_suppkey > 7),
lv AS (SELECT 's' || s_suppkey AS t, 's' || s_suppkey AS r, 0 AS dist FROM supplier UNION ALL SELECT 's' || s_suppkey, 's' || (s_suppkey % 7 + 1), 1 FROM supplier WHERE s_suppkey > 7),
me AS (SELECT 's' || s_suppkey AS o, 'm' || (s_suppkey % 5) AS name, s_suppkey % 2 AS params, s_suppkey % 9 AS line FROM supplier UNION ALL SELECT 'c' || c_custkey, 'm' || (c_custkey % 3), c_custkey % 2, c_custkey % 9 FROM customer),
hit AS (SELECT a.o, a.line, a.params, sup, inh.c, b.o AS b, b.params AS bp, dist, min(dist) OVER (PARTITION BY a.o, sup) AS best FROM me a JOIN inh ON inh.f = a.o JOIN lv ON t = sup JOIN me b ON b.o = r AND b.name = a.name)
SELECT 's1' AS snapshot_id, o || '.m' AS from_id, b || '.m' AS to_id, 'overrides' AS kind, line::INT AS line, round(0.9 * max(c), 6) AS confidence FROM hit WHERE dist = best AND params = bp GROUP BY ALL""")
def override_edges(spark, d):
    """A method for each customer and supplier; customers inherit from what they name, suppliers from one of the first seven."""
    refs, symbols, imports, wild = _facts(spark, d)
    k = F.col("k")
    people = symbols.withColumn("k", F.substr("symbol_id", F.lit(2)).cast("long")).where("kind IN ('class', 'interface')")
    up = people.where("kind = 'interface' AND k > 7").select("snapshot_id", F.col("symbol_id").alias("from_id"), F.concat(F.lit("s"), k % 7 + 1).alias("to_id"), F.lit(1.0).alias("confidence"))
    inherits = rs.inheritance_edges(refs, symbols, imports, wild)[0].select("snapshot_id", "from_id", "to_id", "confidence").unionByName(up)
    name = F.concat(F.lit("m"), F.when(F.col("kind") == "interface", k % 5).otherwise(k % 3))
    methods = people.select("snapshot_id", F.concat("symbol_id", F.lit(".m")).alias("symbol_id"), F.col("symbol_id").alias("container_id"), name.alias("name"), F.lit("method").alias("kind"), (k % 2).alias("params"), (k % 9).cast("int").alias("line"))
    levels = rs.hierarchy(inherits, people.where("kind = 'interface'"))
    return rs.override_edges(methods, inherits, levels).withColumn("confidence", F.round("confidence", 6))


@query("""WITH i AS (SELECT c_custkey AS import_id, c_mktsegment AS file, c_nationkey AS package, 'S' || (c_custkey % 40) AS name, c_custkey % 9 AS line, c_custkey % 2 = 0 AS jvm, 'f' || (c_custkey % 30) AS path FROM customer),
s AS (SELECT 's' || s_suppkey AS symbol_id, CASE WHEN s_suppkey % 3 = 0 THEN 'BUILDING' ELSE 'f' || s_suppkey END AS file, s_nationkey AS package, 'S' || (s_suppkey % 40) AS name FROM supplier),
j AS (SELECT i.file AS f, symbol_id AS t, 1.0 / count(*) OVER (PARTITION BY import_id) AS c, line FROM i JOIN s USING (package, name) WHERE jvm),
n AS (SELECT import_id, i.file AS f, symbol_id AS t, line FROM i JOIN s ON s.file = i.path AND s.name = i.name WHERE NOT jvm),
u AS (SELECT * FROM j UNION ALL SELECT f, t, 1.0, line FROM n UNION ALL SELECT file, path, 1.0, line FROM i WHERE NOT jvm AND import_id NOT IN (SELECT import_id FROM n))
SELECT DISTINCT 's1' AS snapshot_id, f AS from_id, t AS to_id, 'imports' AS kind, round(c, 6)::DOUBLE AS confidence, line::INT AS line FROM u""")
def import_edges(spark, d):
    refs, symbols, _, _ = _facts(spark, d)
    imports = refs.select("snapshot_id", F.col("ref_id").alias("import_id"), "file", "package", "name", "line", (F.col("ref_id") % 2 == 0).alias("is_jvm"))
    files = refs.select("snapshot_id", F.col("ref_id").alias("import_id"), F.concat(F.lit("f"), F.col("ref_id") % 30).alias("path"))
    tops = symbols.where("kind = 'interface'").withColumn("container_id", F.col("file"))
    return rs.import_edges(imports, tops, files).withColumn("confidence", F.round("confidence", 6))


@query(sql(""", above AS (SELECT 's' || s_suppkey AS symbol_id, 's' || (s_suppkey % 10 + 1) AS ancestor_id FROM supplier WHERE s_suppkey % 10 + 1 <> s_suppkey), t AS (SELECT * FROM edges WHERE kind = 'tests'),
x AS (SELECT to_id AS symbol_id, from_id AS test_id, confidence FROM t UNION ALL SELECT symbol_id, from_id, confidence * 0.5 FROM above JOIN t ON to_id = ancestor_id)
SELECT 's1' AS snapshot_id, symbol_id, test_id, round(max(confidence), 6) AS confidence FROM x GROUP BY ALL""", "candidates", "edges"))
def tests_of(spark, d):
    """Each supplier lies inside one of the first ten."""
    s = table(spark, d, "supplier").select(F.lit("s1").alias("snapshot_id"), F.concat(F.lit("s"), "s_suppkey").alias("symbol_id"), F.concat(F.lit("s"), F.col("s_suppkey") % 10 + 1).alias("ancestor_id"))
    out = g.tests_of(v.edges(spark, d), v.symbols(spark, d), s.where("symbol_id <> ancestor_id"))
    return out.select("snapshot_id", "symbol_id", "test_id", F.round("confidence", 6).alias("confidence"))


@query(sql(""", x AS (SELECT review_id, hunk_id, path, kind, idx // 5 AS j FROM lines WHERE kind <> 'context')
SELECT DISTINCT review_id AS snapshot_id, hunk_id, path || CASE WHEN kind = 'added' AND (j + hunk_id) % 3 = 0 THEN '' ELSE '#f' || j END AS symbol_id FROM x WHERE review_id IS NOT NULL""", "lines"))
def map_hunks_to_symbols(spark, d):
    """Every five lines of a document are a function; a third of them are gone from the head."""
    x = v.lines(spark, d).where("review_id IS NOT NULL").withColumnRenamed("review_id", "snapshot_id")
    j = F.floor(F.col("idx") / 5)
    spans = x.groupBy("snapshot_id", "path", "hunk_id", j.alias("j")).agg(F.count("*").alias("n"))
    defs = spans.select("snapshot_id", F.concat("path", F.lit("#f"), "j").alias("symbol_id"), F.col("path").alias("file"), F.lit("function").alias("kind"), F.col("path").alias("container_id"), (5 * F.col("j") + 1).alias("start"), (5 * F.col("j") + 5).alias("stop"), F.col("j").alias("pos"), ((F.col("j") + F.col("hunk_id")) % 3 == 0).alias("gone"))
    whole = spans.groupBy("snapshot_id", "path").agg(F.sum("n").alias("stop")).select("snapshot_id", F.col("path").alias("symbol_id"), F.col("path").alias("file"), F.lit("file").alias("kind"), F.lit(None).cast("string").alias("container_id"), F.lit(1).cast("long").alias("start"), "stop", F.lit(-1).cast("long").alias("pos"))
    base, head = (whole.unionByName(df.drop("gone")) for df in (defs, defs.where("NOT gone")))
    lines = x.select("snapshot_id", "hunk_id", "path", F.lit(None).cast("string").alias("old_path"), "kind", (F.col("idx") + 1).alias("old_line"), (F.col("idx") + 1).alias("new_line"))
    return rs.map_hunks_to_symbols(lines, head, base)[0]


@query(None)
def match_routes(spark, d):
    calls = table(spark, d, "pages").select(F.lit("s1").alias("snapshot_id"), F.col("page_id").alias("call_id"), F.when(F.col("page_id") % 2 == 0, "GET").otherwise("ANY").alias("method"), ft.url_segments(F.col("url")).alias("segments"))
    langs = table(spark, d, "documents").select("lang").distinct().where("lang IS NOT NULL")
    ends = langs.select(F.lit("s1").alias("snapshot_id"), F.concat(F.lit("GET /"), "lang").alias("endpoint_id"), F.lit("GET").alias("method"), F.array("lang", F.lit("{}")).alias("segments"))
    out = m.match_routes(calls.where("segments IS NOT NULL"), ends)
    return out.select("snapshot_id", "call_id", "endpoint_id", F.round("confidence", 6).alias("confidence"))


SQL["match_routes"] = """WITH c AS (SELECT page_id AS call_id, page_id % 2 = 0 AS get, list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/'), lambda x: x <> '') AS s FROM pages),
l AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)
SELECT 's1' AS snapshot_id, call_id, 'GET /' || lang AS endpoint_id, round(0.9 * 0.85 * CASE WHEN len(s) = 2 THEN 1.0 ELSE 0.7 END * CASE WHEN get THEN 1.0 ELSE 0.8 END, 6) AS confidence
FROM c JOIN l ON s[len(s) - 1] = lang WHERE len(s) >= 2"""


@query(sql(""", t AS (SELECT review_id, doc_id AS test, 'W' || (doc_id % 90) || 'Suite' AS stem, source AS dir FROM files WHERE doc_id % 2 = 0), s AS (SELECT review_id, doc_id AS subject, 'W' || ((doc_id - 1) % 90) AS stem, source AS dir FROM files WHERE doc_id % 2 = 1),
j AS (SELECT review_id, test, subject, t.stem = s.stem AS exact, row_number() OVER (PARTITION BY review_id, test ORDER BY len(s.stem) DESC, (t.dir <> s.dir)::INT, subject) AS r FROM t JOIN s USING (review_id) WHERE starts_with(t.stem, s.stem) AND len(s.stem) >= 3)
SELECT review_id, test, subject, CASE WHEN exact THEN 'stem' ELSE 'prefix' END AS by FROM j WHERE r = 1""", "files"))
def pair_tests_with_subjects(spark, d):
    f = v.files(spark, d)
    stem = F.concat(F.lit("W"), (F.col("doc_id") % 90).cast("string"))
    tests = f.where("doc_id % 2 = 0").select("review_id", F.col("doc_id").alias("test"), F.concat(stem, F.lit("Suite")).alias("stem"), F.col("source").alias("dir"))
    return m.pair_tests_with_subjects(tests, f.where("doc_id % 2 = 1").select("review_id", F.col("doc_id").alias("subject"), F.concat(F.lit("W"), ((F.col("doc_id") - 1) % 90).cast("string")).alias("stem"), F.col("source").alias("dir")))


# Drafts on even documents' lines, placed in the odd ones: every fourth names the hunk that stands
# there, others look for their text in their source.
_DRAFTS = """, dr AS (
    SELECT review_id, hunk_id || '-' || idx AS draft_id, source AS path, CASE WHEN hunk_id % 4 = 0 THEN 'h' || (hunk_id + 1) ELSE '' END AS hunk_hash, idx, kind, text, idx::BIGINT + 1 AS line, idx - 1 AS start_idx
    FROM lines WHERE hunk_id % 2 = 0 AND kind <> 'context'),
li AS (SELECT review_id, source AS path, hunk_id, 'h' || hunk_id AS content_hash, idx, kind, text, (idx + hunk_id % 7)::BIGINT AS n FROM lines WHERE hunk_id % 2 = 1),
same AS (SELECT dr.review_id, draft_id, min(hunk_id) AS hunk_id, idx AS pos, false AS moved FROM dr JOIN li USING (idx, kind, text) WHERE dr.review_id = li.review_id AND content_hash = hunk_hash GROUP BY ALL),
rest AS (SELECT * FROM dr ANTI JOIN same USING (review_id, draft_id)),
near AS (SELECT rest.review_id, draft_id, li.hunk_id, li.idx AS pos, abs(li.n - rest.line) AS far FROM rest JOIN li USING (review_id, path, kind, text)),
one AS (SELECT review_id, draft_id, min(hunk_id) AS hunk_id, min(pos) AS pos, true AS moved FROM (SELECT *, min(far) OVER (PARTITION BY review_id, draft_id) AS best FROM near) WHERE far = best GROUP BY ALL HAVING count(*) = 1),
placed AS (SELECT * FROM same UNION ALL SELECT * FROM one)
"""


@query(sql(_DRAFTS + """SELECT dr.review_id, draft_id, p.hunk_id, p.pos::INT AS idx, coalesce(moved, false) AS moved, p.pos IS NULL AS stale FROM dr LEFT JOIN placed p USING (review_id, draft_id)""", "lines"))
def reanchor_comments(spark, d):
    x = v.lines(spark, d)
    none = F.lit(None).cast("string")
    drafts = x.where("hunk_id % 2 = 0 AND kind <> 'context'").select(
        "review_id", F.concat_ws("-", F.col("hunk_id").cast("string"), F.col("idx").cast("string")).alias("draft_id"), F.col("source").alias("path"), F.lit("new").alias("side"),
        F.when(F.col("hunk_id") % 4 == 0, F.concat(F.lit("h"), F.col("hunk_id") + 1)).otherwise("").alias("hunk_hash"), "idx", "kind", "text", (F.col("idx") + 1).alias("line"),
        F.lit(None).cast("int").alias("start_idx"), none.alias("start_kind"), none.alias("start_text"),
    )
    n = (F.col("idx") + F.col("hunk_id") % 7).cast("int")
    lines = x.where("hunk_id % 2 = 1").select("review_id", "hunk_id", F.concat(F.lit("h"), "hunk_id").alias("content_hash"), F.col("source").alias("path"), "idx", "kind", "text", n.alias("old_line"), n.alias("new_line"))
    return m.reanchor_comments(drafts, lines).drop("start_idx")


# Streaming


def _shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local one only where spark.checkpoint.dir is unset."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or 'file://' + tempfile.gettempdir() + '/changegraph-shared'}/{uuid.uuid4().hex}"


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of files; a table of one file is found by its name in the folder."""
    path = f"{d}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return reader.parquet(path)


@query("SELECT sha256(text) AS blob, lang, max(length(text))::BIGINT AS size FROM documents GROUP BY ALL")
def incremental_facts(spark, d):
    """A stream of documents as files; each content is measured once."""
    from changegraph.streaming.jobs import incremental_facts as job

    work, stream = _shared(spark), _stream(spark, d, "documents")
    files = stream.select(F.sha2(F.col("text").cast("binary"), 256).alias("blob"), "lang", "text")
    job(files, f"{work}/facts", lambda df: df.select("blob", "lang", F.length("text").cast("long").alias("size")), f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/facts")


@query("""SELECT (user_id % 10)::VARCHAR AS review_id, event_type || (user_id % 7) AS content_hash, arg_max(event_id % 2 = 0, event_id) AS flag FROM events GROUP BY ALL""")
def reviewed_state(spark, d):
    """A stream of review marks; the last of each hash counts."""
    from changegraph.streaming.jobs import latest_state
    from changegraph.streaming.jobs import reviewed_state as job

    work, stream = _shared(spark), _stream(spark, d, "events")
    marks = stream.select(
        (F.col("user_id") % 10).cast("string").alias("review_id"), F.concat("event_type", (F.col("user_id") % 7).cast("string")).alias("content_hash"),
        (F.col("event_id") % 2 == 0).alias("flag"), F.timestamp_seconds("event_id").alias("ts"),
    )
    job(marks, f"{work}/state", f"{work}/checkpoint").awaitTermination()
    return latest_state(spark, f"{work}/state").select("review_id", "content_hash", "flag")
