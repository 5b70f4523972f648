"""Views of the star-schema and text tables as graphs, lines and versions, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Customers, suppliers and parts as symbols; the nation or brand is the module."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("module"))
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("nk")).select(
        F.concat(F.lit("c"), "c_custkey").alias("symbol_id"), F.col("c_name").alias("name"), F.lit("class").alias("kind"), "module", (F.col("c_mktsegment") == "BUILDING").alias("changed"), (F.col("c_mktsegment") == "MACHINERY").alias("is_test")
    )
    s = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("nk")).select(
        F.concat(F.lit("s"), "s_suppkey").alias("symbol_id"), F.col("s_name").alias("name"), F.lit("interface").alias("kind"), "module", (F.col("s_suppkey") % 5 == 0).alias("changed"), F.lit(False).alias("is_test")
    )
    return c.unionByName(s).withColumn("snapshot_id", F.lit("s1"))


def n_candidates(spark: SparkSession, d: str) -> int:
    """The number of line items, which Parquet knows: the most edges there can be."""
    return table(spark, d, "lineitem").count()


def edge_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Customers call suppliers, one candidate a line item."""
    from changegraph.operators.graph import spread

    n = n_candidates(spark, d)
    o = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey"), n, "o_orderkey")
    return spread(table(spark, d, "lineitem"), n, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("s1").alias("snapshot_id"), F.concat(F.lit("c"), "o_custkey").alias("from_id"), F.concat(F.lit("s"), "l_suppkey").alias("to_id"),
        F.when(F.col("l_returnflag") == "R", "calls").when(F.col("l_returnflag") == "A", "uses").otherwise("tests").alias("kind"),
        (1 - F.col("l_discount").cast("double") * 8).alias("confidence"), F.col("l_linenumber").cast("int").alias("line"),
        (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber").cast("long")).alias("ord"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    from changegraph.operators.graph import merge_edges, spread

    # By both ends, so that what groups by an edge, or by its ends, finds its rows in one task.
    return merge_edges(spread(edge_candidates(spark, d), n_candidates(spark, d), "from_id", "to_id"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as lines of hunks; languages are reviews."""
    rows = table(spark, d, "documents").select(F.col("lang").alias("review_id"), F.col("doc_id").alias("hunk_id"), "source", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    kind = F.when(F.col("idx") % 3 == 0, "context").when(F.col("idx") % 3 == 1, "removed").otherwise("added")
    return rows.withColumn("kind", kind).withColumn("path", F.concat(F.lit("src/main/java/"), "source", F.lit("/D"), (F.col("hunk_id") % 7).cast("string"), F.lit("/F"), "hunk_id", F.lit(".java")))


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of reviews, with sizes and review marks."""
    doc = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, ("java", "ts", "html", "md", "yml", "sql", "spec.ts"))), (doc % 7 + 1).cast("int"))
    place = F.element_at(F.array(*map(F.lit, ("src/main/java/", "src/test/java/", "docs/", "app/components/", "config/"))), (doc % 5 + 1).cast("int"))
    path = F.concat(place, "source", F.lit("/m"), (doc % 11).cast("string"), F.lit("/Doc"), doc.cast("string"), F.when(doc % 13 == 0, "Test").otherwise(""), F.lit("."), ext)
    return table(spark, d, "documents").select(
        F.col("lang").alias("review_id"), "doc_id", path.alias("path"), "source", "text", F.col("n_chars").alias("size"),
        (doc % 17).alias("added"), (doc % 5).alias("removed"), (doc % 3 == 0).alias("reviewed"), (doc % 9 + 1).alias("weight"),
    )


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents of even id as the base and of odd id as the head, with identities of their texts."""
    rows = table(spark, d, "documents").select(F.col("lang").alias("review_id"), "doc_id", "source", "text", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")


def containers(spark: SparkSession, d: str) -> DataFrame:
    """Customers in nations in regions."""
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("symbol_id"), F.concat(F.lit("n"), "c_nationkey").alias("container_id"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("symbol_id"), F.concat(F.lit("r"), "n_regionkey").alias("container_id"))
    return c.unionByName(n).withColumn("snapshot_id", F.lit("s1"))


def nation_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nations with edges from one to the other: (from_id, to_id, n)."""
    e = edges(spark, d)
    s = symbols(spark, d)
    side = lambda c: s.select(F.col("symbol_id").alias(f"{c}_id"), F.col("module").alias(c))
    rows = e.join(side("from"), "from_id").join(side("to"), "to_id").groupBy("snapshot_id", "from", "to").agg(F.count("*").alias("n"))
    return rows.where(F.col("from") != F.col("to")).select("snapshot_id", F.col("from").alias("from_id"), F.col("to").alias("to_id"), "n")


SQL = {
    "symbols": """symbols AS (
        SELECT 's1' AS snapshot_id, 'c' || c_custkey AS symbol_id, c_name AS name, 'class' AS kind, n_name AS module, c_mktsegment = 'BUILDING' AS changed, c_mktsegment = 'MACHINERY' AS is_test
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 's1', 's' || s_suppkey, s_name, 'interface', n_name, s_suppkey % 5 = 0, false FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "candidates": """candidates AS (
        SELECT 's1' AS snapshot_id, 'c' || o_custkey AS from_id, 's' || l_suppkey AS to_id,
            CASE l_returnflag WHEN 'R' THEN 'calls' WHEN 'A' THEN 'uses' ELSE 'tests' END AS kind,
            1 - l_discount::DOUBLE * 8 AS confidence, l_linenumber::INT AS line, l_orderkey::BIGINT * 10 + l_linenumber::BIGINT AS ord
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "edges": """edges AS (
        SELECT snapshot_id, from_id, to_id, kind, greatest(0.0, least(1.0, max(confidence))) AS confidence, arg_min(line, ord) AS line
        FROM candidates WHERE from_id <> to_id GROUP BY ALL)""",
    "lines": """lines AS (
        SELECT lang AS review_id, doc_id AS hunk_id, source, i AS idx, l[i + 1] AS text,
            CASE i % 3 WHEN 0 THEN 'context' WHEN 1 THEN 'removed' ELSE 'added' END AS kind,
            'src/main/java/' || source || '/D' || (doc_id % 7) || '/F' || doc_id || '.java' AS path
        FROM (SELECT *, unnest(range(len(l))) AS i FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)))""",
    "files": """files AS (
        SELECT lang AS review_id, doc_id, source, text, n_chars AS size, doc_id % 17 AS added, doc_id % 5 AS removed, doc_id % 3 = 0 AS reviewed, doc_id % 9 + 1 AS weight,
            (['src/main/java/', 'src/test/java/', 'docs/', 'app/components/', 'config/'])[(doc_id % 5 + 1)::INT] || source || '/m' || (doc_id % 11) || '/Doc' || doc_id
            || CASE WHEN doc_id % 13 = 0 THEN 'Test' ELSE '' END || '.' || (['java', 'ts', 'html', 'md', 'yml', 'sql', 'spec.ts'])[(doc_id % 7 + 1)::INT] AS path
        FROM documents)""",
    "versions": """versions AS (SELECT lang AS review_id, doc_id, source, text, sha256(text) AS content_hash, doc_id % 2 AS head FROM documents)""",
    "containers": """containers AS (
        SELECT 's1' AS snapshot_id, 'c' || c_custkey AS symbol_id, 'n' || c_nationkey AS container_id FROM customer
        UNION ALL SELECT 's1', 'n' || n_nationkey, 'r' || n_regionkey FROM nation)""",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """A query over the named views."""
    ctes = ",\n".join(SQL[n] for n in names)
    lead = "WITH RECURSIVE " if recursive else "WITH "
    if body.lstrip().startswith(","):
        return f"{lead}{ctes}{body}"
    return f"{lead}{ctes}\n{body}"
