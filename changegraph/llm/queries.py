"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changegraph.llm.substring_dedup import digest, remove_repeats

    return digest(remove_repeats(table(spark, sf_dir, "documents"), window=13, period=7))


SQL["op10_substring_dedup"] = r"""
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
    SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
again AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first_doc FROM win) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM again),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query
def op7_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changegraph.llm.hyperminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


SQL["op7_hyperminhash_dedup"] = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g
        FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
low AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low.component, d.doc_id) AS component_id,
       coalesce(low.component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""


@query
def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from changegraph.llm.imatch import edited_fingerprints

    out = edited_fingerprints(table(spark, sf_dir, "documents"))
    sha = F.sha2(F.col("edited_text").cast("binary"), 256)
    return out.select("doc_id", "n_chars", sha.alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from changegraph.llm.text import shared_dir
    from changegraph.llm.token_files import read_token_files, write_token_files

    folder = shared_dir(spark) + "/tokens"
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_file(), end_id=0)
    out = read_token_files(spark, folder, manifest)
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changegraph.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2, capacity=1024, remembered=1_000_000)


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from changegraph.llm.mixing import mix

    placed = mix(table(spark, sf_dir, "documents"))
    # Documents of size 0 stay a row each; the others are told apart by their place in the stream.
    no = F.array().cast("array<struct<shard:bigint,place:bigint,taken:bigint>>").alias("places")
    none = placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), no)
    some = placed.where("size > 0").groupBy("doc_id", "h", "source", "size", "source_size", "target", "start")
    # Each copy with the shard that the tree dealt its block to, and its place there.
    copy = F.when(F.col("shard").isNotNull(), F.struct("shard", "place", F.col("taken").cast("long").alias("taken")))
    dealt = some.agg(F.sort_array(F.collect_list(copy)).alias("places"))
    total = F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + p["taken"])
    return none.unionByName(dealt.select("doc_id", "size", "source_size", "target", total.alias("taken"), "places"))



@query
def op3_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from changegraph.llm.text import in_remainder
    from changegraph.llm.toxicity import score_toxicity

    labels = table(spark, sf_dir, "labels").where(~in_remainder("doc_id", 5, 0))
    out = score_toxicity(table(spark, sf_dir, "documents"), labels)
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return out.select("doc_id", in_remainder("doc_id", 5, 0).alias("held_out"), "score", predicted.alias("predicted"), F.size("evidence").alias("n_neighbours"))


@query
def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from changegraph.llm.quality_gam import score_quality
    from changegraph.llm.text import in_remainder

    labels = table(spark, sf_dir, "labels").where(~in_remainder("doc_id", 3, 1))
    out = score_quality(table(spark, sf_dir, "documents"), labels)
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return out.select("doc_id", in_remainder("doc_id", 3, 1).alias("held_out"), "score", predicted.alias("predicted"))


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changegraph.llm.quality_rules import judge_quality

    return judge_quality(table(spark, sf_dir, "documents"))


@query
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from changegraph.llm.url_rules import judge_urls

    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    out = judge_urls(table(spark, sf_dir, "pages"), labels, rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


@query
def op13_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from changegraph.llm.radix_dedup import remove_repeated_bytes

    out = remove_repeated_bytes(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op13_radix_dedup"] = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, octet_length(b) AS n, hex(b) AS x FROM d),
-- 512 positions share a piece, so that a window is cut out of a short string
piece AS (SELECT doc_id, p, substring(x, 1024 * p + 1, 1024 + 98) AS y FROM (SELECT doc_id, x, unnest(range((n + 511) // 512)) AS p FROM h)),
win AS (SELECT doc_id, 512 * p + i AS s, y[2 * i + 1:2 * i + 100] AS g FROM (SELECT doc_id, p, y, unnest(range(least(512, len(y) // 2 - 49))) AS i FROM piece)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS first_doc FROM win) WHERE first_doc < doc_id),
mark AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh FROM again),
span AS (
    SELECT doc_id, min(s) AS a, max(s) + 50 AS z
    FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM mark) GROUP BY doc_id, k),
gap AS (
    SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM span
    UNION ALL SELECT doc_id, 0, min(a) FROM span GROUP BY doc_id
    UNION ALL SELECT doc_id, 0, NULL FROM d WHERE doc_id NOT IN (SELECT doc_id FROM span)),
kept AS (
    SELECT g.doc_id, string_agg(substring(h.x, (2 * g.a + 1)::BIGINT, (2 * (coalesce(g.z, h.n) - g.a))::BIGINT), '' ORDER BY g.a) AS x
    FROM gap g JOIN h ON h.doc_id = g.doc_id GROUP BY g.doc_id),
gone AS (SELECT doc_id, sum(z - a) AS n, count(*) AS k FROM span GROUP BY doc_id)
SELECT h.doc_id, h.n::BIGINT AS n_bytes, coalesce(gone.n, 0)::BIGINT AS n_removed, coalesce(gone.k, 0)::BIGINT AS n_spans,
       sha256(unhex(kept.x)) AS kept_sha256
FROM h LEFT JOIN gone ON gone.doc_id = h.doc_id LEFT JOIN kept ON kept.doc_id = h.doc_id
"""


@query
def op11_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changegraph.llm.ball_tree import best_documents

    return best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


SQL["op11_ball_tree_search"] = r"""
WITH terms AS (
    SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
t AS (
    SELECT side, id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM terms),
tf AS (SELECT id AS doc_id, term, count(*) AS tf FROM t WHERE side = 0 GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
m AS (SELECT doc_id, 10 + (90 * n * docs) // len AS m FROM n, total),
part AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS y FROM tf JOIN w USING (term) JOIN m USING (doc_id)),
score AS (
    SELECT id AS item_id, doc_id, sum(y)::BIGINT AS score
    FROM (SELECT DISTINCT id, term FROM t WHERE side = 1) JOIN part USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changegraph.llm.conversation_repair import damaged_and_repaired

    return damaged_and_repaired(table(spark, sf_dir, "conversations"))
