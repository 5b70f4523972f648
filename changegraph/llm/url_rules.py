"""URL filters: fixed host and path rules, then association rules mined by FP-growth.

A URL becomes a set of tokens (scheme, top-level and registered domain, subdomain, path
all segments by place with numbers masked, file ending, query keys, fragment). FP-growth over
the blocked URLs finds token sets that at least ``min_count`` of them have, however many
labels there are; their confidence and lift for the class ``block`` are counted over all
labelled URLs, and rules are dropped where a shorter rule is at least as sure. An
inverted index from each rule's rarest token to the rule finds the rules whose tokens a URL
all has; a URL is blocked if any does.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is allowed. Equal URLs are judged once and share the verdict. A page labelled twice
counts once, as blocked if any label says so. Without blocked labels there are no mined
rules. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegraph.llm.text import materialise, n_groups

BLOCK = "class=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fixed_rule(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of (verdict, host, path) that fits the host or a parent and the path's beginning."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens; an empty array for a null URL."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    segments = F.filter(F.split(p, "/"), lambda x: x != "")
    masked = F.transform(segments, lambda x, i: F.concat(F.lit("path"), i, F.lit("="), F.regexp_replace(x, r"\d+", "#")))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("query="), x))
    one = lambda name, value: F.when(value != "", F.concat(F.lit(name + "="), value))
    single = F.array(
        one("scheme", F.lower(F.regexp_extract(url, r"^(\w+)://", 1))),
        one("tld", F.element_at(labels, -1)),
        one("domain", domain),
        F.when(F.size(labels) > 2, one("sub", labels[0])),
        F.when(F.size(labels) > 3, one("site", F.element_at(labels, -3))),
        one("ending", F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1)),
        F.when(p.endswith("/"), F.lit("slash")),
        F.when(url.contains("#"), F.lit("fragment")),
    )
    out = F.array_sort(F.array_distinct(F.array_compact(F.concat(single, masked, keys))))
    return F.coalesce(out, F.array().cast("array<string>"))


def _holding(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(rule, others): how many of the rows (tokens, k times) have all tokens of each set (rule, tokens, key)."""
    hits = rows.select("k", F.col("tokens").alias("own"), F.explode("tokens").alias("key")).join(sets, "key")
    return hits.where(F.size(F.array_except("tokens", "own")) == 0).groupBy("rule").agg(F.sum("k").alias("others"))


def mine_rules(labelled: DataFrame, min_count: int = 10, min_confidence: float = 0.6, min_lift: float = 1.5) -> DataFrame:
    """Rules from (tokens, blocked): (tokens, key, confidence, support), ``key`` being the rarest token."""
    total = labelled.agg(F.count("*").alias("n"), F.count_if("blocked").alias("b")).first()
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "tokens array<string>, key string, confidence double, support double")
    if total["b"] < max(min_count, 1):
        return empty
    # Half a row less, as the threshold is a share that is rounded up to rows again.
    bad = labelled.where("blocked").select(F.col("tokens").alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(min_count - 0.5, 0.5) / total["b"], minConfidence=1.0, numPartitions=n_groups(spark)).fit(bad)
    often = materialise(labelled.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("freq")), "tokens")
    sets = model.freqItemsets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("blocked"))
    sets = materialise(sets.withColumn("rule", F.array_join("tokens", "\u0001")), "sets")
    key = sets.select("rule", F.explode("tokens").alias("t")).join(often, "t").groupBy("rule").agg(F.min_by("t", F.struct("freq", "t")).alias("key"))
    sets = materialise(sets.join(key, "rule"), "keyed_sets")
    rows = labelled.where(~F.col("blocked")).groupBy("tokens").agg(F.count("*").alias("k"))
    others = _holding(rows, sets.select("rule", "tokens", "key"))
    confidence = F.col("blocked") / (F.col("blocked") + F.coalesce("others", F.lit(0)))
    found = sets.join(others, "rule", "left").withColumn("confidence", confidence).withColumn("support", F.col("blocked") / total["n"])
    found = found.where((F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * total["b"] / total["n"]))
    found = materialise(found.select("rule", "tokens", "key", "confidence", "support"), "rules")
    # A rule goes if a proper part of its tokens is a rule that is at least as sure.
    parts = found.select("rule", F.size("tokens").alias("n"), "confidence", F.explode("tokens").alias("t"))
    short = parts.select(F.col("rule").alias("s"), F.col("n").alias("sn"), F.col("confidence").alias("sc"), "t")
    needless = (
        parts.join(short, "t").where("sn < n AND sc >= confidence").groupBy("rule", "s", "sn").count().where("count = sn").select("rule").distinct()
    )
    kept = found.join(needless, "rule", "left_anti")
    return materialise(kept.select("tokens", "key", "confidence", "support"), "kept_rules")


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", **mining
) -> DataFrame:
    """(id, host, path, rule, verdict, mined_tokens, confidence) of each page; ``labels``: (id, blocked)."""
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    marks = labels.where("blocked IS NOT NULL").groupBy(F.col("id").alias("label_id")).agg(F.max("blocked").alias("blocked"))
    marked = rows.join(marks, F.col("id") == F.col("label_id")).select(url_tokens(url).alias("tokens"), "blocked")
    mined = mine_rules(materialise(marked, "labelled"), **mining)

    urls = rows.where("url IS NOT NULL").select("url").distinct().withColumn("own", url_tokens(url))
    index = mined.select(F.col("key"), F.col("tokens"), "confidence", "support")
    hits = urls.select("url", "own", F.explode("own").alias("key")).join(index, "key")
    hits = hits.where(F.size(F.array_except("tokens", "own")) == 0)
    best = hits.groupBy("url").agg(F.max_by(F.struct("tokens", "confidence"), F.struct("confidence", "support", "tokens")).alias("best"))
    best = best.select(F.col("url").alias("hit_url"), "best")
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    out = rows.withColumn("host", host(url)).withColumn("path", path(url)).join(best, url == F.col("hit_url"), "left")
    return out.select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("best").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.col("best.tokens").alias("mined_tokens"), F.col("best.confidence").alias("confidence"),
    )
