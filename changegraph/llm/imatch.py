"""I-Match fingerprints over several randomised lexicons, in DataFrame operations only.

Document frequencies are counted over all documents. The lexicon keeps the terms whose
inverse document frequency ln(N / df) lies in a band. As each document has finitely many
distinct terms, at most (mean distinct terms) * exp(idf_high) terms can be in the band,
however large the corpus; that bound is why the lexicon may travel as one array. A
document keeps its terms of the lexicon, distinct and sorted. Each randomised lexicon
keeps a share of the terms, chosen by a seeded hash, and the fingerprint lists the hashes
of what the document has of each.

Likeness of two fingerprints: of the lexicons that either document has terms of, the share
with equal hashes. A document without any term in the band is fingerprinted by its whole
text, so only the same text equals it.

Defined results: null text counts as empty. Neighbours are taken in descending order of
id (null ids last), ties by the text's hash; after the last comes the first. Rows with the
same id stay separate rows. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changegraph.llm.text import materialise, n_groups


SLOT = 6  # hex digits of a lexicon's hash


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, text_col: str = "text", idf_low: float = 2.3, idf_high: float = 3.9) -> list[str]:
    """The terms with idf_low <= ln(N / df) <= idf_high, sorted; see the bound above."""
    total = docs.count()
    df = docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = df.where((F.col("df") >= total * math.exp(-idf_high)) & (F.col("df") <= total * math.exp(-idf_low)))
    return sorted(r["term"] for r in band.select("term").collect())


def with_fingerprint(df: DataFrame, text_col: str, out: str, lex: list[str], families: int = 2, width: int = 24) -> DataFrame:
    """Adds ``families * width`` hashes, one a lexicon; dashes where the document has no term of it.

    In each family every term belongs to one of ``width`` lexicons."""
    known = F.from_json(F.lit(json.dumps(lex)), "array<string>")
    n = families * width
    df = df.withColumn("_kept", F.array_sort(F.array_intersect(terms(F.col(text_col)), known)))

    def places(family: int) -> Column:
        slot = lambda t: F.pmod(F.xxhash64(t, F.lit(family)), F.lit(width)) + family * width
        return F.transform("_kept", lambda t: F.struct(slot(t).cast("int").alias("p"), t.alias("t")))

    df = df.withColumn("_placed", F.concat(*[places(f) for f in range(families)]))

    def own_terms(i: Column) -> Column:
        return F.array_join(F.transform(F.filter("_placed", lambda x: x["p"] == i), lambda x: x["t"]), " ")

    def digest(t: Column) -> Column:
        return F.when(t == "", "-" * SLOT).otherwise(F.substring(F.lpad(F.lower(F.hex(F.xxhash64(t))), 16, "0"), 1, SLOT))

    whole = F.concat(F.lit("="), F.sha2(F.col(text_col).cast("binary"), 256))
    slots = F.array_join(F.transform(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), own_terms), digest), "")
    # _placed is used twice on purpose: a column used once would be computed anew for every lexicon.
    return df.withColumn(out, F.when(F.size("_placed") == 0, whole).otherwise(slots)).drop("_kept", "_placed")


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes among the lexicons that either fingerprint has terms of (0 to 1)."""
    x, y = F.col(a), F.col(b)
    at = F.sequence(F.lit(0), (F.length(x) / SLOT - 1).cast("int"))
    piece = lambda c, i: F.substring(c, i * SLOT + 1, F.lit(SLOT))
    used = F.filter(at, lambda i: (piece(x, i) != "-" * SLOT) | (piece(y, i) != "-" * SLOT))
    same = F.filter(used, lambda i: piece(x, i) == piece(y, i))
    whole = x.startswith("=") | y.startswith("=")
    return F.when(x == y, 1.0).when(whole, 0.0).otherwise(F.size(same) / F.size(used))


def _neighbours(small: DataFrame) -> DataFrame:
    """(k, id, nk, need, times): each key, the next key in descending order of id, and a third of its length.

    Sorted in ranges; only the first key of each range meets the others' firsts."""
    n = n_groups(small.sparkSession)
    order = [F.desc_nulls_last("id"), F.asc("h")]
    ranged = small.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    key = F.struct(F.col("id").isNotNull().alias("known"), F.col("id"), (-F.col("h")).alias("h"))
    firsts = ranged.groupBy("range").agg(F.max_by("k", key).alias("first"))
    ring = Window.orderBy("range")
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(ring), F.first("first").over(ring)).alias("after"))
    within = Window.partitionBy("range").orderBy(*order)
    step = ranged.withColumn("nk", F.lead("k").over(within)).join(firsts, "range")
    step = step.select("k", "id", F.coalesce("nk", "after").alias("nk"), F.floor(F.col("n_chars") / 3).cast("int").alias("need"), "times")
    again = step.where("times > 1").select("k", "id", F.col("k").alias("nk"), "need", (F.col("times") - 1).alias("times"))
    return step.withColumn("times", F.lit(1).cast("long")).unionByName(again)


def edited_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", idf_low: float = 2.3, idf_high: float = 3.9, families: int = 2, width: int = 24
) -> DataFrame:
    """Fingerprints of each text and of the text whose last third gives way to the next document's beginning.

    Returns (id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next)."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("h", F.xxhash64("text") / 2).withColumn("h", F.col("h").cast("long"))
    base = base.withColumn("k", F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("h").cast("string")))
    small = base.groupBy("k", "id", "h").agg(F.count("*").alias("times"), F.first(F.length("text")).alias("n_chars"))
    steps = materialise(_neighbours(small), "neighbours")
    lex = lexicon(docs, text_col, idf_low, idf_high)

    # Both joins read the same columns of the same exchange, so the texts are shuffled once.
    texts = base.select("k", "text")
    if steps.where("times > 1 OR k = nk").limit(1).count():
        texts = texts.dropDuplicates(["k"])
    texts = with_fingerprint(texts, "text", "fingerprint", lex, families, width).repartition(4 * n_groups(docs.sparkSession), "k")
    pieces = texts.select(F.col("k").alias("nk"), "text", F.col("fingerprint").alias("next_fingerprint")).join(steps, "nk")
    pieces = pieces.select(F.col("k").alias("of"), "id", "need", "times", F.substring(F.col("text"), F.lit(1), F.col("need")).alias("piece"), "next_fingerprint")
    both = texts.join(pieces, texts["k"] == pieces["of"])
    n = F.length("text")
    both = both.select(
        "id", n.cast("long").alias("n_chars"), "times", "fingerprint", "next_fingerprint",
        F.concat(F.substring(F.col("text"), F.lit(1), n - F.col("need")), F.col("piece")).alias("edited_text"),
    )
    both = with_fingerprint(both, "edited_text", "edited_fingerprint", lex, families, width)
    both = both.withColumn("near_edited", likeness("fingerprint", "edited_fingerprint")).withColumn("near_next", likeness("fingerprint", "next_fingerprint"))
    both = both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return both.select(F.col("id").alias(id_col), "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
