"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source is an endless stream of its documents in a seeded random order, at most three
times over. Its target number of words is a prefix of that stream, cut into blocks of
``block_words`` words. How many blocks of each source each output shard gets is drawn by a
tree over the shards: at each node the quotas of all sources are split between the left and
the right half by a multivariate hypergeometric draw with the node's own seed, so every
leaf can walk down from the root alone, and all quotas add up exactly. On its way a leaf
also learns where its blocks begin in a seeded permutation of each source's blocks, which
makes the draws of all shards disjoint. Within a shard documents follow a seeded hash.

Places in a source's stream are prefix sums in two steps, by ranges of the hash and within
a range, so that no source is gathered in one task. Only a row a source reaches the driver.

Defined results: a null text has size 0; documents of size 0 are never taken. A null source
is a source of its own, the last. Rows with the same id are separate documents. The last
document of a stream's prefix is taken in part, its first words only. An empty table, or
one without words, gives no placements. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changegraph.llm.text import materialise, mix64, n_groups, n_words
from changegraph.llm.text import words as split_words

WEIGHTS = (5.0, 2.0, 1.0)
MOST_SOURCES = 1_000_000
#: Draws are exact below 10**9 blocks in all; a mix that would have more than this gets longer blocks.
MOST_BLOCKS = 500_000_000


def targets(sizes: list[int], weights: list[float], repeats: int = 3) -> list[float]:
    """Shares of sum(sizes) by weight; what is above ``repeats`` times a size goes to the others by weight."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in free)
        over = {i for i in free if rest * weights[i] / weight > repeats * sizes[i]}
        if not over:
            for i in free:
                out[i] = rest * weights[i] / weight
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
        free -= over
    return out


def permuted(position: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A seeded permutation of 0..n-1, by a four-round Feistel network walked until it is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, x = np.uint64((1 << half) - 1), position.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            key = np.uint64(((seed * 4 + r) * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (mix64(right + key) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo &= x >= np.uint64(n)
    return x.astype(np.int64)


def shard_quotas(shard: int, n_shards: int, quotas: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of each source for one shard, blocks of each source in the shards before it)."""
    low, high, begin = 0, n_shards, np.zeros_like(quotas)
    total = int(quotas.sum())
    upto = lambda i: i * total // n_shards
    while high - low > 1:
        middle = (low + high) // 2
        draw = np.random.default_rng([seed, low, high])
        left = draw.multivariate_hypergeometric(quotas, upto(middle) - upto(low), method="marginals")
        if shard < middle:
            high, quotas = middle, left
        else:
            low, begin, quotas = middle, begin + left, quotas - left
    return quotas, begin


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, repeats: int = 3, block_words: int = 5_000, shard_blocks: int = 256, seed: int = 17,
) -> DataFrame:
    """A row for each copy of a document in the mix and one (copy null) for each document outside.

    (id, h, source, size, start, source_size, target, copy, taken, shard, place): h identifies the
    text, ``place`` orders a shard's documents. Weights go to sources in code point order and
    repeat."""
    spark = docs.sparkSession
    n = n_groups(spark)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
    )
    ranges = 4 * n
    rows = materialise(rows.withColumn("range", F.pmod(F.shiftrightunsigned("h", 33), F.lit(ranges)).cast("int")), "sizes")

    by_source = rows.groupBy("source").agg(F.sum("size").alias("s"))
    if by_source.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sources = sorted(((r["source"], int(r["s"])) for r in by_source.collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [s for _, s in sources]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], repeats)
    words = [min(round(g), repeats * s) for g, s in zip(goal, sizes, strict=True)]
    block_words = max(block_words, -(-sum(words) // MOST_BLOCKS))
    table = [(name, i, s, g, w) for i, ((name, s), g, w) in enumerate(zip(sources, goal, words, strict=True))]
    facts = spark.createDataFrame(table, "source string, source_no int, source_size long, target double, words long")

    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "range").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    at = at.join(bases.withColumnRenamed("range", "r").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    at = at.withColumn("start", F.col("start") + F.col("base")).drop("base", "s", "r")
    at = at.join(facts, same(at, facts)).drop(facts["source"])
    times = F.ceil((F.col("words") - F.col("start")) / F.col("source_size")).cast("int")
    copies = F.when((F.col("size") > 0) & (F.col("start") < F.col("words")), F.sequence(F.lit(0), times - 1))
    at = at.withColumn("copy", F.explode_outer(copies))
    first = F.col("copy") * F.col("source_size") + F.col("start")
    at = at.withColumn("taken", F.when(F.col("copy").isNotNull(), F.least("size", F.col("words") - first))).withColumn("block", F.floor(first / block_words))

    quotas = np.array([-(-w // block_words) for w in words], dtype=np.int64)
    n_shards = max(1, -(-int(quotas.sum()) // shard_blocks))

    def leaves(batches):
        for batch in batches:
            for shard in batch["id"].to_pylist():
                counts, begin = shard_quotas(shard, n_shards, quotas, seed)
                for s in np.flatnonzero(counts):
                    block = permuted(np.arange(begin[s], begin[s] + counts[s]), int(quotas[s]), seed * 1_000_003 + int(s))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(block), s), pa.int32()), pa.array(block, pa.int64()), pa.array(np.full(len(block), shard), pa.int64())],
                        names=["no", "b", "shard"],
                    )

    blocks = spark.range(n_shards, numPartitions=min(n, n_shards)).mapInArrow(leaves, "no int, b long, shard long")
    out = at.join(blocks, (at["source_no"] == blocks["no"]) & (at["block"] == blocks["b"]), "left")
    return out.select(
        F.col("id").alias(id_col), "h", F.col("source").alias(source_col), "size", "start", "source_size", "target", "copy", "taken", "shard",
        F.xxhash64(F.lit(seed), "shard", "h", "copy").alias("place"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """The documents of the mix, a row a copy, with ``mix_shard`` and ``mix_place``; the last one of a source may be its first words only, joined by spaces."""
    placed = mix(docs, id_col, text_col, source_col, seed=seed, **options).where("taken > 0")
    # Rows that agree in id, text and source are one here, with the copies of all of them.
    facts = {"_id": id_col, "_h": "h", "_size": "size", "_taken": "taken", "mix_shard": "shard", "mix_place": "place", "_source": source_col}
    placed = placed.select(*[F.col(c).alias(name) for name, c in facts.items()])
    docs = docs.withColumn("_h2", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))).dropDuplicates([id_col, "_h2", source_col])
    on = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_h2") == F.col("_h")) & F.col(source_col).eqNullSafe(F.col("_source"))
    head = F.array_join(F.slice(split_words(text_col), F.lit(1), F.col("_taken").cast("int")), " ")
    cut = F.when(F.col("_taken") < F.col("_size"), head).otherwise(F.col(text_col))
    return docs.join(placed, on).withColumn(text_col, cut).drop("_id", "_h", "_h2", "_source", "_size", "_taken")
