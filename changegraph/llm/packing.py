"""Packing token sequences: length patterns fitted by non-negative least squares.

The histogram of piece lengths (at most ``capacity`` rows) is all that the fit needs. Patterns
are the multisets of one to three lengths that fill a sequence exactly; their repeat counts
x >= 0 minimise the weighted squares of A x - histogram by multiplicative updates, are
rounded down and cut to what is there. The residual is packed best fit, longest first, on
counts of lengths. All of this yields a table of slots of a bounded size: (length, first
rank, number, first sequence, offset). A document's rank among the pieces of its length
then gives its slot by arithmetic, in parallel; ranks come from counts by (length,
bucket), so that no length is gathered in one task.

Defined results: a null text counts as empty and has only the end id. A text of more than
``capacity`` ids is cut into pieces of ``capacity``, the first piece taking what is over.
Rows with the same id are packed as separate documents. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changegraph.llm.text import materialise, n_groups
from changegraph.llm.tokens import REMEMBERED, encoder


def pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids with the end id, in pieces of at most ``capacity``.

    A worker remembers the ids of up to ``remembered`` words, some 200 bytes each."""

    def cut(batches):
        enc = encoder(tokenizer_path, remembered)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                ids = enc.encode(text.as_py()) + end
                first = (len(ids) // 4 - 1) % capacity + 1
                bounds = [0, *range(first, len(ids) // 4 + 1, capacity)]
                rows += [(doc, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long")


def exact_patterns(lengths: np.ndarray, capacity: int, most: int = 200_000) -> np.ndarray:
    """Rows of up to three lengths (0: none), ascending, whose sum is the capacity.

    The shortest of three runs over the given lengths, or over every k-th of them where there
    would be more than ``most`` triples."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    have[0] = False
    one = np.array([[0, 0, capacity]]) if have[capacity] else np.zeros((0, 3), dtype=np.int64)
    a = np.arange(1, capacity // 2 + 1)
    a = a[have[a] & have[capacity - a]]
    two = np.stack([np.zeros_like(a), a, capacity - a], axis=1)
    shortest = np.flatnonzero(have[: capacity // 3 + 1])
    shortest = shortest[:: max(1, -(-capacity * len(shortest) // (4 * most)))]
    three = [np.zeros((0, 3), dtype=np.int64)]
    for s in shortest:
        b = np.arange(s, (capacity - s) // 2 + 1)
        b = b[have[b] & have[capacity - s - b]]
        three.append(np.stack([np.full_like(b, s), b, capacity - s - b], axis=1))
    return np.concatenate([one, two, *three]).astype(np.int64)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeat counts of patterns, errors weighted by length."""
    n = len(histogram)
    h = histogram.astype(np.float64)
    h[0] = 0.0
    weight = np.arange(n, dtype=np.float64)
    at = lambda v: v[patterns].sum(axis=1)
    x = np.ones(len(patterns))
    top = at(weight * h)
    for _ in range(rounds):
        ax = np.bincount(patterns.ravel(), weights=np.repeat(x, 3), minlength=n)
        ax[0] = 0.0
        x *= top / np.maximum(at(weight * ax), 1e-12)
    return x


def _residual(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: (pattern, number of sequences)."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def put(space: int, pattern: tuple[int, ...], n: int) -> None:
        open_[space][pattern] = open_[space].get(pattern, 0) + n

    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            space = min((s for s in open_ if s >= length and open_[s]), default=None)
            if space is None:
                each = capacity // length
                full, more = divmod(count, each)
                if full:
                    put(capacity - each * length, (length,) * each, full)
                if more:
                    put(capacity - more * length, (length,) * more, 1)
                count = 0
                continue
            pattern, n = open_[space].popitem()
            used = min(n, count)
            if n > used:
                open_[space][pattern] = n - used
            put(space - length, (*pattern, length), used)
            count -= used
    return [(p, n) for group in open_.values() for p, n in group.items()]


def plan(histogram: np.ndarray, capacity: int) -> np.ndarray:
    """Slots by length: columns length, first rank, number, first sequence, offset, sorted."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    groups: list[tuple[tuple[int, ...], int]] = []
    patterns = exact_patterns(np.flatnonzero(left), capacity)
    if len(patterns):
        x = np.floor(fit_repeats(patterns, left) + 1e-6).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 1:
                break
            p = [int(v) for v in patterns[i] if v]
            n = min(int(x[i]), *(int(left[v]) // p.count(v) for v in p))
            if n > 0:
                groups.append((tuple(p), n))
                for v in p:
                    left[v] -= n
    groups += _residual(left, capacity)
    rank: dict[int, int] = defaultdict(int)
    slots, sequence = [], 0
    for pattern, n in groups:
        offset = 0
        for v in pattern:
            slots.append((v, rank[v], n, sequence, offset))
            rank[v] += n
            offset += v
        sequence += n
    return np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)


def pack(pieces_: DataFrame, capacity: int = 1024, length_col: str = "length", order_by: tuple[str, ...] = ("id", "piece", "start", "ids_crc32")) -> DataFrame:
    """Adds sequence_id and offset to each piece; no sequence holds more than ``capacity``.

    ``pieces_`` is read several times and should be a stored table."""
    spark = pieces_.sparkSession
    counts = pieces_.groupBy(length_col).count().collect()  # at most one row for each length up to the capacity
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts:
        histogram[length] = n
    slots = spark.sparkContext.broadcast(plan(histogram, capacity))

    buckets = 4 * n_groups(spark)
    rows = pieces_.withColumn("_bucket", F.pmod(F.xxhash64(*order_by), F.lit(buckets)).cast("int"))
    # Counts by bucket are stored, so that ranks agree with them whatever is computed anew.
    sizes = rows.groupBy(length_col, "_bucket").count()
    before = Window.partitionBy(length_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(length_col, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(length_col, "_bucket").orderBy(*order_by)
    ranked = rows.withColumn("_rank", F.row_number().over(within) - 1).join(bases, [length_col, "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_base", "_bucket")
    names = ranked.columns
    kept = [c for c in pieces_.columns]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_.schema)

    def place(batches):
        s = slots.value
        for batch in batches:
            length, rank = batch[names.index(length_col)].to_numpy(), batch["_rank"].to_numpy()
            key = s[:, 0].astype(np.float64) * 2.0**40 + s[:, 1]
            at = np.searchsorted(key, length * 2.0**40 + rank, side="right") - 1
            row = s[at] if len(s) else np.zeros((0, 5), dtype=np.int64)
            cols = [batch[names.index(c)] for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(row[:, 3] + rank - row[:, 1], pa.int64()), pa.array(row[:, 4], pa.int64())], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    cut = materialise(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, remembered), "pieces")
    return pack(cut, capacity).withColumnRenamed("id", id_col)
