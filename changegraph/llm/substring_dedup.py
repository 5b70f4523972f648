"""Removing passages that an earlier document has, found through difference-cover anchors.

A passage is a window of ``window`` words. Hashing every window of a corpus and shuffling
all of them is needless: with a difference cover D modulo v, two equal windows at any
positions i and j have a shift d < v for which both (i + d) and (j + d) are, modulo v, in
D. So only the anchors (runs of ``window - v + 1`` words) at cover positions are hashed
and counted, 3 of 7 positions by default, with 4 bytes each. Where an anchor occurs in
two documents, the windows around it (the extension) are compared in full.

One exchange holds the texts, dealt by a hash of the document into groups; the three
passes over the texts reuse it:

1. anchors of a group, by bucket of the hash -> per bucket, which occur in two documents;
2. windows around those anchors, by bucket  -> per bucket, the smallest document of each;
3. marks of words and what is left of each document.

What a group sends holds each hash once, so that a passage in a third of all documents
costs a few bytes a group. Sizes per group and bucket follow spark.sql.shuffle.partitions.

Defined results: a null text has no words. A document without an id neither loses words
nor makes others lose theirs. Rows with the same id are the same document, so they do
not remove each other's words, but each loses the words that smaller ids have. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changegraph.llm.text import chunks, n_groups, release, window_hashes

#: Difference covers by period: every difference modulo the period is one of two members.
COVERS = {1: (0,), 2: (0, 1), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
NO_ID = np.iinfo(np.int64).max
_LOW = np.uint64(0xFFFFFFFF)


def _numbers(table: pa.Table) -> np.ndarray:
    return table["id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _anchors(chunk, ids: np.ndarray, window: int, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (first word in the chunk), hashes and documents' ids of the anchors."""
    width = window - period + 1
    h = window_hashes(chunk.word_hashes(), width)
    if not len(h):
        return np.zeros(0, np.int64), h, np.zeros(0, np.int64)
    doc = chunk.word_docs()[: len(h)]
    at = np.arange(len(h)) - chunk.word_bounds[doc]
    cover = np.zeros(period, dtype=bool)
    cover[list(COVERS[period])] = True
    long_enough = (np.diff(chunk.word_bounds) >= window) & (ids != NO_ID)
    p = np.flatnonzero(chunk.window_ok(width) & cover[at % period] & long_enough[doc])
    return p, h[p], ids[doc[p]]


def _smallest(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the smallest id of each and whether there is another."""
    if not len(h):
        return h, ids, np.zeros(0, dtype=bool)
    order = np.argsort(h, kind="stable")
    h, ids = h[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    low, high = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
    return h[first], low, low != high


def _by_bucket(h: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in h) of each bucket that has any."""
    if not len(h):
        return
    bucket = ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        yield int(bucket[part[0]]), part


_BLOBS = "bucket long, g long, keys binary, rest binary"
_BLOB_SCHEMA = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("keys", pa.binary()), ("rest", pa.binary())])


def _blobs(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_BLOB_SCHEMA.names, r, strict=True)) for r in rows], schema=_BLOB_SCHEMA)


def _joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of blobs, and how many each blob has."""
    blobs = [np.frombuffer(x, dtype=kind) for x in column.to_pylist()]
    return (np.concatenate(blobs) if blobs else np.zeros(0, kind)), np.array([len(x) for x in blobs], dtype=np.int64)


def _spread(starts: np.ndarray, before: int, n: int, width: int) -> np.ndarray:
    """Flags of positions in [s - before, s + width) of any start s."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, np.maximum(starts - before, 0), 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def _with(table: pa.Table, left: pa.Table, names: list[str]) -> pa.Table:
    for name in names:
        table = table.append_column(name, left[name])
    return table


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, period: int = 7,
    carry: tuple[str, ...] = (), keep_untouched: bool = False,
) -> DataFrame:
    """Each document without the words of windows that a smaller id has too.

    Returns (id, n_words, n_removed, kept_text) and the columns of ``carry``; ``kept_text`` is the
    kept words joined by one space or, with ``keep_untouched``, the text itself where no word goes. Windows are judged on the input. ``period`` must be a key of COVERS and at
    most ``window - 1``.
    """
    if period not in COVERS or period >= window:
        raise ValueError(f"period must be one of {sorted(COVERS)} and below the window")
    spark = docs.sparkSession
    n = n_groups(spark)
    groups, buckets = 2 * n, n
    width = window - period + 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    extra = [docs.schema[c].dataType.simpleString() for c in carry]
    rows = rows.withColumn("g", F.pmod(F.xxhash64("id", "text"), F.lit(groups))).repartition(groups, "g")

    def anchors(batches):
        held: dict[int, list] = {}
        for batch in batches:
            ids, g = _numbers(pa.table({"id": batch["id"]})), batch["g"].to_numpy()
            for c in chunks(batch["text"]):
                span = slice(c.first, c.first + c.n)
                p, h, own = _anchors(c, ids[span], window, period)
                of = g[span][np.searchsorted(c.word_bounds, p, side="right") - 1]
                for x in np.unique(of):
                    held.setdefault(int(x), []).append((h[of == x], own[of == x]))
        for x, parts in held.items():
            h, _, shared = _smallest(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]))
            out = [(b, x, (h[i] & _LOW).astype("<u4").tobytes(), np.packbits(shared[i]).tobytes()) for b, i in _by_bucket(h, buckets)]
            yield from _blobs(out).to_batches()
        held.clear()
        release()

    def shared_anchors(table):
        keys, sizes = _joined(table["keys"], "<u4")
        shared = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=k) for x, k in zip(table["rest"].to_pylist(), sizes, strict=True)]
        values, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        often = count > 1
        often[inverse[np.concatenate(shared).astype(bool)]] = True
        hit, ends, out = often[inverse], np.cumsum(sizes), []
        bucket = table["bucket"][0].as_py()
        for x, a, b in zip(table["g"].to_pylist(), ends - sizes, ends, strict=True):
            if hit[a:b].any():
                out.append((bucket, x, keys[a:b][hit[a:b]].tobytes(), b""))
        return _blobs(out)

    def extended(left, right):
        """Windows around the shared anchors of one group, by bucket."""
        if not left.num_rows or not right.num_rows:
            return _blobs([])
        keys, sizes = _joined(right["keys"], "<u4")
        hot = np.sort((np.repeat(np.array(right["bucket"].to_pylist(), dtype=np.uint64), sizes) << np.uint64(32)) | keys)
        ids, found = _numbers(left), []
        for c in chunks(left["text"]):
            p, h, _ = _anchors(c, ids[c.first : c.first + c.n], window, period)
            if not len(p):
                continue
            key = (((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (h & _LOW)
            at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            p = p[hot[at] == key]
            w = window_hashes(c.word_hashes(), window)
            use = np.flatnonzero(_spread(p, window - width, len(w), 1) & c.window_ok(window)) if len(p) else p
            found.append((w[use], ids[c.first + c.word_docs()[use]]))
        if not found:
            return _blobs([])
        h, low, _ = _smallest(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
        known = low != NO_ID
        h, low = h[known], low[known]
        g = left["g"][0].as_py()
        return _blobs([(b, g, h[i].astype("<u8").tobytes(), low[i].astype("<i8").tobytes()) for b, i in _by_bucket(h, buckets)])

    def earliest(table):
        """Per group, the windows that a smaller document of another group has."""
        keys, sizes = _joined(table["keys"], "<u8")
        ids, _ = _joined(table["rest"], "<i8")
        values, inverse = np.unique(keys, return_inverse=True)
        low = np.full(len(values), NO_ID)
        np.minimum.at(low, inverse, ids)
        low, ends, out = low[inverse], np.cumsum(sizes), []
        bucket = table["bucket"][0].as_py()
        for x, a, b in zip(table["g"].to_pylist(), ends - sizes, ends, strict=True):
            less = low[a:b] < ids[a:b]
            if less.any():
                out.append((bucket, x, keys[a:b][less].tobytes(), low[a:b][less].tobytes()))
        return _blobs(out)

    carried = [f"c{i}" for i in range(len(carry))]
    out_schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def cleaned(left, right):
        if not left.num_rows:
            return _with(out_schema.empty_table(), left, carried)
        ids = _numbers(left)
        keys, _ = _joined(right["keys"], "<u8")
        low, _ = _joined(right["rest"], "<i8")
        seen, own = [keys], [low]
        for c in chunks(left["text"]):
            w = window_hashes(c.word_hashes(), window)
            ok = np.flatnonzero(c.window_ok(window))
            of = ids[c.first + c.word_docs()[ok]]
            seen.append(w[ok][of != NO_ID])
            own.append(of[of != NO_ID])
        seen, own, _ = _smallest(np.concatenate(seen), np.concatenate(own))
        n_words, n_removed, kept = [], [], []
        for c in chunks(left["text"]):
            w = window_hashes(c.word_hashes(), window)
            ok = np.flatnonzero(c.window_ok(window))
            of = ids[c.first + c.word_docs()[ok]]
            ok, of = ok[of != NO_ID], of[of != NO_ID]
            again = ok[own[np.searchsorted(seen, w[ok])] < of] if len(ok) else ok
            gone = _spread(again, 0, len(c.starts), window)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[c.word_bounds[1:]] - total[c.word_bounds[:-1]]
            n_words += np.diff(c.word_bounds).tolist()
            n_removed += removed.tolist()
            for i in range(c.n):
                if keep_untouched and not removed[i]:
                    kept.append(c.text_bytes(i))
                    continue
                parts = c.text_bytes(i).split()
                if removed[i]:
                    parts = [x for x, y in zip(parts, gone[c.word_bounds[i] : c.word_bounds[i + 1]].tolist(), strict=True) if not y]
                kept.append(b" ".join(parts))
        text = pa.array(kept, type=pa.binary()).cast(pa.string())
        release()
        return _with(pa.table([left["id"].combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), text], schema=out_schema), left, carried)

    repeated = rows.mapInArrow(anchors, _BLOBS).groupBy("bucket").applyInArrow(shared_anchors, _BLOBS)
    around = rows.groupBy("g").cogroup(repeated.groupBy("g")).applyInArrow(extended, _BLOBS)
    known = around.groupBy("bucket").applyInArrow(earliest, _BLOBS)
    out = rows.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(cleaned, ", ".join(["id long, n_words long, n_removed long, kept_text string", *[f"c{i} {t}" for i, t in enumerate(extra)]]))
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_text", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of a result of remove_repeats."""
    return result.select(id_col, "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
