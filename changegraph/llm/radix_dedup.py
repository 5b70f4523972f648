"""Removing bytes that an earlier document has, by a depth-limited radix sort of suffixes.

Two documents repeat a passage where two of their suffixes agree on the first ``window``
bytes, so suffixes are ordered through that depth only. The sort goes from the most
significant digit down, and a suffix whose group has only one document drops out at once:

1. The first digit deals suffixes out over the cluster. It is the *signature*: the least
   hash of the runs of ``window // 2`` bytes within the suffix's first ``window`` bytes. Equal
   suffixes have equal signatures, neighbours mostly share theirs, and signatures of prose
   are rarely shared by chance. Each group of documents sends its distinct signatures;
   those that no other document has end here.
2. Suffixes with a shared signature travel: neighbours with one signature as one text (a
   run), each distinct text once a group of documents with its smallest id. Signatures that
   many documents have would meet in one task, so their suffixes travel one by one and are
   dealt by all of their ``window`` bytes.
3. Within a bucket the suffixes are ordered by the next eight bytes, groups of a single
   document drop out, and so on through ``window`` bytes. What is equal then is repeated:
   bytes are compared, no hash decides.
4. Each group of documents is told which suffixes of its texts a smaller id has as well.

One exchange of the texts serves the three passes over them. Groups hold some six megabytes of
text, whatever the session's settings, and long documents are hashed in slices, so a task's
memory does not grow with the table. What a group sends about a passage does not depend on how many
of its documents have it.

Defined results: a null text is empty. A document without an id neither loses bytes nor makes
others lose theirs. Rows with the same id are the same document, so they do not remove each
other's bytes, but each loses what smaller ids have. An empty table gives an empty
result. Extra columns are ignored. What is left of a text may be invalid UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changegraph.llm.text import mix64, release

NO_ID = np.iinfo(np.int64).max
#: Text of a group of documents, in bytes; there are a few groups more, so that a small table is worked on by several tasks.
GROUP_BYTES = 6 << 20
MORE_GROUPS = 8
#: Texts are hashed in slices of about so many bytes.
SLICE_BYTES = 1 << 18
#: Signatures with at least so many occurrences (or 255 in one group) have their suffixes dealt one by one.
HEAVY = 1 << 14
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)

_SIGNATURES = "bucket long, g long, keys binary, counts binary"
_RUNS = "bucket long, g long, sizes binary, ids binary, numbers binary, bytes binary"
_HITS = "bucket long, g long, numbers binary, starts binary, stops binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if i < 2 else pa.binary() for i in range(len(names))]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _joined(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binary values, and how many each value has."""
    parts = [np.frombuffer(x, dtype=kind) for x in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(x) for x in parts], dtype=np.int64)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin .. begin + size of all ranges, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def run_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` bytes, by its first position; lengths double, so it takes log2(width) steps."""

    def joined(a, size_a, b, size_b):
        n = len(data) - size_a - size_b + 1
        return a[:n] * np.uint64(pow(_BASE, size_b, 1 << 64)) + b[size_a : size_a + n]

    if len(data) < width:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        power, size, out, done, left = data.astype(np.uint64) + np.uint64(1), 1, None, 0, width
        while left:
            if left & 1:
                out = power if out is None else joined(out, done, power, size)
                done += size
            left >>= 1
            if left:
                power, size = joined(power, size, power, size), 2 * size
        return mix64(out)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    n, size = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[:n], values[width - size : width - size + n]) if size < width else values


def signatures(data: np.ndarray, window: int) -> np.ndarray:
    """The least hash of the shorter runs within every window, spread over 64 bits."""
    k = max(1, window // 2)
    return mix64(sliding_minimum(run_hashes(data, k), window - k + 1))


class Texts:
    """The documents of a table (id, text): bytes, bounds, ids."""

    def __init__(self, ids, text):
        text = pa.chunked_array(text.chunks if isinstance(text, pa.ChunkedArray) else [text], type=pa.binary())
        text = pa.concat_arrays([c.cast(pa.large_binary()) for c in text.chunks]) if text.num_chunks else pa.array([], pa.large_binary())
        bounds = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        raw = text.buffers()[2] if len(text) else None
        self.data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.bounds = bounds - bounds[0]
        self.ids = pa.chunked_array(ids.chunks if isinstance(ids, pa.ChunkedArray) else [ids], type=pa.int64()).fill_null(NO_ID).to_numpy().astype(np.int64)

    def runs(self, window: int) -> Iterator[tuple[np.ndarray, ...]]:
        """By slices: (document, first byte, number of suffixes, signature) of the runs of neighbouring suffixes with one signature."""
        i, n = 0, len(self.ids)
        while i < n:
            j = min(max(i + 1, int(np.searchsorted(self.bounds, self.bounds[i] + SLICE_BYTES, side="right")) - 1), n)
            for a in range(self.bounds[i], max(self.bounds[j] - window + 1, self.bounds[i]), 4 * SLICE_BYTES):
                b = min(self.bounds[j], a + 4 * SLICE_BYTES + window - 1)
                sig = signatures(self.data[a:b], window)
                if not len(sig):
                    continue
                cut = np.clip(self.bounds[i : j + 1] - a, 0, b - a)
                inside = np.zeros(len(sig) + 1, dtype=np.int32)  # suffixes that have a whole window in their document
                last = np.maximum(cut[1:] - window + 1, cut[:-1])
                known = self.ids[i:j] != NO_ID
                np.add.at(inside, np.minimum(cut[:-1], len(sig))[known], 1)
                np.add.at(inside, np.minimum(last, len(sig))[known], -1)
                ok = np.cumsum(inside[:-1]) > 0
                fresh = np.ones(len(sig), dtype=bool)
                fresh[1:] = (sig[1:] != sig[:-1]) | ~ok[:-1]
                fresh[cut[:-1][cut[:-1] < len(sig)]] = True
                edge = np.flatnonzero((fresh & ok) | (~ok & np.concatenate([[False], ok[:-1]])))
                size = np.diff(np.append(edge, len(sig)))
                use = ok[edge]
                start, size = edge[use], size[use]
                yield i + np.searchsorted(cut, start, side="right") - 1, start + a, size, sig[start]
            i = j


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if len(bucket):
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            yield int(bucket[part[0]]), part


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def repeated_suffixes(data: np.ndarray, start: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Flags of the suffixes (first bytes ``start``, each at least ``window`` long) that a smaller id has too, by radix passes of eight bytes."""
    word = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)  # eight bytes from each position, the first one leading
    for size in (1, 2, 4):
        word = (word[:-size] << np.uint64(8 * size)) | word[size:]
    flags = np.zeros(len(start), dtype=bool)
    left = np.arange(len(start))  # suffixes in order, groups side by side
    fresh = np.zeros(len(start), dtype=bool)
    fresh[:1] = True
    for depth in range(0, window, 8):
        digit = word[start[left] + depth]
        if window - depth < 8:
            digit >>= np.uint64(8 * (8 - window + depth))
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(left)))
        # Groups that agree in this digit are in order already; the others are sorted, each within its own places.
        mixed = np.flatnonzero(np.repeat(np.logical_or.reduceat(digit != np.repeat(digit[first], size), first), size)) if len(first) else first
        if len(mixed):
            group = np.repeat(np.arange(len(first)), size)[mixed]
            order = mixed[np.lexsort((digit[mixed], group)) if depth else np.argsort(digit[mixed])]
            left[mixed], digit[mixed] = left[order], digit[order]
            fresh[1:] |= digit[1:] != digit[:-1]
            first = np.flatnonzero(fresh)
            size = np.diff(np.append(first, len(left)))
        if not len(left):
            return flags
        own = ids[left]
        keep = np.repeat(np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first), size)
        left, fresh = left[keep], fresh[keep]
    if len(left):
        first, own = np.flatnonzero(fresh), ids[left]
        low = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(left))))
        flags[left] = low < own
    return flags


class _Shared:
    """The signatures of a group that other documents have."""

    def __init__(self, table: pa.Table, buckets: int):
        keys, size = _joined(table["keys"], "<u4")
        heavy, _ = _joined(table["counts"], "u1")
        key = (np.repeat(np.array(table["bucket"].to_pylist(), dtype=np.uint64), size) << np.uint64(32)) | keys
        order = np.argsort(key)
        self.key, self.heavy, self.buckets = key[order], heavy[order].astype(bool), buckets

    def find(self, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are shared, which of those are heavy)."""
        key = (_bucket(sig, self.buckets).astype(np.uint64) << np.uint64(32)) | (sig & _LOW)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = np.flatnonzero(self.key[at] == key)
        return hit, self.heavy[at[hit]]


class _Runs:
    """The texts of a group's runs with shared signatures: each distinct one with a number, its smallest id and its bucket.

    Numbers follow the order of the texts, so that every pass over the group gives the same ones."""

    def __init__(self, texts: Texts, shared: _Shared, window: int):
        content: list[bytes] = []
        doc, start, bucket = [], [], []
        for d, s, n, sig in texts.runs(window):
            hit, heavy = shared.find(sig)
            if not len(hit):
                continue
            light, dense = hit[~heavy], hit[heavy]
            each = _ranges(s[dense], n[dense])
            spans = np.concatenate([s[light], each]), np.concatenate([n[light], np.ones(len(each), np.int64)])
            doc.append(np.concatenate([d[light], np.repeat(d[dense], n[dense])]))
            start.append(spans[0])
            whole = np.zeros(0, np.int64)
            if len(each):
                a = int(each.min())
                whole = _bucket(run_hashes(texts.data[a : int(each.max()) + window], window)[each - a], shared.buckets)
            bucket.append(np.concatenate([_bucket(sig[light], shared.buckets), whole]))
            if len(spans[0]):
                a = int(spans[0].min())
                raw = texts.data[a : int((spans[0] + spans[1]).max()) + window].tobytes()
                content += [raw[x : x + y] for x, y in zip((spans[0] - a).tolist(), (spans[1] + window - 1).tolist(), strict=True)]
        empty = np.zeros(0, np.int64)
        self.doc, self.start, bucket = (np.concatenate(x) if x else empty for x in (doc, start, bucket))
        self.texts = sorted(set(content))
        place = {x: i for i, x in enumerate(self.texts)}
        self.number = np.fromiter((place[x] for x in content), dtype=np.int64, count=len(content))
        self.size = np.array([len(x) - window + 1 for x in self.texts], dtype=np.int64)
        self.low = np.full(len(self.texts), NO_ID)
        np.minimum.at(self.low, self.number, texts.ids[self.doc])
        self.bucket = np.zeros(len(self.texts), dtype=np.int64)
        self.bucket[self.number] = bucket


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): each document without the bytes of windows that a smaller id has too.

    ``n_spans`` counts the maximal removed runs, ``kept`` (binary) is the remaining bytes one after
    the other. Windows are judged on the input and may overlap. ``window`` is 2 or more."""
    if window < 2:
        raise ValueError("the window must be of 2 bytes or more")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = size // GROUP_BYTES + MORE_GROUPS
    buckets = groups
    rows = rows.withColumn("g", F.pmod(F.xxhash64("id", "text"), F.lit(groups))).repartition(groups, "g")

    def digits(batches):
        held: dict[int, list] = {}
        for batch in batches:
            texts, g = Texts(batch["id"], batch["text"]), batch["g"].to_numpy()
            for d, _, _, sig in texts.runs(window):
                order = np.lexsort((d, sig))  # each signature once a document
                s, d = sig[order], d[order]
                once = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])]) if len(s) else np.zeros(0, bool)
                s, of = s[once], g[d[once]]
                for x in np.unique(of):
                    held.setdefault(int(x), []).append(s[of == x])
        for x in list(held):
            keys, n = np.unique(np.concatenate(held.pop(x)), return_counts=True)
            n = np.minimum(n, 255).astype("u1")
            out = [(b, x, (keys[i] & _LOW).astype("<u4").tobytes(), n[i].tobytes()) for b, i in _by_bucket(_bucket(keys, buckets))]
            yield from _table(out, _SIGNATURES).to_batches()
        release()

    def shared(table):
        keys, size = _joined(table["keys"], "<u4")
        counts, _ = _joined(table["counts"], "u1")
        values, inverse = np.unique(keys, return_inverse=True)
        n = np.bincount(inverse, weights=counts, minlength=len(values))
        most = np.zeros(len(values), dtype=np.uint8)
        np.maximum.at(most, inverse, counts)
        hit, heavy = (n > 1)[inverse], ((n >= HEAVY) | (most == 255))[inverse]
        ends, bucket = np.cumsum(size), table["bucket"][0].as_py()
        out = []
        for x, a, b in zip(table["g"].to_pylist(), ends - size, ends, strict=True):
            use = np.flatnonzero(hit[a:b]) + a
            if len(use):
                out.append((bucket, x, keys[use].tobytes(), heavy[use].astype("u1").tobytes()))
        return _table(out, _SIGNATURES)

    def travelling(left, right):
        if not left.num_rows or not right.num_rows:
            return _table([], _RUNS)
        runs = _Runs(Texts(left["id"], left["text"]), _Shared(right, buckets), window)
        out, g = [], left["g"][0].as_py()
        for b, i in _by_bucket(runs.bucket):
            out.append((b, g, runs.size[i].astype("<u4").tobytes(), runs.low[i].astype("<i8").tobytes(), i.astype("<u4").tobytes(), pa.compress(b"".join([runs.texts[x] for x in i.tolist()]), "zstd", asbytes=True)))
        del runs
        release()
        return _table(out, _RUNS)

    def compared(table):
        sizes, per_row = _joined(table["sizes"], "<u4")
        sizes = sizes.astype(np.int64)
        low, _ = _joined(table["ids"], "<i8")
        numbers, _ = _joined(table["numbers"], "<u4")
        length = sizes + window - 1
        total = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(per_row)])]
        texts = [pa.decompress(x, int(n), "zstd", asbytes=True) for x, n in zip(table["bytes"].to_pylist(), np.diff(total), strict=True)]
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        begin = np.cumsum(length) - length
        flags = repeated_suffixes(data, _ranges(begin, sizes), np.repeat(low, sizes), window)
        first = np.cumsum(sizes) - sizes
        before = np.concatenate([[False], flags[:-1]])
        before[first] = False
        after = np.concatenate([flags[1:], [False]])
        after[(first + sizes - 1)] = False
        starts, stops = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1
        of = np.searchsorted(first, starts, side="right") - 1
        row = np.searchsorted(np.cumsum(per_row), of, side="right")
        out, bucket, g = [], table["bucket"][0].as_py(), table["g"].to_pylist()
        for r, i in _by_bucket(row):
            out.append((bucket, g[r], numbers[of[i]].tobytes(), (starts[i] - first[of[i]]).astype("<u4").tobytes(), (stops[i] - first[of[i]]).astype("<u4").tobytes()))
        release()
        return _table(out, _HITS)

    out_schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cleaned(left, right):
        if not left.num_rows:
            return out_schema.empty_table()
        texts = Texts(left["id"], left["text"])
        n = len(texts.data)
        step = np.zeros(n + 1, dtype=np.int32)
        told = right.filter(pc.is_null(right["starts"]))
        hits = right.filter(pc.is_valid(right["starts"]))
        if told.num_rows:
            runs = _Runs(texts, _Shared(told, buckets), window)
            numbers, _ = _joined(hits["numbers"], "<u4")
            starts, stops = (_joined(hits[c], "<u4")[0].astype(np.int64) for c in ("starts", "stops"))
            order = np.argsort(numbers, kind="stable")
            numbers, starts, stops = numbers[order], starts[order], stops[order]
            again = texts.ids[runs.doc] > runs.low[runs.number]  # the whole run stands in a smaller document of this group
            a, b = runs.start[again], runs.start[again] + runs.size[runs.number[again]] + window - 1
            rest = np.flatnonzero(~again)
            low, high = (np.searchsorted(numbers, runs.number[rest], side=s) for s in ("left", "right"))
            use, base = _ranges(low, high - low), np.repeat(runs.start[rest], high - low)
            np.add.at(step, np.concatenate([a, base + starts[use]]), 1)
            np.add.at(step, np.concatenate([b, base + stops[use] + window - 1]), -1)
            del runs
        gone = np.cumsum(step[:-1]) > 0
        new = gone.copy()
        new[1:] &= ~gone[:-1]
        first = texts.bounds[:-1][texts.bounds[:-1] < texts.bounds[1:]]
        new[first] = gone[first]
        count = lambda flags: (t := np.concatenate([[0], np.cumsum(flags)]))[texts.bounds[1:]] - t[texts.bounds[:-1]]
        removed, spans, size = count(gone), count(new), np.diff(texts.bounds)
        kept = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size - removed)]).astype(np.int64)), pa.py_buffer(texts.data[~gone])]
        )
        release()
        return pa.table([left["id"].combine_chunks(), pa.array(size), pa.array(removed), pa.array(spans), kept.cast(pa.binary())], schema=out_schema)

    known = rows.mapInArrow(digits, _SIGNATURES).groupBy("bucket").applyInArrow(shared, _SIGNATURES)
    moved = rows.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(travelling, _RUNS)
    hits = moved.groupBy("bucket").applyInArrow(compared, _HITS)
    none = F.lit(None).cast("binary")
    back = known.select("bucket", "g", "keys", "counts", none.alias("numbers"), none.alias("starts"), none.alias("stops"))
    back = back.unionByName(hits.select("bucket", "g", none.alias("keys"), none.alias("counts"), "numbers", "starts", "stops"))
    out = rows.groupBy("g").cogroup(back.groupBy("g")).applyInArrow(cleaned, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
