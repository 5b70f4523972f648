"""The best documents of each item by an exact sparse ball-tree inner-product search.

Terms are the runs of ASCII letters and digits and of all other characters beyond ASCII; only A
to Z are lower-cased. The score is a lexical one in whole numbers: a term's weight
``floor(1000 ln((2N + 2) / (2 df + 1)))`` times its saturated frequency in the document, summed over
the item's terms, once each. That is the inner product of the item's 0/1 vector with the
document's vector of weighted frequencies.

1. Items are taken in blocks of bounded size. One pass over the texts gives each document's
   length and its counts of the block's terms (terms that no item of the block has change no
   product); N, L and document frequencies are counted over all documents by Spark.
2. Each task builds ball trees over blocks of its documents: a node has the centroid of its
   documents and a radius, two far documents halve it. For an item q no document of a node
   scores above ``q . centroid + |q| radius``. Where vectors are sparse most of the radius is
   about terms that the item lacks, so a node also has a radius for each term (how far a
   document's value exceeds the centroid's), and the smaller of both bounds counts. Items
   search a tree best-first: the node of the largest bound comes next, leaves are scored
   exactly in whole numbers, and the search ends when no bound reaches the k-th best score
   that the task knows.
3. A task's k best of each item meet in one ranking by (item, score, document).

Safe rounding: centroids, radii and bounds are doubles. A squared distance is raised by 1e-10 of
the numbers it comes from, and a bound by 1e-9 of itself and by 1, both far above what a
sum of so many products can lose; a bound equal to the k-th score is still opened, since
the smaller id wins a tie. So pruning never changes a result.

Terms meet as 64-bit hashes. Defined results: a null or empty text has no terms and is never
found. Rows with the same document id are ranked each; a document without an id
comes last among equal scores. Rows with the same item id are one item with the terms of all of
them; an item without known terms gets no row. Empty tables give an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changegraph.llm.text import chunks, materialise, release

#: Text of a block of items, in bytes; it bounds the terms and items that tasks are told.
ITEM_BYTES = 1 << 18
#: Documents and counts of a tree, and documents of a leaf.
TREE_DOCS, TREE_COUNTS, LEAF = 4096, 2_000_000, 32
NO_ID = np.iinfo(np.int64).max

_TERM = np.full(256, 32, dtype=np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _TERM[_a:_b] = np.arange(_a, _b)
_TERM[65:91] = np.arange(97, 123)


def term_chunks(column):
    """Chunks of texts whose words are the terms."""
    column = pa.chunked_array(column.chunks if isinstance(column, pa.ChunkedArray) else [column], type=pa.string())
    text = pa.concat_arrays([c.cast(pa.large_string()) for c in column.fill_null("").chunks] or [pa.array([], pa.large_string())])
    if not len(text):
        return
    bounds = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = _TERM[np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]]] if raw is not None else np.zeros(0, np.uint8)
    yield from chunks(pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(bounds - bounds[0]), pa.py_buffer(data)))


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _cuts(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


class Items:
    """A block of items: their ids, their terms by number, and the sorted hashes of all terms."""

    def __init__(self, table: pa.Table):
        found: dict = {}
        ids = table["item_id"].to_pylist()
        for c in term_chunks(table["text"]):
            h = c.word_hashes()
            for i in range(c.n):
                found.setdefault(ids[c.first + i], []).append(h[c.word_bounds[i] : c.word_bounds[i + 1]])
        hashes = {i: np.unique(np.concatenate(parts)) for i, parts in found.items()}
        self.known = np.unique(np.concatenate([*hashes.values(), np.zeros(0, np.uint64)]))
        self.ids = [i for i in hashes if len(hashes[i])]
        self.terms = [np.searchsorted(self.known, hashes[i]) for i in self.ids]


def document_vectors(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(id, n, terms, counts) of documents with a term: all its terms with repeats, and the known ones by number."""

    def count(batches):
        for batch in batches:
            for c in term_chunks(batch["text"]):
                h, n = c.word_hashes(), np.diff(c.word_bounds)
                at = np.searchsorted(known, h)
                hit = np.flatnonzero(at < len(known))
                hit = hit[known[at[hit]] == h[hit]]
                key, counts = np.unique((c.word_docs()[hit] << 32) | at[hit], return_counts=True)
                cuts = _cuts(np.bincount(key >> 32, minlength=c.n))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (key & 0xFFFFFFFF, counts)]
                out = pa.RecordBatch.from_arrays([batch["id"].slice(c.first, c.n), pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))
        release()

    return docs.mapInArrow(count, "id long, n long, terms array<int>, counts array<int>")


class Tree:
    """A ball tree over sparse vectors of whole numbers, all of them with an entry."""

    def __init__(self, cuts: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int, leaf: int = LEAF):
        size, n = np.diff(cuts), len(cuts) - 1
        floats = values.astype(np.float64)
        square = np.add.reduceat(floats * floats, cuts[:-1])
        order = np.arange(n)
        self.low, self.high, self.below, self.radius = [], [], [], []
        centroids, tops = [], []
        todo = [(0, n, -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.low)
            if parent >= 0:
                self.below[parent].append(node)
            rows = order[a:b]
            at = _ranges(cuts[rows], size[rows])
            t, v, first = terms[at], floats[at], _cuts(size[rows])[:-1]
            own = square[rows]

            def apart(dense, norm, t=t, v=v, first=first, own=own):
                return own - 2 * np.add.reduceat(v * dense[t], first) + norm

            center = np.bincount(t, v, n_terms) / len(rows)
            norm = float(center @ center)
            d = apart(center, norm)
            self.low.append(a)
            self.high.append(b)
            self.below.append([])
            self.radius.append(math.sqrt(max(float(d.max()), 0.0) + 1e-10 * (float(own.max()) + norm)))
            centroids.append(center)
            top = np.zeros(n_terms)
            np.maximum.at(top, t, v)
            tops.append(top - center)
            if b - a > leaf:
                far = []
                for _ in range(2):
                    x = rows[int(np.argmax(d))]
                    dense = np.zeros(n_terms)
                    dense[terms[cuts[x] : cuts[x + 1]]] = floats[cuts[x] : cuts[x + 1]]
                    d = apart(dense, float(square[x]))
                    far.append(d)
                order[a:b] = rows[np.argsort(far[0] - far[1], kind="stable")]
                todo += [(a, (a + b) // 2, node), ((a + b) // 2, b, node)]
        self.centroids = np.array(centroids).T.copy()  # by term, so that an item reads only its own terms
        self.reach = np.array(tops).T.copy()
        self.radius = np.array(self.radius)
        self.order = order
        at = _ranges(cuts[order], size[order])
        self.cuts, self.terms, self.values = _cuts(size[order]), terms[at], values[at]

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """No vector of a node has a larger product with the 0/1 vector of ``terms``."""
        around = np.minimum(math.sqrt(len(terms)) * self.radius, self.reach[terms].sum(axis=0))
        return (self.centroids[terms].sum(axis=0) + around) * (1 + 1e-9) + 1

    def search(self, terms: np.ndarray, asked: np.ndarray, least) -> int:
        """Best-first search; ``asked`` flags the terms. ``least(rows, scores)`` takes a leaf's exact scores (rows in
        the given order) and returns the score that still matters; least(None, None) returns it at the start. The
        number of leaves opened is returned."""
        bound, need, opened = self.bounds(terms), least(None, None), 0
        queue = [(-bound[0], 0)]
        while queue:
            best, node = heapq.heappop(queue)
            if -best < need:
                break
            if self.below[node]:
                for x in self.below[node]:
                    if bound[x] >= need:
                        heapq.heappush(queue, (max(-bound[x], best), x))
                continue
            a, b = self.low[node], self.high[node]
            p, q = self.cuts[a], self.cuts[b]
            scores = np.add.reduceat(self.values[p:q] * asked[self.terms[p:q]], self.cuts[a:b] - p)
            need, opened = least(self.order[a:b], scores), opened + 1
        return opened


class Best:
    """The k best (score, id) of one item so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> int:
        use = scores >= self.least()
        if use.any():
            s, i = np.concatenate([self.scores, scores[use]]), np.concatenate([self.ids, ids[use]])
            order = np.lexsort((i, -s))[: self.k]
            self.scores, self.ids = s[order], i[order]
        return self.least()


def _trees(batch, weights: np.ndarray, n_docs: int, n_terms: int):
    """(tree, ids) over blocks of a batch of document vectors."""
    size = np.diff(batch["terms"].offsets.to_numpy())
    terms, counts = (batch[c].flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
    ids = batch["id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
    m = 10 + (90 * batch["n"].to_numpy() * n_docs) // n_terms
    values = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * np.repeat(m, size)))
    cuts = _cuts(size)
    rows = np.flatnonzero(size)
    i = 0
    while i < len(rows):
        room = np.searchsorted(cuts[rows + 1], cuts[rows[i]] + TREE_COUNTS, side="right")
        own = rows[i : max(i + 1, min(i + TREE_DOCS, int(room)))]
        at = _ranges(cuts[own], size[own])
        yield Tree(_cuts(size[own]), terms[at], values[at], len(weights)), ids[own]
        i += len(own)


def _ranked(docs: DataFrame, items: Items, k: int) -> DataFrame:
    vectors = materialise(document_vectors(docs, items.known), "vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # a row a term of the block
    weights = np.zeros(len(items.known), dtype=np.int64)
    for t, n in zip(df["t"].to_pylist(), df["count"].to_pylist(), strict=True):
        weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
    terms = items.terms

    def search(batches):
        best = [Best(k) for _ in terms]
        for batch in batches:
            for tree, ids in _trees(batch, weights, n_docs, n_terms):
                asked = np.zeros(len(weights), dtype=np.int64)
                for own, top in zip(terms, best, strict=True):
                    asked[own] = 1
                    tree.search(own, asked, lambda rows, scores, top=top, ids=ids: top.least() if rows is None else top.add(scores, ids[rows]))
                    asked[own] = 0
        item = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        columns = [np.concatenate([getattr(b, c) for b in best]) if best else np.zeros(0, np.int64) for c in ("ids", "scores")]
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(columns[0], mask=columns[0] == NO_ID), pa.array(columns[1])], names=["item", "id", "score"])
        release()

    found = vectors.mapInArrow(search, "item long, id long, score long")
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), "item long, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def best_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the largest scores above 0 of each item of (item_id, text)."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // item_bytes + 1
    out = None
    for block in range(n):  # a block of items against all documents
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block).toArrow()
        part = Items(own)
        if part.ids:
            found = _ranked(docs, part, k)
            out = found if out is None else out.unionByName(found)
    empty = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return empty if out is None else out
