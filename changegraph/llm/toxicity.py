"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-case runs of letters and their marks, as 64-bit hashes. A bounded, documented
sample of labelled documents gives the examples; all their terms are indexed, every text is
searched, and inverse document frequencies are counted over all documents. A few telling
words weigh little in the cosine of a long text, so a term's weight has a third factor beside
its frequency in the text and its rarity: how much its presence changes the odds of the label,
as the lower bound of the odds ratio that the examples support (1 where they tell nothing, so
that no term is dropped).

The index is in blocks of like examples. Terms that many examples have are columns of a small
dense matrix a block, the others are posting lists. A batch of queries takes, block by block,
the sum of the largest weights as a bound, starts with each query's best block, and then
visits only blocks whose bound reaches the k-th best cosine so far, so the neighbours found
are exactly the nearest (weights and sums are of single precision), and they are the evidence.

Neighbours vote with weight cosine ** power, together with a prior of one vote at the
sample's base rate. A logistic regression fitted on the votes for the examples (leaving each
example itself out) turns the vote into a probability.

Defined results: a null or empty text has no terms, so it has no neighbours and only the prior
votes. With no labels at all the score is 0. A document labelled twice counts once, as its highest
label; of rows that share a labelled id the smallest text is the example. Only rows with an id
can be labelled. Rows with the same id are scored each. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changegraph.llm.text import Chunk, chunks, materialise, n_groups, release

#: At most so many labelled documents are examples; the rest of the labels is not used.
MOST_EXAMPLES = 20_000
#: At most so many terms are columns of dense matrices; the others are posting lists.
MOST_COLUMNS = 512


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin .. begin + size of all ranges, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _cuts(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def term_chunks(column: pa.Array) -> Iterator[tuple[Chunk, np.ndarray]]:
    """Chunks of texts and the hashes of their terms, one after the other."""
    letters = pc.replace_substring_regex(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")), r"[^\p{L}\p{M}]+", " ")
    for c in chunks(letters):
        yield c, c.word_hashes()


def _counted(doc: np.ndarray, number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size by document, distinct numbers by document, counts) of (document, number below 2**32)."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    own = key[first]
    size = np.bincount((own >> np.uint64(32)).astype(np.int64), minlength=n)
    return size, (own & np.uint64(0xFFFFFFFF)).astype(np.int64), np.diff(np.append(first, len(key)))


def _lists(size: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_cuts(size), pa.int32()), pa.array(values, kind))


def _example_terms(known: DataFrame) -> DataFrame:
    """(term): the hashes of the examples' terms, each once."""

    def distinct(batches):
        for batch in batches:
            for _, h in term_chunks(batch["text"]):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).view(np.int64))], names=["term"])
        release()

    return known.select("text").mapInArrow(distinct, "term long").distinct()


def _vectors(docs: DataFrame, shared) -> DataFrame:
    """(id, terms, counts): the terms of each text that examples have, by number in the sorted terms that are broadcast, and how often."""

    def count(batches):
        release()
        known = shared.value
        bits = max(1, len(known).bit_length())
        begin = np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        for batch in batches:
            for c, h in term_chunks(batch["text"]):
                at = begin[(h >> np.uint64(64 - bits)).astype(np.int64)] if len(known) else np.zeros(0, np.int64)
                low = np.flatnonzero(at < len(known)) if len(known) else at
                low = low[known[at[low]] < h[low]]
                while len(low):
                    at[low] += 1
                    low = low[at[low] < len(known)]
                    low = low[known[at[low]] < h[low]]
                ok = np.flatnonzero(at < len(known))
                ok = ok[known[at[ok]] == h[ok]]
                size, own, n = _counted(c.word_docs()[ok], at[ok], c.n)
                yield pa.RecordBatch.from_arrays([batch["id"].slice(c.first, c.n), _lists(size, own, pa.int32()), _lists(size, n, pa.int32())], names=["id", "terms", "counts"])
        release()

    return docs.select("id", "text").mapInArrow(count, "id long, terms array<int>, counts array<int>")


def _document_frequencies(vectors: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """(documents by term, documents): tasks count, and a row a term reaches the driver."""

    def count(batches):
        df, rows = np.zeros(n_terms + 1, dtype=np.int64), 0
        for batch in batches:
            df += np.bincount(batch["terms"].flatten().to_numpy(), minlength=n_terms + 1)
            df[n_terms] += batch.num_rows  # the last one counts documents
        t = np.flatnonzero(df)
        for i in range(0, len(t), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(t[i : i + 100_000], pa.int32()), pa.array(df[t[i : i + 100_000]])], names=["t", "n"])

    rows = vectors.select("terms").mapInArrow(count, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(n_terms + 1, dtype=np.int64)
    df[rows["t"].to_numpy()] = rows["n"].to_numpy()
    return df[:-1], int(df[-1])


def odds_factors(toxic: np.ndarray, having: np.ndarray, n_toxic: int, n: int) -> np.ndarray:
    """The least change of the label's odds by each term's presence, up or down, that the examples support (two standard errors)."""
    cells = [x + 0.5 for x in (toxic, having - toxic, n_toxic - toxic, n - n_toxic - (having - toxic))]
    change = np.log(cells[0] / cells[1]) - np.log(cells[2] / cells[3])
    return np.exp(np.maximum(np.abs(change) - 2 * np.sqrt(sum(1 / x for x in cells)), 0))


class Shared:
    """What an index is built from; a task that reads it gets the index, built once a worker."""

    def __init__(self, *given):
        self.given = given

    def __reduce__(self):
        return Index, self.given


class Index:
    """Examples in blocks, with the largest weight of each term in each block.

    ``size`` terms of each example are in ``terms`` and ``counts``, one example after the
    other; ``weight`` has the rarity and the odds factor of each term, ``factor`` the latter."""

    def __init__(self, size, terms, counts, labels, ids, weight, factor, block: int = 512, most_columns: int = MOST_COLUMNS):
        n = len(ids)
        often = np.bincount(terms, minlength=len(weight))
        columns = np.argsort(-often, kind="stable")[:most_columns]
        columns = columns[often[columns] * 256 > n]
        self.column = np.full(len(weight), -1, dtype=np.int32)
        self.column[columns] = np.arange(len(columns))
        row = np.repeat(np.arange(n, dtype=np.int32), size)
        w = self._of(counts, terms, weight)
        order = self._order(size, terms, row, np.where((factor > 1.5)[terms], w, np.float32(0)), ids)
        # Positions in the new order, in 32 bits: these arrays are the largest that a worker holds.
        begin, self.size = _cuts(size)[:-1][order], size[order]
        self.first = _cuts(self.size)[:-1]
        at = np.repeat((begin - self.first).astype(np.int32), self.size)
        at += np.arange(len(at), dtype=np.int32)
        self.terms, w = terms[at], w[at]
        at = None
        self.labels, self.ids, self.weight = labels[order].astype(np.float64), ids[order], weight
        row = np.repeat(np.arange(n, dtype=np.int32), self.size)
        norm, some = np.ones(n), np.flatnonzero(self.size)
        if len(some):
            norm[some] = np.sqrt(np.add.reduceat(w * w, self.first[some], dtype=np.float64))
        w /= norm.astype(np.float32)[row]
        self.own = w
        self.base = float((self.labels.sum() + 1) / (n + 2))
        self.block, n_blocks = block, max(1, -(-n // block))
        at = self.column[self.terms]
        self.largest = np.zeros((len(columns), n_blocks), dtype=np.float32)
        self.blocks = []
        cuts = _cuts(self.size)
        for b in range(n_blocks):
            i, j = b * block, min(b * block + block, n)
            p = np.flatnonzero(at[cuts[i] : cuts[j]] >= 0) + cuts[i]
            own, place = np.unique(at[p], return_inverse=True)
            dense = np.zeros((len(own), block), dtype=np.float32)  # the last block is filled up with nothing
            dense[place, row[p] - i] = self.own[p]
            self.blocks.append((own, dense))
            if len(own):
                self.largest[own, b] = dense.max(axis=1)
        left = np.flatnonzero(at < 0).astype(np.int32)
        at = self.terms[left]
        self.begin = _cuts(np.bincount(at, minlength=len(weight)))
        left = left[np.argsort(at, kind="stable")]
        at = None
        self.rows, self.posted = row[left], self.own[left]

    @staticmethod
    def _of(counts, terms, weight) -> np.ndarray:
        w = np.log(counts.astype(np.float32))
        w += 1
        w *= weight.astype(np.float32)[terms]
        return w

    def _order(self, size, terms, row, tells, ids) -> np.ndarray:
        """Like examples side by side make tight bounds: by the commonest term (the language), the most telling one, the next common one."""
        n, none = len(size), MOST_COLUMNS
        some = np.flatnonzero(size > 0)
        first = _cuts(size)[:-1][some]
        top, common = np.full(n, -1, dtype=np.int64), np.full((n, 2), none, dtype=np.int16)
        if len(some):
            most = np.zeros(n, dtype=np.float32)
            most[some] = np.maximum.reduceat(tells, first)
            at = np.flatnonzero((tells > 0) & (tells == most[row]))
            top[row[at]] = terms[at]
            at = tells = None
            rank = np.where(self.column >= 0, self.column, none).astype(np.int16)[terms]
            for k in range(2):
                common[some, k] = np.minimum.reduceat(rank, first)
                rank[rank == common[:, k][row]] = none
        return np.lexsort((ids, common[:, 1], top, common[:, 0]))

    def weights(self, size: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of the terms of some texts, of length 1 a text."""
        row = np.repeat(np.arange(len(size)), size)
        w = self._of(counts, terms, self.weight)
        return w / np.sqrt(np.bincount(row, weights=w * w, minlength=len(size))).astype(np.float32)[row]

    def nearest(self, size: np.ndarray, terms: np.ndarray, w: np.ndarray, k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, cosines) of the k nearest examples of each text with a cosine above 0, nearest first; ties by id."""
        if not len(self.ids):
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(size)
        cuts, out = _cuts(size), []
        for i in range(0, len(size), 128):
            j = min(i + 128, len(size))
            own = slice(cuts[i], cuts[j])
            out += self._batch(size[i:j], terms[own], w[own], k, None if without is None else without[i:j])
        return out

    def _batch(self, size, terms, w, k, without):
        q, block, n_blocks = len(size), self.block, len(self.blocks)
        query, at, cuts = np.repeat(np.arange(q), size), self.column[terms], _cuts(size)
        dense = np.zeros((q, len(self.largest)), dtype=np.float32)
        dense[query[at >= 0], at[at >= 0]] = w[at >= 0]
        score = np.empty((q, n_blocks * block), dtype=np.float32)
        for x in range(q):
            own = slice(cuts[x], cuts[x + 1])
            rare = at[own] < 0
            t = terms[own][rare]
            begin = self.begin[t]
            listed = self.begin[t + 1] - begin
            places = _ranges(begin, listed)
            score[x] = np.bincount(self.rows[places], weights=np.repeat(w[own][rare], listed) * self.posted[places], minlength=n_blocks * block)
        score = score.reshape(q, n_blocks, block)
        bound = dense @ self.largest + score.max(axis=2)
        least, done = np.zeros(q, dtype=np.float32), np.zeros(bound.shape, dtype=bool)

        def visit(b: int, some: np.ndarray) -> None:
            columns, matrix = self.blocks[b]
            own = dense[np.ix_(some, columns)] @ matrix + score[some, b]
            if without is not None:
                out = np.flatnonzero(without[some] // block == b)
                own[out, without[some[out]] % block] = 0.0
            score[some, b] = own
            done[some, b] = True
            if block >= k:
                least[some] = np.maximum(least[some], np.partition(own, block - k, axis=1)[:, block - k])

        best = bound.argmax(axis=1)
        for b in np.unique(best):
            visit(b, np.flatnonzero(best == b))
        for b in np.argsort(-bound.max(axis=0), kind="stable"):
            some = np.flatnonzero((bound[:, b] > 0) & (bound[:, b] >= least - 1e-4) & ~done[:, b])
            if len(some):
                visit(b, some)
        score[~done] = 0.0
        score = score.reshape(q, n_blocks * block)
        rows = (np.flatnonzero(score[x] > max(least[x] - 1e-4, 0)) for x in range(q))
        return [self._top(own, score[x], k) for x, own in enumerate(rows)]

    def _top(self, rows, score, k):
        """The k nearest of ``rows``."""
        cosines = score[rows]
        if len(rows) > k:
            some = np.flatnonzero(cosines >= np.partition(cosines, len(rows) - k)[len(rows) - k])
            rows, cosines = rows[some], cosines[some]
        top = np.lexsort((self.ids[rows], -cosines))[:k]
        return rows[top], np.minimum(cosines[top].astype(np.float64), 1.0)

    def vote(self, rows: np.ndarray, cosines: np.ndarray, power: float) -> float:
        w = cosines**power
        return (float(w @ self.labels[rows]) + self.base) / (float(w.sum()) + 1.0)


def _log_odds(votes: np.ndarray) -> np.ndarray:
    v = np.clip(votes, 1e-6, 1 - 1e-6)
    return np.log(v / (1 - v))


def _platt(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and constant of a logistic regression of the label on the vote's log odds, lightly regularised towards the vote itself."""
    start = np.array([1.0, 0.0])
    if not len(votes) or labels.min() == labels.max():
        return 1.0, 0.0
    x = np.column_stack([_log_odds(votes), np.ones(len(votes))])
    loss = lambda theta: float(np.logaddexp(0, np.where(labels > 0, -1, 1) * (x @ theta)).sum() + ((theta - start) ** 2).sum() / 2)
    theta = start
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - labels) + (theta - start))
        move = 1.0
        while move > 1e-6 and loss(theta - move * step) > loss(theta):
            move /= 2
        theta = theta - move * step
    return float(theta[0]), float(theta[1])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic",
    k: int = 15, power: float = 2.0, most_examples: int = MOST_EXAMPLES, block: int = 512,
) -> DataFrame:
    """(id, score, evidence) of each document; ``labels`` must hold only rows that may be learnt from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull())
    marks = marks.groupBy(F.col(label_id).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = materialise(marks.orderBy(F.xxhash64("id"), "id").limit(most_examples), "sample")  # bounded, so it may be broadcast
    known = rows.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    known = materialise(known, "known")
    share = spark.sparkContext.broadcast

    terms = np.sort(_example_terms(known).toArrow()["term"].to_numpy().view(np.uint64))  # of at most ``most_examples`` texts
    n_terms, terms = len(terms), share(terms)
    examples = materialise(_vectors(known, terms).join(F.broadcast(sample), "id"), "examples")
    vectors = materialise(_vectors(rows, terms), "vectors")
    df, n_docs = _document_frequencies(vectors, n_terms)

    own = examples.select("id", "label", "terms", "counts").orderBy("id").toArrow()  # 8 bytes a term of an example
    ids, label = own["id"].to_numpy(), own["label"].to_numpy()
    size = pc.list_value_length(own["terms"]).to_numpy().astype(np.int64)
    numbers, counts = (own[c].combine_chunks().flatten().to_numpy() for c in ("terms", "counts"))
    toxic = np.bincount(numbers[np.repeat(label == 1, size)], minlength=n_terms)
    factor = odds_factors(toxic, np.bincount(numbers, minlength=n_terms), int(label.sum()), len(label))
    weight = (np.log((1.0 + n_docs) / (1.0 + df)) + 1.0) * factor
    none, shared = not len(ids), share(Shared(size, numbers, counts, label, ids, weight, factor, block))
    own = numbers = counts = None

    def nearest(batch, without=None):
        x = shared.value
        n = pc.list_value_length(batch["terms"]).to_numpy().astype(np.int64)
        t = batch["terms"].flatten().to_numpy()
        return x, x.nearest(n, t, x.weights(n, t, batch["counts"].flatten().to_numpy()), k, without)

    def left_out(batches):
        row_of = {int(i): row for row, i in enumerate(shared.value.ids)}
        for batch in batches:
            x, near = nearest(batch, np.array([row_of[i] for i in batch["id"].to_pylist()], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array([x.vote(*own, power) for own in near], pa.float64())], names=["label", "vote"])
        release()

    fit = examples.select("id", "label", "terms", "counts").repartition(n_groups(spark), "id").mapInArrow(left_out, "label int, vote double")
    fit = fit.toArrow().sort_by([("label", "ascending"), ("vote", "ascending")])  # two numbers an example
    slope, constant = _platt(fit["vote"].to_numpy(), fit["label"].to_numpy().astype(np.float64))
    kind = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def judge(batches):
        for batch in batches:
            x, near = nearest(batch)
            votes = np.array([x.vote(*own, power) for own in near])
            scores = np.zeros(len(votes)) if none else 1.0 / (1.0 + np.exp(-(_log_odds(votes) * slope + constant)))
            at = np.concatenate([np.zeros(0, np.int64), *(r for r, _ in near)])
            cosines = np.concatenate([np.zeros(0), *(c for _, c in near)])
            parts = pa.StructArray.from_arrays([pa.array(x.ids[at]), pa.array(x.labels[at].astype(np.int32)), pa.array(cosines)], fields=list(kind.value_type))
            evidence = pa.ListArray.from_arrays(pa.array(_cuts(np.array([len(r) for r, _ in near], dtype=np.int64)), pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(scores, pa.float64()), evidence], names=["id", "score", "evidence"])
        release()

    out = vectors.mapInArrow(judge, "id long, score double, evidence array<struct<id: long, label: int, cosine: double>>")
    return out.withColumnRenamed("id", id_col)
