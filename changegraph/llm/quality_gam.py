"""Document quality by a generalised additive model with pairwise interactions.

Each document becomes a fixed list of numbers (FEATURES), cut into quantile bins. Cyclic
boosting visits one feature after another; a shallow tree (at most ``leaves`` leaves) over
that feature's bins is fitted to the gradient and added to the feature's lookup table. The
pairs whose tables of residuals promise most are then boosted the same way with trees of one
cut on either axis. A score is the sum of looked-up values of the bins, through a logistic
function: one vectorised addition a feature or pair.

The model is fitted on at most ``most_examples`` labelled documents (their numbers, not their
texts), a documented parameter; all documents are scored.

Defined results: a null or empty text has all numbers 0. With no labels, or labels of one
kind only, the score is their share (0.5 without any). A document labelled twice counts
once, with its highest label. Rows with the same id are scored each. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changegraph.llm.text import chunks, materialise, mix64

FEATURES = (
    "log_words", "mean_word_bytes", "max_word_log", "symbol_share", "punctuation_share", "digit_share", "upper_share", "non_ascii_share",
    "pipe_share", "exclamation_share", "line_words", "repeated_line_share", "distinct_word_share", "repeated_pair_share", "one_letter_share", "space_share",
)
MOST_EXAMPLES = 50_000


def _classes() -> dict[str, np.ndarray]:
    lut = {name: np.zeros(256, dtype=bool) for name in ("symbol", "punctuation", "digit", "upper", "high", "pipe", "bang", "space", "line")}
    lut["symbol"][list(b"#*$%&<>@^~=_+\\/[]{}")] = True
    lut["punctuation"][list(b".,;:?'\"()-")] = True
    lut["digit"][48:58] = True
    lut["upper"][65:91] = True
    lut["high"][192:] = True
    lut["pipe"][124] = True
    lut["bang"][33] = True
    lut["space"][[9, 11, 12, 13, 32]] = True
    lut["line"][10] = True
    return lut


_CLASS = _classes()


def features(column) -> np.ndarray:
    """A row of FEATURES for each text (float64)."""
    out = [np.zeros((0, len(FEATURES)))]
    for c in chunks(column):
        x = np.zeros((c.n, len(FEATURES)))
        size = np.maximum(np.diff(c.bounds), 1)
        n = np.diff(c.word_bounds)
        words = np.maximum(n, 1)
        length = c.ends - c.starts
        doc = c.word_docs()
        share = {k: c.sums(v[c.data]) / size for k, v in _CLASS.items() if k != "line"}
        lines = c.sums(_CLASS["line"][c.data]) + 1
        x[:, 0] = np.log1p(n)
        x[:, 1] = np.bincount(doc, weights=length, minlength=c.n) / words
        longest = np.zeros(c.n)
        np.maximum.at(longest, doc, length)
        x[:, 2] = np.log1p(longest)
        for i, k in enumerate(("symbol", "punctuation", "digit", "upper", "high", "pipe", "bang")):
            x[:, 3 + i] = share[k]
        x[:, 10] = np.log1p(n / lines)
        # repeated lines, by hashes of lines
        cuts = np.flatnonzero(_CLASS["line"][c.data])
        begin = np.sort(np.concatenate([c.bounds[:-1], cuts + 1]))
        end = np.sort(np.concatenate([c.bounds[1:], cuts]))
        of = np.searchsorted(c.bounds, begin, side="right") - 1
        # an empty document shares its bound with the next one; its single line is empty and counts for neither
        ok = end > begin
        x[:, 11] = _repeats(c.span_hashes(begin[ok], end[ok]), of[ok], c.n) / lines
        h = c.word_hashes()
        x[:, 12] = np.where(n > 0, 1 - _repeats(h, doc, c.n) / words, 0)
        pair = mix64(h[:-1] * np.uint64(3) + h[1:]) if len(h) else h
        inside = doc[:-1] == doc[1:]
        x[:, 13] = _repeats(pair[inside], doc[:-1][inside], c.n) / words
        x[:, 14] = np.bincount(doc, weights=length == 1, minlength=c.n) / words
        x[:, 15] = share["space"]
        x[n == 0] = 0.0
        out.append(x)
    return np.concatenate(out)


def _repeats(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document, values that equal an earlier one."""
    if not len(h):
        return np.zeros(n)
    key = mix64(h ^ mix64(doc.astype(np.uint64) + np.uint64(11)))
    order = np.argsort(key, kind="stable")
    again = key[order][1:] == key[order][:-1]
    return np.bincount(doc[order][1:][again], minlength=n).astype(np.float64)


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values by bin of a tree that cuts the bins up to ``leaves - 1`` times, best gain first."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        m = np.arange(a + 1, b)
        gl, hl, gt, ht = g[m] - g[a], h[m] - h[a], g[b] - g[a], h[b] - h[a]
        gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
        i = int(np.argmax(gain))
        return float(gain[i]), int(m[i])

    parts = [(0, len(grad), *best(0, len(grad)))]
    while len(parts) < leaves:
        i = max(range(len(parts)), key=lambda j: parts[j][2])
        a, b, gain, cut = parts[i]
        if gain <= 1e-9:
            break
        parts[i : i + 1] = [(a, cut, *best(a, cut)), (cut, b, *best(cut, b))]
    out = np.zeros(len(grad))
    for a, b, *_ in parts:
        out[a:b] = -(g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


@dataclass
class Gam:
    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[i], x[:, i], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            a = np.searchsorted(self.pair_cuts[i], x[:, i], side="right")
            b = np.searchsorted(self.pair_cuts[j], x[:, j], side="right")
            total += table[a, b]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, bins: int = 64, pair_bins: int = 8, n_pairs: int = 8, leaves: int = 3, ridge: float = 2.0) -> Gam:
    """A model of the probability of y = 1."""
    n = len(y)
    share = (y.sum() + 1.0) / (n + 2.0)
    cuts, coarse = ([_cuts(x[:, i], b) if n else np.zeros(0) for i in range(len(FEATURES))] for b in (bins, pair_bins))
    model = Gam(cuts, float(np.log(share / (1 - share))), [np.zeros(len(c) + 1) for c in cuts], [], coarse)
    if n == 0 or y.min() == y.max():
        return model
    at = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)]
    total = np.full(n, model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            grad, hess = slope()
            step = rate * _tree(np.bincount(at[i], grad, len(table)), np.bincount(at[i], hess, len(table)), leaves, ridge)
            table += step
            total += step[at[i]]
    low = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(coarse)]
    grad, hess = slope()
    promise = []
    for i in range(len(FEATURES)):
        for j in range(i):
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            cell = low[i] * shape[1] + low[j]
            g, h = np.bincount(cell, grad, shape[0] * shape[1]), np.bincount(cell, hess, shape[0] * shape[1])
            promise.append((float((g**2 / (h + ridge)).sum()), i, j))
    promise.sort(key=lambda v: (-v[0], v[1], v[2]))
    for _, i, j in promise[:n_pairs]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)))
    for _ in range(rounds // 2):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            grad, hess = slope()
            g, h = np.zeros(table.shape), np.zeros(table.shape)
            np.add.at(g, (low[i], low[j]), grad)
            np.add.at(h, (low[i], low[j]), hess)
            step = rate * _quadrants(g, h, ridge)
            table += step
            total += step[low[i], low[j]]
    return model


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Values by cell of a tree with one cut on each axis, the best pair of cuts."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.full(g.shape, -g.sum() / (h.sum() + ridge))
    for a in range(g.shape[0] - 1):
        for b in range(g.shape[1] - 1):
            gs = [cg[a, b], cg[a, -1] - cg[a, b], cg[-1, b] - cg[a, b]]
            hs = [ch[a, b], ch[a, -1] - ch[a, b], ch[-1, b] - ch[a, b]]
            gs.append(cg[-1, -1] - sum(gs))
            hs.append(ch[-1, -1] - sum(hs))
            gain = sum(p * p / (q + ridge) for p, q in zip(gs, hs, strict=True))
            if gain > best + 1e-12:
                best, out = gain, np.empty(g.shape)
                v = [-p / (q + ridge) for p, q in zip(gs, hs, strict=True)]
                out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = v
    return out


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality",
    most_examples: int = MOST_EXAMPLES,
) -> DataFrame:
    """(id, score, features) of each document; ``labels`` must hold only rows that may be learnt from."""

    def measure(batches):
        for batch in batches:
            x = features(batch["text"])
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], lists], names=["id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    measured = materialise(rows.mapInArrow(measure, "id long, x array<double>"), "features")
    marks = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull())
    marks = marks.groupBy(F.col(label_id).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = marks.orderBy(F.xxhash64("id"), "id").limit(most_examples)  # so it may be broadcast
    known = measured.join(F.broadcast(sample), "id").dropDuplicates(["id"]).orderBy("id").toArrow()
    x = known["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    model = docs.sparkSession.sparkContext.broadcast(fit(x, known["label"].to_numpy().astype(np.float64)))

    def judge(batches):
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(model.value.score(x)), batch["x"]], names=["id", "score", "features"])

    return measured.mapInArrow(judge, "id long, score double, features array<double>").withColumnRenamed("id", id_col)
