import math
import random
import re

import numpy as np

from changegraph.llm import ball_tree
from changegraph.llm.ball_tree import Tree, best_documents
from tests.llm.data import frame, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(d, terms(t)) for d, t, *_ in docs]
    bags = [(d, t) for d, t in bags if t]
    n_docs, total = len(bags), sum(len(t) for _, t in bags)
    df, asked = {}, {}
    for _, t in bags:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, q in asked.items():
        scored = []
        for d, t in bags:
            m = 100 - 90 + (90 * len(t) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in q if x in df)
            if s > 0:
                scored.append((-s, d is None, d))
        for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((i, r, d, -s))
    return sorted(out, key=str)


def items(data):
    texts = [t for _, t, *_ in data if t]
    rnd = random.Random(1)
    made = [(i, " ".join(rnd.choice(texts).split()[:20] + rnd.choice(texts).split()[-9:])) for i in range(25)]
    return [*made, (30, None), (31, ""), (32, "unheard"), (33, "ONE"), (3, "two words"), (None, "line a")]


def found(spark, data, asked, **more):
    out = best_documents(frame(spark, data), spark.createDataFrame(asked, "item_id long, text string"), **more)
    return sorted(map(tuple, out.collect()), key=str)


def test_equal_to_brute_force(spark):
    data = rows()
    assert found(spark, data, items(data)) == brute(data, items(data), 10)


def test_blocks_of_items_give_the_same(spark):
    data = rows()
    assert found(spark, data, items(data), k=3, item_bytes=900) == brute(data, items(data), 3)


def test_nothing_to_search(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, rows(), []) == []


def test_trees_prune_and_stay_exact():
    rng = np.random.default_rng(4)
    docs = []
    for i in range(600):  # clusters with terms of their own
        own = rng.integers(0, 12) * 40
        docs.append({int(t): int(c) for t, c in zip(rng.choice(40, 15, replace=False) + own, rng.integers(1, 10**9, 15))})
    cuts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    tree = Tree(cuts, np.array([t for d in docs for t in d]), np.array([c for d in docs for c in d.values()]), 480, leaf=8)
    opened = 0
    for _ in range(30):
        q = rng.choice(40, 6, replace=False) + int(rng.integers(0, 12)) * 40
        asked = np.zeros(480, dtype=np.int64)
        asked[q] = 1
        best = ball_tree.Best(5)
        opened += tree.search(q, asked, lambda r, s: best.least() if r is None else best.add(s, r))
        scores = sorted(((-sum(d.get(int(t), 0) for t in q), i) for i, d in enumerate(docs)))[:5]
        assert list(zip((-best.scores).tolist(), best.ids.tolist())) == [(s, i) for s, i in scores if s < 0]
        exact = np.array([sum(d.get(int(t), 0) for t in q) for d in docs])[tree.order]
        assert all(exact[a:b].max() <= bound for a, b, bound in zip(tree.low, tree.high, tree.bounds(q)))
    assert opened < 30 * 600 / 8 / 2
