import hashlib

from changegraph.llm.hyperminhash import BUCKETS, estimate, near_duplicates, registers
from changegraph.llm.substring_dedup import COVERS, digest, remove_repeats
from tests.llm.data import frame, rows, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_covers_have_every_difference():
    for period, cover in COVERS.items():
        for i in range(period):
            for j in range(period):
                assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def brute_repeats(data, window):
    first, out = {}, []
    for doc, text, *_ in data:
        w = words(text)
        for i in range(len(w) - window + 1):
            if doc is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, doc), doc)
    for doc, text, *_ in data:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, y in zip(w, gone) if not y)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_remove_repeats_equals_brute_force(spark):
    for window, period in ((13, 7), (5, 3), (20, 13)):
        got = digest(remove_repeats(frame(spark), window=window, period=period)).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows(), window)


def test_remove_repeats_of_nothing(spark):
    assert remove_repeats(frame(spark, [])).count() == 0


def test_untouched_texts_and_carried_columns(spark):
    out = remove_repeats(frame(spark), carry=("lang", "h"), keep_untouched=True).collect()
    texts = [r[1] or "" for r in rows()]
    assert {r.h for r in out} == {"h"} and all(r.kept_text in texts for r in out if not r.n_removed)


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(data, k, percent=80):
    sets = {d: shingles(t, k) for d, t, *_ in data if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(shingles(t, k)), None if d is None else find(d), d is None or find(d) == d) for d, t, *_ in data), key=str)


def test_near_duplicates_equal_brute_force(spark):
    for k in (2, 5):
        got = near_duplicates(frame(spark), shingle=k).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_components(rows(), k)


def test_near_duplicates_in_a_large_mixed_group(spark):
    import random

    rnd = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    data = []
    for d in range(150):
        w = list(base)
        for i in rnd.sample(range(60), rnd.choice((1, 2, 4, 6, 7))):
            w[i] = f"x{rnd.randrange(10**6)}"
        data.append((d, " ".join(w), "en", "s", 1, *([7, "b", "g", "h", "k", "z", 1, "t"])))
    got = near_duplicates(frame(spark, data), shingle=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(data, 2)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(frame(spark, [])).count() == 0


def test_estimate_is_near_the_truth():
    import numpy as np

    rng = np.random.default_rng(0)
    for n, common in ((400, 360), (400, 200), (30, 27)):
        errors = []
        for _ in range(30):
            x = rng.integers(0, 2**64, 2 * n - common, dtype=np.uint64)
            a, b = registers(np.sort(x[:n])), registers(np.sort(x[n - common :]))
            assert len(a) == BUCKETS
            errors.append(estimate((a == b).sum(), n, n) - common / (2 * n - common))
        assert abs(float(np.mean(errors))) < 0.03 and max(map(abs, errors)) < 0.15
