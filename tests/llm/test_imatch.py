import hashlib

from pyspark.sql import functions as F

from changegraph.llm.imatch import edited_fingerprints, likeness
from tests.llm.data import frame, rows


def test_edited_texts_and_likeness(spark):
    data = [r for r in rows() if r[0] is not None]
    out = edited_fingerprints(frame(spark, data), idf_low=0.5, idf_high=4.0)
    got = sorted((r.doc_id, r.n_chars, hashlib.sha256(r.edited_text.encode()).hexdigest()) for r in out.collect())
    order = sorted(data, key=lambda r: -r[0])
    want = []
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        want.append((r[0], len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    assert got == sorted(want)


def test_equal_texts_have_equal_fingerprints(spark):
    data = rows()
    out = edited_fingerprints(frame(spark), idf_low=0.5, idf_high=4.0).collect()
    assert len(out) == len(data)
    text = {r[0]: r[1] or "" for r in data if r[0] is not None}
    prints = {}
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id is not None:
            prints.setdefault(text[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert sum(r.near_edited for r in out) > sum(r.near_next for r in out)


def test_likeness_counts_used_lexicons_only(spark):
    df = spark.createDataFrame([("aaaaaa------bbbbbb", "aaaaaacccccc------"), ("=x", "=x"), ("=x", "aaaaaa"), ("------aaaaaa", "------aaaaaa")], "a string, b string")
    assert [r[0] for r in df.select(F.round(likeness("a", "b"), 4)).collect()] == [0.3333, 1.0, 0.0, 1.0]


def test_nothing(spark):
    assert edited_fingerprints(frame(spark, [])).count() == 0
