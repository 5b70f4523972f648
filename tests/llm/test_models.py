import collections
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changegraph.llm import quality_gam, quality_rules, toxicity
from changegraph.llm.text import Chunk, chunks, in_remainder, materialise
from tests.llm.data import frame, rows, words


def test_basic_counts_equal_brute_force(spark):
    got = quality_rules.judge_quality(frame(spark)).collect()
    want = []
    for d, t, *_ in rows():
        t = t or ""
        w = words(t)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = [False] * len(w)
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                again[i : i + 8] = [True] * 8
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 20 or 100 * sum(again) > 30 * len(w)
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(again), failed))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert all(r.kept is False for r in got if r.base_failed)


def test_kneser_ney_equals_brute_force(spark):
    texts = ["abcabcabdabcab. Abc", "abd abc äbd abcd xyzabc", "aaaaabaaaacaaaab", "привет привет мир, мир привет"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    table = quality_rules.kneser_ney(quality_rules.count_ngrams(docs))
    low = (1 << 21) - 1
    letters = lambda hi, lo: "".join(chr(x) for x in (hi >> 21, hi & low, lo >> 42, lo >> 21 & low, lo & low))
    got = {letters(r.hi, r.lo): r.logp for r in table.collect()}
    count = {5: collections.Counter(t[i : i + 5] for t in texts for i in range(len(t) - 4))}
    for n in (4, 3, 2, 1):
        count[n] = collections.Counter(g[1:] for g in count[n + 1])
    p = {"": 1 / len(count[1])}
    for n in range(1, 6):
        k = collections.Counter(count[n].values())
        y = k[1] / max(k[1] + 2 * k[2], 1)
        d = [max(0.1, min(i - 0.05, i - (i + 1) * y * k[i + 1] / max(k[i], 1))) for i in (1, 2, 3)]
        by = collections.defaultdict(list)
        for g, c in count[n].items():
            by[g[:-1]].append((g, c))
        for own in by.values():
            total = sum(c for _, c in own)
            gamma = sum(d[min(c, 3) - 1] for _, c in own) / total
            for g, c in own:
                p[g] = max(c - d[min(c, 3) - 1], 0) / total + gamma * p[g[1:]]
    assert got.keys() == count[5].keys()
    assert all(math.isclose(v, math.log(p[g]), abs_tol=1e-9) for g, v in got.items())
    # Every text's own sum, through groups that ask for what they have.
    rows = docs.select(F.col("doc_id").alias("id"), F.lit("=en").alias("lang"), "text")
    for groups in (1, 3):
        for r in quality_rules.measure(rows, table, groups).collect():
            own = [texts[r.id][i : i + 5] for i in range(len(texts[r.id]) - 4)]
            assert r.lm_n == len(own) and math.isclose(r.lm_sum, sum(math.log(p[g]) for g in own), abs_tol=1e-6)


def test_tables_that_are_used_up_are_deleted(spark, monkeypatch):
    """While the documents are measured only the model is left of what was counted, and then not even that."""
    made, held = [], []
    left = lambda: [name for name, df in made if os.path.exists(df.inputFiles()[0].removeprefix("file:").replace("///", "/"))]
    keep = lambda df, name: (lambda out: made.append((name, out)) or out)(materialise(df, name))
    measure = quality_rules.measure
    monkeypatch.setattr(quality_rules, "materialise", keep)
    monkeypatch.setattr(quality_rules, "measure", lambda *a: held.append(left()) or measure(*a))
    assert quality_rules.judge_quality(frame(spark)).count() == frame(spark).count()
    assert held == [["discounts", "order5"]] and left() == ["discounts", "measured", "scores"]


def test_languages_are_apart_and_null_is_none_of_them(spark):
    docs = spark.createDataFrame([(0, "abcdefgh", None), (1, "abcdefgh", "(none)"), (2, "abcdefgh", "")], "doc_id long, text string, lang string")
    assert quality_rules.count_ngrams(docs).groupBy("lang").count().count() == 3
    assert {r.c for r in quality_rules.count_ngrams(docs).collect()} == {1}


def test_a_changed_model_is_noticed():
    model = quality_rules.Model(np.array([5, 9], dtype=np.uint64), np.array([-1.0, -2.0]))
    assert model.log_probabilities(np.array([9, 5, 9], dtype=np.uint64)).tolist() == [-2.0, -1.0, -2.0]
    with pytest.raises(ValueError):
        model.log_probabilities(np.array([7], dtype=np.uint64))


def test_strange_text_is_rejected_and_clean_text_kept(spark):
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choice(("the", "an", "er", "in", "on")) for _ in range(rnd.randint(1, 3))) for _ in range(40)]
    data = [(i, " ".join(rnd.choice(vocabulary) for _ in range(120)), "en") for i in range(60)]
    data.append((99, " ".join("".join(rnd.choice("QXZJVKW#7") for _ in range(6)) for _ in range(120)), "en"))
    got = {r.doc_id: r.kept for r in quality_rules.judge_quality(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert not got[99] and sum(got[i] for i in range(60)) >= 59


def labelled(spark, column):
    rnd = random.Random(2)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    data = []
    for i in range(400):
        w = [rnd.choice(vocabulary) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for j in rnd.sample(range(40), 12 if column == "quality" else 3):
                w[j] = w[j] + "%%%" if column == "quality" else rnd.choice(("nastya", "nastyb", "nastyc"))
        data.append((i, " ".join(w), int(bad if column == "toxic" else not bad)))
    df = spark.createDataFrame(data, f"doc_id long, text string, {column} int")
    return df.select("doc_id", "text"), df.select("doc_id", column), {d: v for d, _, v in data}


def test_quality_held_out(spark):
    docs, labels, truth = labelled(spark, "quality")
    out = quality_gam.score_quality(docs, labels.where(~in_remainder("doc_id", 3, 1))).where(in_remainder("doc_id", 3, 1)).collect()
    assert np.mean([(r.score >= 0.5) == bool(truth[r.doc_id]) for r in out]) > 0.95


def test_toxicity_held_out_and_evidence(spark):
    docs, labels, truth = labelled(spark, "toxic")
    out = toxicity.score_toxicity(docs, labels.where(~in_remainder("doc_id", 5, 0))).where(in_remainder("doc_id", 5, 0)).collect()
    assert np.mean([(r.score >= 0.5) == bool(truth[r.doc_id]) for r in out]) > 0.95
    assert all(e.id not in {r.doc_id for r in out} for r in out for e in r.evidence)


def test_nearest_examples_equal_all_cosines():
    rnd = np.random.default_rng(4)
    n_terms = 400
    own = [np.unique((n_terms * rnd.random(rnd.integers(0, 30)) ** 3).astype(np.int64)) for _ in range(700)]
    size = np.array([len(t) for t in own])
    terms, counts = np.concatenate(own), rnd.integers(1, 5, size.sum())
    factor = np.where(rnd.random(n_terms) < 0.05, 8.0, 1.0)
    weight = (rnd.random(n_terms) + 0.5) * factor
    ids = rnd.permutation(600)
    n = size[:600].sum()
    index = toxicity.Index(size[:600], terms[:n].astype(np.int32), counts[:n], ids % 2, ids, weight, factor, block=16, most_columns=20)
    dense = np.zeros((700, n_terms))
    dense[np.repeat(np.arange(700), size), terms] = index.weights(size, terms, counts)
    of = {int(i): row for row, i in enumerate(ids)}
    for without in (None, np.array([{int(i): r for r, i in enumerate(index.ids)}[int(ids[x])] if x < 600 else -1 for x in range(700)])):
        found = index.nearest(size, terms, index.weights(size, terms, counts), 15, without)
        for q, (rows_, got) in enumerate(found):
            cos = dense[:600] @ dense[q]
            if without is not None and q < 600:
                cos[q] = 0
            assert np.allclose(got, np.sort(cos[cos > 0])[::-1][:15], atol=1e-6)
            assert np.allclose(cos[[of[int(i)] for i in index.ids[rows_]]], got, atol=1e-6)


def test_odd_rows_and_missing_labels(spark):
    docs = frame(spark)
    none = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).where("false")
    assert {r.score for r in quality_gam.score_quality(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    some = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    for f in (quality_gam.score_quality, toxicity.score_toxicity):
        assert f(docs, some).count() == len(rows()) and all(0 <= r.score <= 1 for r in f(docs, some).collect())
        assert f(frame(spark, []), some.where("false")).count() == 0
    assert quality_rules.judge_quality(frame(spark, [])).count() == 0


def test_chunks_never_cut_texts():
    import pyarrow as pa

    texts = [r[1] for r in rows()]
    parts = list(chunks(pa.array(texts), size=100))
    assert [c.text_bytes(i).decode() for c in parts for i in range(c.n)] == [t or "" for t in texts]
    assert all(isinstance(c, Chunk) for c in parts)


def test_terms_are_runs_of_letters():
    import pyarrow as pa

    texts = ["Straße, ÉTÉ! a1b\u00a0naïve “quoted”", None, "", "été straße", "x" * 3000]
    found = [h.tolist() for c, h in toxicity.term_chunks(pa.array(texts))][0]
    assert len(found) == 6 + 2 + 1 and found[1] == found[6] and found[0] == found[7]


def test_toxicity_searches_every_text_with_terms_of_examples(spark):
    docs, labels, _ = labelled(spark, "toxic")
    rare = " ".join(f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))  # toxic words of one example only
    more = spark.createDataFrame([(1001, rare), (1002, rare + " wxy"), (1003, None)], "doc_id long, text string")
    labels = labels.unionByName(spark.createDataFrame([(1001, 1)], "doc_id long, toxic int"))
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs.unionByName(more), labels).collect()}
    assert all(len(r.evidence) == 15 for d, r in out.items() if d < 1000)
    assert {e.label for r in out.values() for e in r.evidence} == {0, 1}
    assert out[1002].evidence[0].id == 1001 and out[1002].evidence[0].cosine > 0.9
    assert out[1002].score > out[1003].score and not out[1003].evidence


def test_asked_ngrams_travel_packed(spark, monkeypatch):
    """Narrow ranges of hashes give the same sums, and no row a 5-gram is sent: what is asked and told is packed."""
    docs = spark.createDataFrame([(i, "=en" if i % 2 else "=de", f"text {i} of some words, {i * i} in all") for i in range(30)], "id long, lang string, text string")
    table = quality_rules.kneser_ney(quality_rules.count_ngrams(docs.withColumn("lang", F.substring("lang", 2, 9))))
    got = []
    for most in (quality_rules.RANGE_ASKS, 20):
        monkeypatch.setattr(quality_rules, "RANGE_ASKS", most)
        out = quality_rules.measure(docs.repartition(3), table, 3)
        assert "logps" in out._jdf.queryExecution().optimizedPlan().toString()
        got.append({r.id: (r.lm_n, round(r.lm_sum, 9)) for r in out.collect()})
    assert got[0] == got[1] and len(got[0]) == 30
