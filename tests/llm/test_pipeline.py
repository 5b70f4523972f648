"""Each stage of the corpus pipeline on a small table: planted cases, brute force, targets, invariants."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
from changegraph.llm.mixing import targets
from tests.llm.data import frame, rows, words
from tests.llm.test_dedup import brute_components, brute_repeats
from tests.llm.test_tokens import check_packed

STAGE = dict(corpus_pipeline.STAGES)
SHORT = "doc_id long, text string, lang string, source string, n_chars long"


def test_toxicity_rejects_toxic_documents_alone(spark, tmp_path):
    rnd = random.Random(8)
    plain = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    data, labels = [], []
    for i in range(160):
        w = rnd.choices(plain, k=40)
        if toxic := i % 4 == 0:
            for j in rnd.sample(range(40), 5):
                w[j] = rnd.choice(("vile", "scum", "filth", "wretch"))
        data.append((i, " ".join(w), "en", "s", 1))
        if i < 120:
            labels.append((i, 1, int(toxic)))
    data += [(None, None, None, None, None), (None, data[0][1], "en", "s", 1), (None, data[1][1], "en", "s", 1), (500, "", "en", "s", 0), data[1]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = STAGE["toxicity"](spark, spark.createDataFrame(data, SHORT), str(tmp_path))
    assert out.columns == list(corpus_pipeline.COLUMNS)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    toxic = {t for d, t, *_ in data if d is not None and d < 160 and d % 4 == 0}
    assert got == sorted((r for r in data if r[1] not in toxic), key=str)


def test_near_dedup_keeps_one_document_of_a_group(spark):
    out = STAGE["near_dedup"](spark, frame(spark), "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    gone = {d for d, _, _, kept in brute_components(rows(), 5) if not kept}
    assert gone
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted((r[:5] for r in rows() if r[0] not in gone), key=str)


def test_substring_dedup_removes_repeated_passages(spark):
    out = STAGE["substring_dedup"](spark, frame(spark), "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    kept = lambda text: hashlib.sha256(" ".join(words(text)).encode()).hexdigest()
    want = brute_repeats(rows(), 50)
    assert any(removed for _, _, removed, _ in want)
    assert sorted(((r.doc_id, kept(r.text)) for r in out.collect()), key=str) == sorted(((d, h) for d, _, _, h in want), key=str)


def test_source_mixing_meets_each_target(spark):
    out = STAGE["source_mixing"](spark, frame(spark), "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    size, taken, texts = Counter(), Counter(), Counter()
    for _, t, _, s, *_ in rows():
        size[s] += len(words(t))
    for r in out.collect():
        taken[r.source] += len(words(r.text))
        texts[r.doc_id, r.source, r.text] += 1
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert [taken[s] for s in names] == [min(round(g), 3 * size[s]) for s, g in zip(names, goal)]
    given = Counter((d, s, t) for d, t, _, s, *_ in rows())
    whole = {k: n for k, n in texts.items() if k in given}
    assert all(n <= 3 * given[k] for k, n in whole.items()) and sum(texts.values()) - sum(whole.values()) <= len(names)


def test_packing_of_the_last_stage(spark):
    assert check_packed(STAGE["packing"](spark, frame(spark), "").collect(), 1024) > 0


def test_run_on_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
