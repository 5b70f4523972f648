import numpy as np

from changegraph.llm.mixing import mix, mixed_documents, permuted, shard_quotas, targets
from tests.llm.data import frame, rows, words


def test_targets_stop_at_three_times_the_size():
    out = targets([10, 1000, 1000, 5], [5, 2, 1, 5])
    assert abs(sum(out) - 2015) < 1e-6 and out[0] == 30 and out[3] == 15
    assert abs(out[1] / out[2] - 2) < 1e-9
    assert targets([], []) == [] and targets([0, 0], [5, 2]) == [0, 0]


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 100, 1000):
        assert sorted(permuted(np.arange(n), n, 9)) == list(range(n))


def test_shards_share_out_all_blocks_exactly():
    quotas = np.array([100, 3, 0, 57])
    total, begin = np.zeros(4, dtype=np.int64), []
    for shard in range(7):
        counts, first = shard_quotas(shard, 7, quotas, 1)
        assert (first == total).all()
        total += counts
        begin.append(counts.sum())
    assert (total == quotas).all() and max(begin) - min(begin) <= 1


def test_mix_takes_each_target(spark):
    placed = mix(frame(spark), block_words=50, shard_blocks=8).collect()
    again = mix(frame(spark), block_words=50, shard_blocks=8).collect()
    assert sorted(map(str, placed)) == sorted(map(str, again))
    size, taken, by_doc = {}, {}, {}
    for d, t, _, s, *_ in rows():
        size[s] = size.get(s, 0) + len(words(t))
    for r in placed:
        taken[r.source] = taken.get(r.source, 0) + (r.taken or 0)
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + (r.taken or 0)
        assert r.source_size == size[r.source] and (r.copy is None) == (r.taken is None) and (r.taken is None or r.shard is not None)
    want = dict(zip(sorted(size, key=lambda x: (x is None, x or "")), targets([size[s] for s in sorted(size, key=lambda x: (x is None, x or ""))], [5, 2, 1, 5])))
    assert all(abs(taken[s] - want[s]) <= 0.51 for s in size)
    for d, t, *_ in rows():
        assert by_doc[d] <= 3 * len(words(t)) or d in (None, 5)


def test_mixed_documents_hold_the_words_taken(spark):
    out = mixed_documents(frame(spark)).collect()
    placed = mix(frame(spark)).where("taken > 0").groupBy().sum("taken").first()[0]
    assert sum(len(words(r.text)) for r in out) == placed


def test_mix_of_nothing(spark):
    assert mix(frame(spark, [])).count() == 0


def test_blocks_go_where_a_walk_down_the_tree_sends_them(spark):
    """Every copy stands in the shard that gets its block when the shards are walked one after the other."""
    placed = [r for r in mix(frame(spark), block_words=50, shard_blocks=8, seed=17).collect() if r.copy is not None]
    sources = sorted({(r.source is None, r.source or "") for r in placed})
    names = [None if none else name for none, name in sources]
    size = {}
    for _, t, _, s, *_ in rows():
        size[s] = size.get(s, 0) + len(words(t))
    order = sorted(size, key=lambda x: (x is None, x or ""))
    goal = dict(zip(order, targets([size[s] for s in order], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))])))
    quotas = np.array([-(-min(round(goal[s]), 3 * size[s]) // 50) for s in order])
    n_shards = max(1, -(-int(quotas.sum()) // 8))
    dealt, begin = {}, np.zeros_like(quotas)
    for shard in range(n_shards):
        counts, first = shard_quotas(shard, n_shards, quotas, 17)
        assert (first == begin).all()
        for s, n in enumerate(counts.tolist()):
            for b in permuted(np.arange(begin[s], begin[s] + n), int(quotas[s]), 17 * 1_000_003 + s).tolist():
                assert dealt.setdefault((order[s], b), shard) == shard
        begin = begin + counts
    assert (begin == quotas).all() and set(names) <= set(order)
    for r in placed:
        assert r.shard == dealt[r.source, (r.copy * r.source_size + r.start) // 50]


def test_longer_blocks_where_there_would_be_too_many(spark, monkeypatch):
    from changegraph.llm import mixing

    monkeypatch.setattr(mixing, "MOST_BLOCKS", 40)
    placed = mix(frame(spark), block_words=1, shard_blocks=2).where("taken > 0")
    assert placed.select("source", "shard").where("shard IS NULL").count() == 0
    assert placed.groupBy().sum("taken").first()[0] == mix(frame(spark)).where("taken > 0").groupBy().sum("taken").first()[0]
