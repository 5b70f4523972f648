"""Directories and batches of items against brute force, over several reviews."""

import random
from collections import defaultdict

from changegraph.operators.lines import group_by_directory, pack_batches


def test_group_by_directory_equals_brute_force(spark):
    rnd = random.Random(2)
    data = []
    for i in range(120):
        depth = rnd.choice((0, 1, 2, 3, 14))
        data.append((f"r{i % 2}", "/".join([rnd.choice("ab") for _ in range(depth)] + [f"f{i}"]), rnd.randint(1, 9)))

    def brute(items, depth=1):
        groups, out = defaultdict(list), []
        for review, path, weight in items:
            groups[review, "/".join(path.split("/")[:-1][:depth]) or "."].append((review, path, weight))
        for (review, prefix), own in groups.items():
            if sum(w for *_, w in own) <= 40 or max(p.count("/") for _, p, _ in own) <= depth:
                out += [(review, p, prefix) for _, p, _ in own]
            else:
                out += brute(own, depth + 1)
        return out

    got = group_by_directory(spark.createDataFrame(data, "review_id string, path string, weight int"), most=40)
    assert sorted((r.review_id, r.path, r.dir) for r in got.collect()) == sorted(brute(data))


def test_pack_batches_keeps_directories_whole(spark):
    rnd = random.Random(4)
    data = [(f"r{i % 3}", f"d{rnd.randrange(12)}", i, rnd.choice((1, 2, 3, 5, 30))) for i in range(150)]
    got = pack_batches(spark.createDataFrame(data, "review_id string, dir string, ord long, weight int"), budget=20).collect()
    assert sorted((r.review_id, r.dir, r.ord, r.weight) for r in got) == sorted(data)
    batches, places, totals, first = defaultdict(list), defaultdict(set), defaultdict(int), {}
    for r in got:
        key = (r.review_id, r.dir)
        batches[r.review_id, r.batch].append(r)
        places[key].add(r.batch)
        totals[key] += r.weight
        first[key] = min(first.get(key, r.ord), r.ord)
    assert all(sum(r.weight for r in own) <= 20 or len(own) == 1 for own in batches.values())
    assert all(len(places[key]) == 1 for key, total in totals.items() if total <= 20)
    for review in {r.review_id for r in got}:
        inorder = sorted((r for r in got if r.review_id == review), key=lambda r: (first[review, r.dir], r.ord))
        numbers = [r.batch for r in inorder]
        assert numbers == sorted(numbers) and set(numbers) == set(range(max(numbers) + 1))


def test_pack_batches_equals_a_sequential_fold(spark):
    rnd = random.Random(7)
    data = [(f"r{i % 4 if i < 300 else 9}", f"d{rnd.randrange(14)}", i, rnd.choice((1, 2, 3, 5, 9, 30))) for i in range(330)] + [("one", "d", 1, 99)]
    items = defaultdict(list)
    for review, folder, order, weight in data:
        items[review].append((folder, order, weight))
    want = {}
    for review, own in items.items():
        total, first = defaultdict(int), {}
        for folder, order, weight in own:
            total[folder] += weight
            first[folder] = min(first.get(folder, order), order)
        batch, size, last = -1, 0, None
        for folder, order, weight in sorted(own, key=lambda x: (first[x[0]], x[1])):
            need = total[folder] if folder != last and total[folder] <= 20 else weight
            if batch < 0 or size + need > 20 and not (folder == last and total[folder] <= 20):
                batch, size = batch + 1, 0
            size, last = size + weight, folder
            want[review, order] = batch
    df = spark.createDataFrame(data, "review_id string, dir string, ord long, weight int")
    assert {(r.review_id, r.ord): r.batch for r in pack_batches(df, budget=20).collect()} == want
