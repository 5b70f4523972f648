"""Near duplicates by HyperMinHash sketches, banding and exact confirmation.

Each document's set of word shingles is hashed into 256 buckets. A register keeps, of the
smallest value of its bucket, the number of leading zeros and the next ten bits (the layout
of a floating-point number, 16 bits). Empty buckets borrow from a filled one in an order
of their own. Six registers make a band; documents that share a band are candidates. The
Jaccard estimate from equal registers, corrected for accidental equality, drops hopeless
candidates; the rest are confirmed on the full sets.

Only components are asked for, so a member is first tried against one hub, the smallest
member of most of its bands, and what links is contracted to a component. Of its other
hubs it is then tried against those of other components only, and members outside a
band's largest component are probed against a member of it and another one outside. What is
still apart is compared exactly: members outside the largest component against all others
of their band that are not in their own component, in blocks of bounded size, a pair only in
the first band that it shares. Blocks first hold registers alone; full sets are sent
only for members that have a likely partner. At similarity 0.8 a pair of independent
registers shares none of the 42 bands with probability 3e-6 and falls below the estimate's
slack (four standard deviations or more) with 3e-5.

A band that a third of all rows share is a hot key: its statistics are counted with partial
sums and written first, so that the joins with them are plain ones, which adaptive
execution splits.

Defined results: a document without words has an empty set and is linked with nothing.
With fewer words than a shingle, the whole sequence is the only shingle. Equal sets are one
class, however many documents share it. A row without an id is linked with nothing: its
component is null and it is kept. Rows with the same id count as one document. Extra
columns are ignored and an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changegraph.llm.text import chunks, materialise, mix64, release, window_hashes

BUCKETS, ROWS = 256, 6
BANDS = BUCKETS // ROWS
#: A list of ids up to this many rows (8 bytes each) may be broadcast; beyond, it is shuffled.
BROADCAST_IDS = 500_000
_STARTS = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(56)
#: For each bucket, an order of all buckets to borrow from.
_BORROW = np.stack([np.random.default_rng([7, b]).permutation(BUCKETS) for b in range(BUCKETS)])


def shingle_sets(column, size: int):
    """For each text, the sorted distinct hashes of its shingles (ASCII letters lower-cased)."""
    for c in chunks(column, lower=True):
        h, ok = c.word_hashes(), c.window_ok(size)
        w = window_hashes(h, size)
        for i in range(c.n):
            a, b = c.word_bounds[i], c.word_bounds[i + 1]
            if a == b:
                yield np.zeros(0, dtype=np.uint64)
            elif b - a < size:
                yield window_hashes(h[a:b], int(b - a))
            else:
                assert ok[a]
                yield np.unique(w[a : b - size + 1])


def registers(s: np.ndarray) -> np.ndarray:
    """256 registers of 16 bits of a non-empty sorted set of hashes."""
    at = np.searchsorted(s, _STARTS)
    end = np.append(at[1:], len(s))
    filled = at < end
    value = (s[np.minimum(at, len(s) - 1)] << np.uint64(8)) | np.uint64(255)
    reg = ((value.astype(np.float64).view(np.uint64) >> np.uint64(42)) - np.uint64(1030 << 10)).astype(np.uint16)
    if filled.all():
        return reg
    empty = np.flatnonzero(~filled)
    order = _BORROW[empty]
    return np.where(filled, reg, 0).astype(np.uint16) if not len(empty) else _borrowed(reg, empty, order, filled)


def _borrowed(reg, empty, order, filled):
    out = reg.copy()
    out[empty] = reg[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard from the number of equal registers, less the accidental ones (Yu and Weber, 2017)."""
    ratio = np.minimum(n_a, n_b) / np.maximum(np.maximum(n_a, n_b), 1)
    by_chance = 0.169919487159739 * 4 * ratio / (1 + ratio) ** 2 / 1024
    return (equal / BUCKETS - by_chance) / (1 - by_chance)


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n_shingles, key1, key2, regs): set size, 128-bit identity of the set, registers."""

    def sketch(batches):
        release()
        for batch in batches:
            n, k1, k2, regs = [], [], [], []
            for s in shingle_sets(batch["text"], size):
                n.append(len(s))
                key = xxhash.xxh3_128_intdigest(s.astype("<u8").tobytes()) if len(s) else 0
                k1.append((key >> 64) - (1 << 63))
                k2.append((key & ((1 << 64) - 1)) - (1 << 63))
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(regs, pa.binary())],
                names=["id", "n_shingles", "key1", "key2", "regs"],
            )
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sketch, "id long, n_shingles long, key1 long, key2 long, regs binary")


_BAND = mix64(np.arange(1000, 1000 + BANDS, dtype=np.uint64))
_ROW = mix64(np.arange(2000, 2000 + ROWS, dtype=np.uint64)) | np.uint64(1)


def bands(reps: DataFrame) -> DataFrame:
    """(band, no, id): a row for each band of each sketch, ``no`` counting from 0."""

    def keys(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            r = np.frombuffer(b"".join(batch["regs"].to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
            with np.errstate(over="ignore"):
                k = (r[:, : BANDS * ROWS].reshape(len(r), BANDS, ROWS).astype(np.uint64) * _ROW).sum(axis=2) + _BAND
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(mix64(k).view(np.int64).ravel()),
                    pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(r))),
                    pa.array(np.repeat(batch["id"].to_numpy(), BANDS)),
                ],
                names=["band", "no", "id"],
            )

    return reps.select("id", "regs").mapInArrow(keys, "band long, no int, id long")


def _likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimate reaches ``least``."""

    def keep(batches):
        for t in batches:
            if not t.num_rows:
                continue
            x = np.frombuffer(b"".join(t["regs_a"].to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
            y = np.frombuffer(b"".join(t["regs_b"].to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
            est = estimate((x == y).sum(axis=1), t["n_a"].to_numpy(), t["n_b"].to_numpy())
            yield pa.RecordBatch.from_arrays([t["a"], t["b"]], names=["a", "b"]).filter(pa.array(est >= least))

    a = reps.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("regs").alias("regs_a"))
    b = reps.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("regs").alias("regs_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(keep, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, s): the sorted set of shingle hashes of each document of ``ids``, as bytes of 64-bit integers."""

    def sets(batches):
        for batch in batches:
            if batch.num_rows:
                s = [x.astype("<u8").tobytes() for x in shingle_sets(batch["text"], size)]
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(s, pa.binary())], names=["id", "s"])
        release()

    ids = materialise(ids.distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(ids, "id", "left_semi").mapInArrow(sets, "id long, s binary").dropDuplicates(["id"])


def _confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def same(batches):
        for t in batches:
            ok = []
            for x, y in zip(t["s_a"], t["s_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([t["a"], t["b"]], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    full = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), id_col, text_col, size)
    a, b = full.select(F.col("id").alias("a"), F.col("s").alias("s_a")), full.select(F.col("id").alias("b"), F.col("s").alias("s_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "s_a", "s_b").mapInArrow(same, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), for ids that have a link.

    Each round takes the smallest component among neighbours and then follows that component's
    own component, so paths shorten geometrically; the lineage is cut after every round."""
    edges = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    comp = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    comp = materialise(comp, "components")
    while True:
        near = edges.join(comp.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = comp.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("low"))
        up = comp.select(F.col("id").alias("low"), F.col("component").alias("above"))
        new = materialise(low.join(up, "low", "left").select("id", "old", F.least("low", F.coalesce("above", "low")).alias("component")), "components")
        changed = new.where("old <> component").limit(1).count()
        comp = new.select("id", "component")
        if not changed:
            return comp


def _mixed(shared: DataFrame, tried: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of the bands that hold several components, with the band's largest one.

    Such a band has a member in another component than its hub (``tried``: hub a, member b and
    their bands), so bands inside one component are left out before their members are looked up."""
    of = lambda c: comp.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))
    apart = tried.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(_a, a) <> coalesce(_b, b)")
    apart = materialise(apart.select(F.explode("bands").alias("band")).distinct(), "apart")
    placed = shared.where("members > 2").join(apart, "band").join(comp, "id", "left")
    placed = materialise(placed.select("band", "no", "id", "hub", F.coalesce("component", "id").alias("component")), "placed")
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n_all"), F.max("n").alias("n_largest")
    )
    return materialise(placed.join(materialise(sizes, "sizes"), "band"), "mixed")


def _probes(mixed: DataFrame, turn: int) -> DataFrame:
    """Pairs of each outside member with one member of the largest component and one other outside member of its band."""
    draw, inside = F.xxhash64("id", F.lit(turn)), F.col("component") == F.col("largest")
    picked = materialise(mixed.groupBy("band").agg(F.min_by("id", F.when(inside, draw)).alias("p"), F.min_by("id", F.when(~inside, draw)).alias("q")), "picked")
    pairs = mixed.where(~inside).join(picked, "band").select("id", "hub", F.explode(F.array("p", "q")).alias("y"))
    return pairs.where("id <> y AND id <> hub AND y <> hub").select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b")).distinct()


def _blocks(mixed: DataFrame, reps: DataFrame, block: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Members outside a band's largest component, and all members, in blocks that meet each other once."""
    rows = mixed.join(reps, "id")
    across = F.ceil((F.col("n_all") - F.col("n_largest")) / block).cast("int")
    down = F.ceil(F.col("n_all") / block).cast("int")
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    left = rows.where("component <> largest").withColumn("bx", part(across)).withColumn("by", F.explode(F.sequence(F.lit(0), down - 1)))
    right = rows.withColumn("by", part(down)).withColumn("bx", F.explode(F.sequence(F.lit(0), across - 1)))
    return left, right, ["band", "bx", "by"]


def _apart(mixed: DataFrame, reps: DataFrame, sets, least: float, percent: int, block: int = 512) -> DataFrame:
    """(a, b): the links between members of one band that are in different components.

    Blocks of registers find the members that have a partner whose estimate reaches
    ``least``; ``sets`` (ids -> (id, s)) gives the sets of those alone, and blocks of them
    confirm, so that only links leave a task."""

    def pairs(left, right):
        """(row of left, ids of right that it is likely to be linked with, a pair in its first shared band only)."""
        r = np.frombuffer(b"".join(right["regs"].to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
        ids, comps, n = (right[c].to_numpy() for c in ("id", "component", "n_shingles"))
        no, largest, hub = left["no"][0].as_py(), left["largest"][0].as_py(), left["hub"][0].as_py()
        for row in left.to_pylist():
            if row["id"] == hub:
                continue
            ok = (comps != row["component"]) & ((comps == largest) | (ids > row["id"])) & (ids != hub)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            equal = r[at] == np.frombuffer(row["regs"], dtype=np.uint16)
            likely = estimate(equal.sum(axis=1), n[at], np.full(len(at), row["n_shingles"])) >= least
            at, equal = at[likely], equal[likely]
            if len(at):
                yield row, at[equal[:, : BANDS * ROWS].reshape(len(at), BANDS, ROWS).all(axis=2).argmax(axis=1) == no]

    def likely(left, right):
        found = [np.zeros(0, dtype=np.int64)]
        if left.num_rows and right.num_rows:
            ids = right["id"].to_numpy()
            for row, at in pairs(left, right):
                if len(at):
                    found += [np.array([row["id"]]), ids[at]]
        return pa.table([pa.array(np.unique(np.concatenate(found)))], names=["id"])

    def confirm(left, right):
        out_a, out_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        if left.num_rows and right.num_rows:
            ids, n = right["id"].to_numpy(), right["n_shingles"].to_numpy()
            full = [np.frombuffer(x, dtype="<u8") for x in right["s"].to_pylist()]
            for row, at in pairs(left, right):
                s = np.frombuffer(row["s"], dtype="<u8")
                both = np.array([len(np.intersect1d(s, full[j], assume_unique=True)) for j in at], dtype=np.int64)
                at = at[100 * both >= percent * (len(s) + n[at] - both)]
                out_a.append(np.minimum(ids[at], row["id"]))
                out_b.append(np.maximum(ids[at], row["id"]))
        return pa.table([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    left_cols, right_cols = ("no", "id", "component", "largest", "hub", "n_shingles", "regs"), ("id", "component", "n_shingles", "regs")

    def compared(members: DataFrame, f, schema: str, *more: str) -> DataFrame:
        left, right, keys = _blocks(members, reps, block)
        left, right = left.select(*keys, *left_cols, *more), right.select(*[F.col(c).alias(c) for c in (*keys, *right_cols, *more)])
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(f, schema)

    some = materialise(compared(mixed, likely, "id long").distinct(), "partners")
    left_over = materialise(mixed.join(some, "id", "left_semi").drop("n_all", "n_largest"), "left")
    sizes = left_over.groupBy("band").agg(F.count("*").alias("n_all"), F.count_if(F.col("component") == F.col("largest")).alias("n_largest"))
    return compared(left_over.join(materialise(sizes, "sizes"), "band").join(sets(some), "id"), confirm, "a long, b long", "s").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, slack: float = 0.12, most_turns: int = 1
) -> DataFrame:
    """(id, n_shingles, component_id, kept): the smallest id that near copies lead to, and whether it is the own one.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of
    ``shingle``-word shingles. Candidates with an estimate below percent / 100 - slack are
    not confirmed. ``most_turns`` bounds the probing, not the result: what probing leaves is
    compared exactly."""
    sigs = materialise(sketches(docs, id_col, text_col, shingle), "sketches")
    known = sigs.where("n_shingles > 0 AND id IS NOT NULL")
    classes = materialise(known.groupBy("key1", "key2").agg(F.min("id").alias("rep")), "classes")
    reps = known.join(classes.select(F.col("rep").alias("id"), "key1", "key2"), ["id", "key1", "key2"], "left_semi").dropDuplicates(["id"])
    reps = materialise(reps.select("id", "n_shingles", "regs"), "representatives")
    least = percent / 100 - slack

    every = bands(reps)
    hubs = every.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1")
    shared = materialise(every.join(materialise(hubs, "hubs"), "band"), "bands")
    tried = materialise(shared.where("id <> hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("n"), F.collect_list("band").alias("bands")), "tried")
    links: list[DataFrame] = []

    def link(likely: DataFrame) -> bool:
        likely = materialise(likely, "likely")
        if likely.limit(1).count():
            found = materialise(_confirmed(likely, docs, id_col, text_col, shingle, percent), "links")
            if found.limit(1).count():
                links.append(found)
                return True
        return False

    none = classes.select(F.col("rep").alias("id"), F.col("rep").alias("component")).where("false")
    one = materialise(tried.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"), "first")
    comp = components(links[0]) if link(_likely(one, reps, least)) else none
    other = tried.join(one, ["a", "b"], "left_anti").join(comp.select(F.col("id").alias("a"), F.col("component").alias("_a")), "a", "left")
    other = other.join(comp.select(F.col("id").alias("b"), F.col("component").alias("_b")), "b", "left").where("coalesce(_a, a) <> coalesce(_b, b)")
    if link(_likely(other.select("a", "b"), reps, least)):
        comp = components(reduce(DataFrame.union, links))
    for turn in range(most_turns):
        mixed = _mixed(shared, tried, comp)
        if not link(_likely(_probes(mixed, turn), reps, least)):
            break
        comp = components(reduce(DataFrame.union, links))
    else:
        mixed = _mixed(shared, tried, comp)
    if mixed.limit(1).count():
        found = materialise(_apart(mixed, reps, lambda ids: _sets(docs, ids, id_col, text_col, shingle), least, percent), "links")
        if found.limit(1).count():
            links.append(found)
            comp = components(reduce(DataFrame.union, links))

    placed = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("key1", "key2", F.coalesce("component", "rep").alias("component"))
    out = sigs.drop("regs").join(placed, ["key1", "key2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
