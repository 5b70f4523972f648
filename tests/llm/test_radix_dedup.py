import hashlib

import numpy as np
import pyarrow as pa

from changegraph.llm import radix_dedup
from changegraph.llm.radix_dedup import remove_repeated_bytes, repeated_suffixes, run_hashes, signatures
from tests.llm.data import frame, rows


def brute(data, window):
    first, out = {}, []
    for doc, text, *_ in data:
        b = (text or "").encode()
        for i in range(len(b) - window + 1):
            if doc is not None:
                first[b[i : i + window]] = min(first.get(b[i : i + window], doc), doc)
    for doc, text, *_ in data:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if doc is not None and first[b[i : i + window]] < doc:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for i, y in enumerate(gone) if y and not (i and gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, window):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in remove_repeated_bytes(df, window=window).collect()), key=str)


def test_equal_to_brute_force(spark):
    for window in (50, 21, 8):
        assert found(frame(spark), window) == brute(rows(), window)


def test_frequent_signatures(spark, monkeypatch):
    monkeypatch.setattr(radix_dedup, "HEAVY", 3)
    rest = (7, "b", "g", "h", "k", "z", 1, "t")
    passage = "the quick brown fox jumps over the lazy dog and runs away into the dark wood; "
    data = [(i, f"{'ab' * (i % 7)} {i} {passage[i % 5:]}{'xyz' * (i % 3)}{i * 7919} {passage}", "en", "s", 1, *rest) for i in range(60)]
    data += [(100, "z" * 3000, "en", "s", 1, *rest), (101, "y" + "z" * 400 + "é" * 200, "en", "s", 1, *rest), (99, "é" * 60, "en", "s", 1, *rest)]
    assert found(frame(spark, data), 50) == brute(data, 50)


def test_no_rows(spark):
    assert remove_repeated_bytes(frame(spark, [])).count() == 0


def test_equal_windows_have_equal_signatures():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    for window in (2, 9, 50):
        sig = signatures(data, window)
        assert len(sig) == len(data) - window + 1
        seen = {}
        for i, s in enumerate(sig.tolist()):
            assert seen.setdefault(data[i : i + window].tobytes(), s) == s
    assert len(np.unique(run_hashes(np.arange(200, dtype=np.uint8), 24))) == 177


def test_radix_passes_flag_what_smaller_ids_have():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    start, ids = np.arange(280), rng.integers(0, 4, 280)
    for window in (3, 8, 11, 20):
        key = [data[s : s + window].tobytes() for s in start]
        low = {}
        for k, i in zip(key, ids):
            low[k] = min(low.get(k, 9), i)
        assert repeated_suffixes(data, start, ids, window).tolist() == [low[k] < i for k, i in zip(key, ids)]


def test_runs_of_slices_are_those_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in (700, 0, 19, 20, 21, 90, 333)]
    table = radix_dedup.Texts(pa.array([1, 2, 3, 4, 5, None, 6], pa.int64()), pa.array(texts, pa.binary()))
    suffixes = lambda: sorted((int(d), int(s) + k, int(g)) for a in table.runs(20) for d, s, n, g in zip(*a) for k in range(n))
    whole = suffixes()
    assert len(whole) == sum(max(len(t) - 19, 0) for i, t in enumerate(texts) if i != 5)
    monkeypatch.setattr(radix_dedup, "SLICE_BYTES", 16)
    assert suffixes() == whole
