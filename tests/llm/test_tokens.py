import zlib

import numpy as np
import pytest

from changegraph.llm.packing import pack, pack_documents, plan
from changegraph.llm.queries import tokenizer_file
from changegraph.llm.token_files import read_token_files, write_token_files
from changegraph.llm.tokens import Encoder
from tests.llm.data import frame, rows


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


ODD = ["a  b", " a", "a ", "\n", "a\n\nb", "a \n b", "a\tb c", "x. y, z! 12.5 it's we'll 's", "<|endoftext|> a<|endoftext|>", "é è\u00a0ü\u2003x", "日本語 テスト", "a\r\nb", "\x1c a \x1cb", "..", "hello.world", "a b\n", "A.B. c?"]


def test_pieces_encode_like_the_whole_text(tokenizer):
    enc = Encoder(tokenizer_file())
    for text in ODD + [r[1] for r in rows() if r[1]]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), dtype="<u4").tolist() == want, text


def test_token_files_round_trip(spark, tokenizer, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    manifest = write_token_files(frame(spark), folder, tokenizer_file(), end_id=0)
    got = read_token_files(spark, folder, manifest).orderBy("start").collect()
    assert [r.id for r in got] == sorted((r[0] for r in rows()), key=lambda x: (x is not None, x or 0))
    start, texts = 0, {}
    for d, t, *_ in rows():
        texts.setdefault(d, []).append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes())
    for r in got:
        assert r.start == start and bytes(r.ids) in texts[r.id] and r.n_tokens * 4 == len(r.ids)
        start += r.n_tokens


def test_token_files_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    assert read_token_files(spark, folder, write_token_files(frame(spark, []), folder, tokenizer_file(), 0)).count() == 0


def check_packed(out, capacity):
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_keeps_every_token(spark, tokenizer):
    out = pack_documents(frame(spark), tokenizer_file(), end_id=2, capacity=64).collect()
    n = check_packed(out, 64)
    total = 0
    for d, t, *_ in [r for r in rows() if r[0] is not None and r[0] != 5]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own, at = sorted((r for r in out if r.doc_id == d), key=lambda r: r.piece), 0
        for i, r in enumerate(own):
            assert (r.piece, r.start) == (i, at) and (i == 0 or r.length == 64)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    total = sum(r.length for r in out)
    assert n <= 1.1 * (-(-total // 64)) + 2


def test_the_packing_query_remembers_as_many_words_as_the_files_do(spark, monkeypatch):
    """With 300,000 most words of new documents are forgotten before they come again."""
    from changegraph.llm import packing, queries

    asked = []
    monkeypatch.setattr(packing, "pieces", lambda *a: asked.append(a[-1]) or frame(spark).selectExpr("1L as id", "0 as piece", "0L as start", "1L as length", "0L as ids_crc32"))
    queries.op9_pattern_packing(spark, "/root/testdata/sf0.001")
    assert asked == [1_000_000]


def test_packing_one_hot_length(spark):
    rows_ = spark.range(1000).selectExpr("id", "0 as piece", "0L as start", "cast(if(id % 3 = 0, 512, id % 97 + 1) as long) as length", "id as ids_crc32")
    n = check_packed(pack(rows_, 1024).collect(), 1024)
    total = rows_.groupBy().sum("length").first()[0]
    assert n <= total / 1024 + 2


def test_plan_uses_each_length_as_often_as_it_occurs():
    h = np.zeros(101, dtype=np.int64)
    h[[3, 40, 60, 97, 100]] = [5, 7, 4, 9, 2]
    slots = plan(h, 100)
    for v in (3, 40, 60, 97, 100):
        own = slots[slots[:, 0] == v]
        assert own[:, 2].sum() == h[v]
    assert len(plan(np.zeros(101, dtype=np.int64), 100)) == 0


def test_packing_of_nothing(spark):
    assert pack_documents(frame(spark, []), tokenizer_file(), 2).count() == 0
