"""Packing against the tokenizer's own ids of whole texts; Hilbert neighbours; token parts."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from cadence.llm import id_files, packing
from cadence.llm.common import scratch_path, table
from cadence.llm.tokens import Encoder, default_tokenizer, encoder

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a ", " a", "a  b", "a \n b", "a\n b", "a \nb", "don't 's x's ' s", "a\xa0b c", "x 　 y", "<|endoftext|> a",
       "a <|endoftext|>b", "Ġ a Ġb", "1 2  3 . . !", "é è😀 漢 字", "a\x1cb \x1f c", "\ta \t b", "tab\tsep x"]


def whole() -> Tokenizer:
    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return t


def test_parts_give_the_ids_of_whole_texts(spark):
    texts = ODD + [r.text for r in table(spark, SF, "documents").collect()]
    e, t = Encoder(default_tokenizer()), whole()
    for _ in range(2):  # new parts, then known ones
        for x, got in zip(texts, e.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_hilbert_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check(rows, expect: dict[int, list[list[int]]], size: int) -> float:
    """Each id in one piece, sequences gapless; returns the share of padding."""
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    padded = total = 0
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
        total += at
        padded += 0 if at & (at - 1) == 0 else size - at
    assert set(docs) == set(expect)
    for d, pieces in docs.items():
        got = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces)
        if len(expect[d]) == 1:
            ids, at = expect[d][0], 0
            for start, length, crc, n in got:
                assert start == at and n == len(ids)
                assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
                at += length
            assert at == len(ids)
        else:
            assert sum(g[1] for g in got) == sum(map(len, expect[d]))
    return padded / max(total, 1)


def test_pack_whole_table(spark):
    docs, t = table(spark, SF, "documents"), whole()
    expect = {r.doc_id: [t.encode(r.text or "", add_special_tokens=False).ids + [0]] for r in docs.collect()}
    for parts in (None, 5):
        assert check(packing.pack(docs, partitions=parts).collect(), expect, 1024) < 0.001


def test_pack_defined_cases(spark):
    t = whole()
    rows = [(1, None, "k"), (2, "", "k"), (None, "a b", "k"), (3, "x y " * 900, None), (3, "x", "k")] + [(10 + i, "same text here", "k") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    expect = defaultdict(list)
    for i, x, _ in rows:
        expect[i].append(t.encode(x or "", add_special_tokens=False).ids + [0])
    got = packing.pack(docs, size=64, with_ids=True, partitions=4).collect()
    check(got, expect, 64)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    assert packing.pack(docs.limit(0)).count() == 0


def test_special_tokens_are_the_librarys(spark):
    t, texts = Tokenizer.from_file(default_tokenizer()), [*ODD, "a <|endoftext|> b", "<|endoftext|>", "x <|endoftext|><|endoftext|> y  z", "a <|endof text|> b"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert 50256 in want[-4]
    e = encoder(default_tokenizer())
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(packing.pack(docs).collect(), {i: [ids + [0]] for i, ids in enumerate(want)}, 1024)
    path = scratch_path(spark, "ids-special")
    id_files.write_ids(docs, path)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in id_files.read_ids(spark, path).collect()}
    assert got == {i: (len(ids) + 1, zlib.crc32(np.array(ids + [0], "<u4").tobytes())) for i, ids in enumerate(want)}


def test_release_changes_nothing(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    kept, released = (sorted(map(tuple, packing.pack(docs, release=r).collect()), key=str) for r in (False, True))
    assert kept == released


def test_a_small_table_of_parts_stays_small():
    e, texts = Encoder(default_tokenizer()), [" ".join(f"w{i * j % 977}" for j in range(60)) for i in range(40)]
    want = e.encode(texts)
    e.forget()
    for t, ids in zip(texts, want, strict=True):
        assert e.encode([t], keep=100) == [ids]
        assert len(e.inner) <= 100 + 60
