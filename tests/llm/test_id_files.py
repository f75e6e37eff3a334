"""Token-id files: exact round trips of the coder and of whole tables, damage, defined cases."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cadence.llm import id_codec, id_files, tokens
from cadence.llm.common import scratch_path, table
from cadence.llm.tokens import default_tokenizer

SF = "/root/testdata/sf0.001"


def cases() -> list[np.ndarray]:
    rng = np.random.default_rng(9)
    b = id_codec.BLOCK
    return [
        np.zeros(0), np.zeros(1), np.array([0, 1, 1023, 1024, 1025, 2047, 2048, 50256]), np.zeros(3 * b + 1), np.full(b, 2**24 - 1),
        rng.integers(0, 2**24, 2 * b + 5), rng.integers(0, 1025, b - 1), np.tile(rng.integers(0, 50257, 40), 200),
        (rng.pareto(0.7, 5 * b + 17) * 20).clip(0, 50256), np.arange(2 * b), np.tile([5, 9], b),
    ]


def test_coder_round_trip_and_single_blocks():
    for x in cases():
        x = x.astype("<u4")
        data = id_codec.encode(x)
        assert (id_codec.decode(data) == x).all()
        count = -(-len(x) // id_codec.BLOCK)
        for k in {0, count - 1} if count else ():
            assert (id_codec.decode(data, range(k, k + 1)) == x[k * id_codec.BLOCK : (k + 1) * id_codec.BLOCK]).all()


def test_many_lanes_and_compression():
    x = np.tile(np.random.default_rng(1).integers(0, 300, 700), 80).astype("<u4")
    data = id_codec.encode(x)
    assert (id_codec.decode(data) == x).all() and len(data) < len(x)


def test_damage_is_noticed():
    data = bytearray(id_codec.encode(cases()[-3].astype("<u4")))
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        id_codec.decode(bytes(data))
    with pytest.raises(ValueError):
        id_codec.encode(np.array([2**24]))


def expected(rows) -> list[tuple]:
    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    at, out = 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        out.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_round_trip_on_whole_table(spark):
    docs = table(spark, SF, "documents")
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    for segment in (id_files.SEGMENT, 40_000):
        path = scratch_path(spark, "ids-test")
        id_files.write_ids(docs, path, segment=segment)
        assert sorted(tuple(r) for r in id_files.read_ids(spark, path).collect()) == want
    with_ids = id_files.read_ids(spark, path, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in with_ids)


def test_files_defined_cases(spark):
    schema = "doc_id long, text string, part string, seg int"
    rows = [(5, None, "x", 1), (None, "a", None, 2), (2, "", "y", 3), (9, "long text " * 1500, "z", 4), (-3, "é\x00😀", "z", 4), (11, "tail", "", 0)]
    path = scratch_path(spark, "ids-test")
    id_files.write_ids(spark.createDataFrame(rows, schema), path, segment=5000)
    got = sorted((tuple(r) for r in id_files.read_ids(spark, path).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    path = scratch_path(spark, "ids-test")
    id_files.write_ids(spark.createDataFrame([(1, "a")] * 3 + [(1, "b")], "doc_id long, text string"), path)
    assert sorted(r.start for r in id_files.read_ids(spark, path).collect()) == [0, 2, 4, 6]
    path = scratch_path(spark, "ids-test")
    id_files.write_ids(spark.createDataFrame([], schema), path)
    assert id_files.read_ids(spark, path).count() == 0


def test_texts_with_white_space_at_a_cut_are_encoded_whole():
    rng = random.Random(8)
    alphabet = " a\t\n\u00a0\u2003\x1cb"
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        assert bool(tokens._NOT_PLAIN.search(t)) == bool(re.search(r" \s|\s ", t)), t


def test_real_ids_take_less_than_their_order_0_entropy(spark):
    """Over all documents of sf0.01; the entropy is the static one of the same ids, number table not counted."""
    enc = tokens.encoder(default_tokenizer())
    texts = [r.text or "" for r in table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").select("text").collect()]
    end = np.zeros(1, "<u4").tobytes()
    ids = np.frombuffer(b"".join(x + end for x in enc.encode(texts)), "<u4")
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    coded = id_codec.encode(ids)
    assert len(coded) * 8 / len(ids) < -(share * np.log2(share)).sum() - 0.3
    assert (id_codec.decode(coded) == ids).all()
    assert (id_codec.decode(coded, range(7, 9)) == ids[7 * id_codec.BLOCK : 9 * id_codec.BLOCK]).all()


def test_a_damaged_number_table_is_noticed():
    coded = bytearray(id_codec.encode(np.arange(5000)))
    coded[30] ^= 1
    with pytest.raises(ValueError):
        id_codec.decode(bytes(coded))
