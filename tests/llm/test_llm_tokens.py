"""Byte-level BPE against the rank encoder; token files against the tokenizers library."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlab.llm import byte_bpe, token_files
from llm_data import documents, frame, ordered, rows_of, stored

RANKS = public_tokenizers.path(byte_bpe.RANKS)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n: int) -> list[str]:
    rng = random.Random(5)
    pools = ["ab", "aab cde", "theTHE ng \n\t-=01", "éü中😀 ́", "'s't'll I'm"]
    out = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 200))) for _ in range(n)]
    return out + ["".join(chr(rng.randint(0x20, 0x2FFF)) for _ in range(100)) for _ in range(50)] + ["a" * 4000, "ab" * 3000]


def test_bpe_equals_the_merges(reference):
    bpe = byte_bpe.load(RANKS, public_tokenizers.PATTERN)
    for t in texts(400) + [r[1] for r in documents() if r[1]]:
        ids = bpe.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()


def test_bpe_with_a_vocabulary_of_few_merges():
    """Every piece of three letters up to length 7, against merging by rank."""
    tokens = [bytes([c]) for c in b"abc"] + [b"ab", b"bc", b"abc", b"aa", b"aab", b"cab", b"bcab", b"cc"]
    ranks = {t: i for i, t in enumerate(tokens)}
    bpe = byte_bpe.Bpe(ranks, r"(?s).+")
    import itertools

    for n in range(1, 8):
        for p in itertools.product(b"abc", repeat=n):
            piece = bytes(p)
            want = [ranks[piece]] if piece in ranks else [ranks[x] for x in byte_bpe.merge(piece, ranks)]
            assert bpe.encode_piece(piece) == want, piece


def test_op9_on_awkward_rows(spark, tmp_path, reference):
    docs = frame(spark, documents())
    got = byte_bpe.op9_byte_bpe(spark, stored(spark, tmp_path / "a", documents=docs))
    want = []
    for r in documents():
        ids = np.array(reference.encode_ordinary(r[1] or ""), "<u4").tobytes()
        want.append((hashlib.sha256((r[1] or "").encode()).hexdigest(), r[0], hashlib.sha256(ids).hexdigest(), len(ids) // 4))
    assert rows_of(got) == ordered(want)
    empty = stored(spark, tmp_path / "b", documents=docs.where("false"))
    assert byte_bpe.op9_byte_bpe(spark, empty).count() == 0
    assert token_files.op6_token_files(spark, empty).count() == 0


def test_op6_on_awkward_rows(spark, tmp_path):
    docs = frame(spark, documents())
    got = [tuple(r) for r in token_files.op6_token_files(spark, stored(spark, tmp_path, documents=docs)).collect()]
    library = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    rows = sorted(((r[0], r[1]) for r in documents()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at, want = 0, []
    for doc_id, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        want.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert ordered(got) == ordered(want)


def test_strings_without_white_space_encode_alone():
    library = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    ids = token_files.Ids(public_tokenizers.path(token_files.TOKENIZER))
    some = texts(200) + ["a<|endoftext|>b c<|startoftext|>", "İstanbul ΟΔΟΣ. ÀÉß×÷ µm", "\x1c\x1d x\x85y　z", "don't WE'LL", "abc." * 40, "été," * 3]
    for t, got in zip(some, ids.encode(some)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("sizes", [[], [0], [1], [5, 0, 7], [1000, 3000, 1], [20_000]])
def test_rans_round_trip(sizes):
    rng = np.random.default_rng(1)
    docs = [(i if i else None, np.minimum(rng.geometric(0.02, n), 49_000).astype("<u4").tobytes()) for i, n in enumerate(sizes)]
    counts = np.bincount(np.frombuffer(b"".join(x for _, x in docs) + b"\1\0\0\0\7\0\0\0", "<u4"))
    t = token_files.Table({i: int(n) for i, n in enumerate(counts) if n})
    payload = token_files.encode_block(docs, t, checkpoint=4096)
    block = token_files.Block(payload, t, checkpoint=4096)
    assert block.doc_ids == [i for i, _ in docs] and block.decode().tobytes() == b"".join(x for _, x in docs)
    parts = [block.segment(k) for k in reversed(range(len(block.places)))]  # checkpoints decode on their own
    assert b"".join(p.tobytes() for p in reversed(parts)) == b"".join(x for _, x in docs)
    if sum(sizes) >= 20_000:
        n, p = sum(sizes), counts[counts > 0] / counts.sum()
        assert len(payload) * 8 < n * -(p * np.log2(p)).sum() * 1.03 + 6 * 64 * token_files.LANES + 1000
    broken = bytearray(payload)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        token_files.Block(bytes(broken), t, checkpoint=4096).decode()


def test_long_blocks_are_decoded_in_segments(spark, tmp_path):
    rng = np.random.default_rng(6)
    sizes = [10, 0, 5 * token_files.CHECKPOINT + 77, 3, 3 * token_files.CHECKPOINT, 8]
    ids = [np.minimum(rng.geometric(0.02, n), 49_000).astype("<u4") for n in sizes]
    first = np.cumsum([0, *sizes])
    rows = [(None if i == 0 else i, 0, int(first[i]), bytearray(x.tobytes())) for i, x in enumerate(ids)]
    tokens = spark.createDataFrame(rows, "doc_id long, part long, first long, ids binary").coalesce(1).sortWithinPartitions("first")
    t = token_files.Table(token_files.count_ids(tokens))
    token_files.write_ids(tokens, str(tmp_path / "f"), t)
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in token_files.read_ids(spark, str(tmp_path / "f"), t).collect())
    assert got == sorted((r[2], -1 if r[0] is None else r[0], bytes(r[3])) for r in rows)
    long = spark.read.parquet(str(tmp_path / "f")).where(f"n_tokens > {token_files.ALONE}")
    parts = token_files.decoded_segments(long, t).select("part", "first", "k", F.spark_partition_id().alias("task"), F.octet_length("ids").alias("n"))
    parts = parts.collect()
    assert len(parts) == 6 + 4 and len({r.task for r in parts}) > 2 and max(r.n for r in parts) == 4 * token_files.CHECKPOINT


def test_one_id_only_and_ids_outside_the_table():
    t = token_files.Table({1: 10})
    one = np.full(700, 1, "<u4").tobytes()
    assert token_files.Block(token_files.encode_block([(1, one)], t), t).decode().tobytes() == one
    with pytest.raises(ValueError):
        token_files.encode_block([(1, np.array([2], "<u4").tobytes())], t)
    assert token_files.Table({}).checksum == token_files.Table({}).checksum
