"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton
over the vocabulary finds every token that ends at each byte of a piece in one
pass. The encoder then goes from left to right: it takes the longest token at
a place that is compatible with the token before it, tries the next shorter one
if it isn't, and goes back a token if none is; places from which the end can't
be reached are marked and never entered again, so a piece costs time linear in
its length. Two tokens are compatible if the merges, applied to their joined
bytes, end in exactly these two; this is decided from the tokens' own merges
and remembered by pair. A sequence whose neighbours are all compatible is the
one that the merges give.

A vocabulary of ranks has no merge list; a token's merge is what the ranks
below its own give for its bytes. Tokens that these merges can't reach are
used only for pieces equal to them, as the rank encoder does.

Cases. Null text: no ids, decoded to nothing; empty text likewise. Pieces may
be of any length. Repeated rows give repeated results; other columns pass
through ``encode`` or aren't read. No rows: no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table

RANKS = "byte_bpe_multi_50k.tiktoken"
MOST_PIECES = 200_000  # remembered pieces of a worker
MOST_PAIRS = 300_000  # remembered pairs of a worker


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The parts that remain when the pair of the least rank is merged again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        at, least = -1, below
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (least is None or r < least):
                at, least = i, r
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.split: dict[int, tuple[int, int]] = {}  # the two tokens of a token's merge
        self.merged: dict[tuple[int, int], int] = {}
        found = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = merge(token, ranks, rank)
                if len(parts) != 2:
                    continue  # no merges lead here
                pair = ranks[parts[0]], ranks[parts[1]]
                self.split[rank] = pair
                self.merged[pair] = rank
            found.add_word(token.decode("latin-1"), (rank, len(token)))
        found.make_automaton()
        self.found = found
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Do the merges of left's and right's bytes together end in (left, right)?

        Undo the younger of the two that meet at the border, again and again.
        Whenever the two that meet there could merge, that merge must come
        later than the one just undone; of equal merges the left one comes first.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, before, good = left, right, float("inf"), True
        while good:
            if self.merged.get((a, b), before) < before:
                good = False
            elif a in self.split and (a > b or b not in self.split):
                a, before = self.split[a][1], a
            elif b in self.split:
                b, before = self.split[b][0], b + 1
            else:
                break
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = good
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(size)]  # tokens by place, shorter first
        for end, token in self.found.iter(piece.decode("latin-1")):
            starts[end + 1 - token[1]].append(token)
        dead = bytearray(size + 1)
        taken: list[tuple[int, int, int]] = []  # place, which of its tokens, the token
        at, k = 0, len(starts[0]) - 1
        while at < size:
            while k >= 0:
                token, length = starts[at][k]
                if not dead[at + length] and (not taken or self.compatible(taken[-1][2], token)):
                    break
                k -= 1
            if k < 0:
                dead[at] = 1
                at, k, _ = taken.pop()
                k -= 1
            else:
                taken.append((at, k, token))
                at += length
                k = len(starts[at]) - 1 if at < size else 0
        return [t for _, _, t in taken]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, out = self.pieces, []
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
                if len(known) >= MOST_PIECES:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def forget(self) -> None:
        """Empty what is remembered: workers outlive their tasks, their memory is shared with the next ones."""
        self.pieces.clear()
        self.pairs.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    return Bpe(read_ranks(path), pattern)


def encode(
    docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, text: str = "text", check: bool = False
) -> DataFrame:
    """``docs`` with ``text`` replaced by ``ids``: little-endian unsigned 32-bit
    integers. ``check``: also ``decoded``, the bytes that the ids decode to."""
    path, place, names = path or public_tokenizers.path(RANKS), docs.columns.index(text), docs.columns
    names = [*names[:place], "ids", *names[place + 1 :], *["decoded"] * check]

    def run(batches):
        bpe = load(path, pattern)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(place).to_pylist()]
            columns = [pa.array(ids, pa.binary()) if i == place else c for i, c in enumerate(b.columns)]
            if check:
                columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)
        bpe.forget()

    bounded_batches(docs.sparkSession)
    kinds = [T.StructField("ids", T.BinaryType()) if i == place else f for i, f in enumerate(docs.schema.fields)]
    return docs.mapInArrow(run, T.StructType([*kinds, *[T.StructField("decoded", T.BinaryType())] * check]))


def decode(rows: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, ids: str = "ids") -> DataFrame:
    """``rows`` with ``ids`` replaced by ``decoded``: the bytes of the ids."""
    path, place = path or public_tokenizers.path(RANKS), rows.columns.index(ids)
    names = ["decoded" if i == place else c for i, c in enumerate(rows.columns)]

    def run(batches):
        bpe = load(path, pattern)
        for b in batches:
            data = pa.array([bpe.decode(x or b"") for x in b.column(place).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([data if i == place else c for i, c in enumerate(b.columns)], names)

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([T.StructField("decoded", T.BinaryType()) if i == place else f for i, f in enumerate(rows.schema.fields)]))


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, check=True).select(
        "doc_id", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
