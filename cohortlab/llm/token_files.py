"""Token ids in binary files: static range asymmetric numeral systems (rANS).

A shared table gives each id a whole number of 2^BITS slots, in proportion to
its count over the whole corpus. A block holds whole documents of about
``BLOCK`` ids (a longer document is a block of its own) and is decoded without
any other. Its ids are dealt to LANES interleaved coders, so one step codes
LANES ids with vector operations. A coder's state is 64 bits and moves 32 at a
time to the block's words. Every CHECKPOINT ids a block notes its coders'
states and place among the words: a block of more than ALONE ids is decoded by
segments in separate tasks, and their ids are put together afterwards, since a
document's ids are one row. Checksums cover the table, the block and the decoded ids.

Files are Parquet, written and read by Spark in any store. Beside the blocks, in the
folder ``_table``, stands the table (id, slots), a row an id: whoever has the folder can
decode it. One row a block:
part and first (ids before it in its part; the order of the ids), n_tokens, and
payload, the block in the format below. The documents are in ascending doc_id
order over all parts (nulls first, then by text). Texts are tokenized once, the
ids stored in order, counted, and coded from there.

Block format, little-endian: magic ``rNS1``, table checksum, documents, null
doc_ids, lanes, checkpoints, words (u4 each); doc_ids (i8); ids a document
(u8); checkpoints: words before (u8) and states (u8 a lane); words (u4);
checksum of the decoded ids, checksum of all before it (u4 each).

The ids come from the tokenizers library. If white space always ends a token of the
vocabulary and is dropped, the library is asked for a string between spaces or line
breaks, and its answer remembered (within bounds). Whether that and the short cut for
plain words hold is read from the tokenizer's file (its normalizer and its
splitting) and tried on PROBES; a tokenizer of another kind gets whole texts.

Cases. Null text: only the end id; empty text likewise. Null doc_ids come first;
equal doc_ids follow each other. No rows: no blocks. Other columns aren't read.
An id that the table lacks is an error (the table is counted from the same rows).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import scratch_path
from .common import bounded_batches, shuffle_parts, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BITS = 20
LANES = 512
BLOCK = 1 << 17
CHECKPOINT = 1 << 17
ALONE = 2 * CHECKPOINT  # a block with more ids is decoded in segments, in separate tasks
LOW = np.uint64(1 << 32)  # a state is at least this between steps
MAGIC = 0x31534E72
PROBES = ("", " a  b ", "Two words\nA line", "It's x-ray, (ok)!! 12.5%", "ÀÉÖ straße Ünï", "tab\there \r\n end", "中文 é́ ﬁ 😀", "a,b c;d ...")
MOST_STRINGS = 600_000  # remembered strings of a worker
MOST_PIECES = 1_000_000  # remembered pieces of a worker


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write a byte: printable Latin-1 characters stand
    for themselves, the others for characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(rest)}


class Ids:
    """The tokenizers library behind a memory of strings without white space.

    The vocabulary's letters are lower-cased and a run of letters and a run of
    marks are always pieces of their own, so a string of plain letters with
    marks behind it is looked up as two, in lower case. Such a piece needs no
    normalizing or cutting and goes straight to the library's BPE model; any
    other string goes through the whole tokenizer.
    """

    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*]*)")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(k): v for k, v in byte_letters().items()})
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}
        self.by_word = self._splits_words(path)

    def _splits_words(self, path: str) -> bool:
        """Do the short cuts give what the library gives for whole texts?"""
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        parts = [kind["normalizer"], *(kind["normalizer"] or {}).get("normalizers", []), kind["pre_tokenizer"], *(kind["pre_tokenizer"] or {}).get("pretokenizers", [])]
        kinds = {p["type"] for p in parts if p}
        if not {"Lowercase", "Split", "ByteLevel"} <= kinds or kind["model"]["type"] != "BPE" or kind["model"].get("ignore_merges"):
            return False
        whole = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return all(b"".join(map(self._ids, t.replace("\n", " ").split(" "))) == whole(t) for t in PROBES)

    def forget(self) -> None:
        """Empty what is remembered beyond its bounds: workers outlive their tasks."""
        if len(self.known) > MOST_STRINGS:
            self.known = {}
        if len(self.pieces) > MOST_PIECES:
            self.pieces = {"": b""}

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _ids(self, string: str) -> bytes:
        plain = self.PLAIN.fullmatch(string)
        if not plain:
            return np.array(self.tokenizer.encode(string, add_special_tokens=False).ids, "<u4").tobytes()
        out = b""
        for piece in (plain[1].lower(), plain[2]):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self._piece(piece)
                if len(piece) <= 64:  # long ones aren't remembered
                    self.pieces[piece] = ids
            out += ids
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        self.forget()
        out, known = [], self.known
        for text in texts:
            strings = (text or "").replace("\n", " ").split(" ")
            ids = list(map(known.get, strings))
            if None in ids:
                for i, x in enumerate(ids):
                    if x is None:
                        s = strings[i]
                        ids[i] = x = known.get(s) or self._ids(s)  # it may stand here twice
                        if len(s) <= 64:
                            known[s] = x
            out.append(b"".join(ids))
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Ids:
    return Ids(path)


class Table:
    """Slots by id: ``freq``, where they begin (``cum``), and the id of a slot."""

    @classmethod
    def from_slots(cls, slots: dict[int, int], bits: int = BITS, checksum: int | None = None) -> Table:
        """The table with exactly these slots, as stored beside the blocks."""
        t = cls({}, bits)
        ids = np.array(sorted(slots), np.int64)
        if len(ids):
            t.freq = np.zeros(int(ids[-1]) + 1, np.uint64)
            t.freq[ids] = [slots[i] for i in ids.tolist()]
        t._finish(int(ids[np.argmax(t.freq[ids])]) if len(ids) else 0)
        if checksum is not None and checksum != t.checksum:
            raise ValueError("the table's checksum is wrong")
        return t

    def __init__(self, counts: dict[int, int], bits: int = BITS) -> None:
        if len(counts) >= 1 << bits:
            raise ValueError(f"{len(counts)} different ids don't fit {bits} bits")
        self.bits = bits
        ids = np.array(sorted(counts), np.int64)
        n = np.array([counts[i] for i in ids.tolist()], np.float64)
        freq = np.zeros(int(ids[-1]) + 1 if len(ids) else 0, np.uint64)
        if len(ids):
            spare = (1 << bits) - 1 - len(ids)  # one slot stays free: no id has them all
            share = 1 + np.floor(n / n.sum() * spare).astype(np.int64)
            share[np.argmax(n)] += (1 << bits) - 1 - share.sum()
            freq[ids] = share.astype(np.uint64)
        self.freq = freq
        self._finish(int(ids[np.argmax(n)]) if len(ids) else 0)

    def _finish(self, common: int) -> None:
        freq = self.freq
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else freq
        self.ids = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.common = common  # fills up the last step; any id will do
        self.checksum = zlib.crc32(freq.astype("<u4").tobytes())


def encode_block(docs: list[tuple[int | None, bytes]], t: Table, lanes: int = LANES, checkpoint: int = CHECKPOINT) -> bytes:
    """``docs``: (doc_id, ids), null doc_ids first."""
    data = b"".join(x for _, x in docs)
    ids = np.frombuffer(data, "<u4")
    steps = -(-len(ids) // lanes)
    grid = np.full(steps * lanes, t.common, np.int64)
    grid[: len(ids)] = ids
    if len(ids) and (int(ids.max()) >= len(t.freq) or not t.freq[grid].all()):
        raise ValueError("an id isn't in the table")
    grid = grid.reshape(steps, lanes)
    bits, room = np.uint64(t.bits), np.uint64(64 - t.bits)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []  # from the last step to the first
    marks: list[tuple[int, np.ndarray]] = []
    every, n_words = max(1, checkpoint // lanes), 0
    for step in range(steps - 1, -1, -1):
        f, c = t.freq[grid[step]], t.cum[grid[step]]
        full = state >= (f << room)
        if full.any():
            out = state[full]
            words.append(out.astype("<u4"))
            n_words += len(out)
            state[full] = out >> np.uint64(32)
        high, low = np.divmod(state, f)
        state = (high << bits) + low + c
        if step % every == 0:
            marks.append((n_words, state.copy()))
    marks = [(n_words - w, s) for w, s in reversed(marks)]
    known = [i for i, _ in docs if i is not None]
    head = np.array([MAGIC, t.checksum, len(docs), len(docs) - len(known), lanes, len(marks), n_words], "<u4")
    body = b"".join([
        head.tobytes(), np.array([0] * (len(docs) - len(known)) + known, "<i8").tobytes(),
        np.array([len(x) // 4 for _, x in docs], "<u8").tobytes(),
        *[x for w, s in marks for x in (np.array([w], "<u8").tobytes(), s.astype("<u8").tobytes())],
        *[w.tobytes() for w in reversed(words)], np.array([zlib.crc32(data)], "<u4").tobytes(),
    ])
    return body + np.array([zlib.crc32(body)], "<u4").tobytes()


def decode_words(words: np.ndarray, states: np.ndarray, n: int, t: Table) -> np.ndarray:
    """The n ids that follow a checkpoint, from its states and the words up to the next one."""
    lanes = len(states)
    steps = -(-n // lanes)
    out = np.empty((steps, lanes), "<u4")
    state, at = states.copy(), 0
    bits, slots = np.uint64(t.bits), np.uint64((1 << t.bits) - 1)
    for step in range(steps):
        slot = state & slots
        ids = t.ids[slot.astype(np.int64)]
        out[step] = ids
        state = t.freq[ids] * (state >> bits) + slot - t.cum[ids]
        low = state < LOW
        m = int(np.count_nonzero(low))
        if m:
            state[low] = (state[low] << np.uint64(32)) | words[at : at + m]
            at += m
    return out.reshape(-1)[:n]


class Block:
    """A parsed block; ``segment(k)`` decodes what follows its k-th checkpoint."""

    def __init__(self, payload: bytes, t: Table, checkpoint: int = CHECKPOINT) -> None:
        if zlib.crc32(payload[:-4]) != int.from_bytes(payload[-4:], "little"):
            raise ValueError("a block's checksum is wrong")
        head = np.frombuffer(payload, "<u4", 7).tolist()
        if head[0] != MAGIC or head[1] != t.checksum:
            raise ValueError("no block, or one of another table")
        _, _, n_docs, n_null, self.lanes, n_marks, n_words = head
        at = 28
        doc_ids = np.frombuffer(payload, "<i8", n_docs, at).tolist()
        self.doc_ids = [None] * n_null + doc_ids[n_null:]
        self.sizes = np.frombuffer(payload, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        at += 16 * n_docs
        marks = np.frombuffer(payload, "<u8", n_marks * (1 + self.lanes), at).reshape(n_marks, 1 + self.lanes)
        self.places, self.states = marks[:, 0].astype(np.int64), marks[:, 1:]
        at += marks.nbytes
        self.words = np.frombuffer(payload, "<u4", n_words, at)
        self.data_checksum = int(np.frombuffer(payload, "<u4", 1, at + 4 * n_words)[0])
        self.n, self.every, self.t = int(self.sizes.sum()), max(1, checkpoint // self.lanes), t

    def words_of(self, k: int) -> np.ndarray:
        """The words between the k-th checkpoint and the next."""
        return self.words[self.places[k] : self.places[k + 1] if k + 1 < len(self.places) else None]

    def size_of(self, k: int) -> int:
        return min(self.every * self.lanes, self.n - k * self.every * self.lanes)

    def segment(self, k: int) -> np.ndarray:
        return decode_words(self.words_of(k), self.states[k], self.size_of(k), self.t)

    def decode(self) -> np.ndarray:
        ids = np.concatenate([self.segment(k) for k in range(len(self.places))]) if self.n else np.empty(0, "<u4")
        if zlib.crc32(ids.tobytes()) != self.data_checksum:
            raise ValueError("a block's ids are wrong")
        return ids


def _ids(column: pa.Array, path: str, end_id: int) -> list[bytes]:
    end = np.array([end_id], "<u4").tobytes()
    return [x + end for x in load(path).encode(column.to_pylist())]


def count_ids(tokens: DataFrame) -> dict[int, int]:
    """Counts over all rows; at most one number for each id of the vocabulary reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]):
        n = np.zeros(0, np.int64)
        for b in batches:
            more = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4"))
            if len(more) > len(n):
                n, more = more, n
            n[: len(more)] += more
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n[ids], pa.int64())], ["id", "n"])

    bounded_batches(tokens.sparkSession)
    return {r["id"]: r["n"] for r in tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, first, ids) of ``docs`` (doc_id, text), dealt by range and
    sorted; first counts the ids before a document in its part."""

    def encode(batches: Iterator[pa.RecordBatch]):
        part, first = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = _ids(b.column(1), path, end_id)
            before = np.cumsum([0] + [len(x) // 4 for x in ids]) + first
            first = int(before[-1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([part] * len(ids), pa.int64()), pa.array(before[:-1], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "part", "first", "ids"],
            )

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id")
    return rows.sortWithinPartitions("doc_id", "text").mapInArrow(encode, "doc_id long, part long, first long, ids binary")


def write_ids(tokens: DataFrame, out: str, t: Table, block: int = BLOCK) -> None:
    """``tokens``: the rows of ``tokenized`` as stored; a block is a run of rows that follow each other."""
    names = ["part", "first", "n_tokens", "payload"]

    def encode(batches: Iterator[pa.RecordBatch]):
        docs, at, size = [], None, 0
        for b in _then_none(batches):
            rows = [None] if b is None else zip(*[c.to_pylist() for c in b.columns])
            for row in rows:
                if docs and (row is None or size >= block or (row[1], row[2]) != (at[0], at[1] + size)):
                    done = [[at[0]], [at[1]], [size], [encode_block(docs, t)]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(done, [pa.int64()] * 3 + [pa.binary()])], names)
                    docs, size = [], 0
                if row is not None:
                    at = at if docs else row[1:3]
                    docs.append((row[0], row[3]))
                    size += len(row[3]) // 4

    bounded_batches(tokens.sparkSession)
    blocks = tokens.select("doc_id", "part", "first", "ids").mapInArrow(encode, "part long, first long, n_tokens long, payload binary")
    blocks.write.option("compression", "none").option("parquet.block.size", str(16 << 20)).parquet(out)
    some = np.flatnonzero(t.freq)
    slots = pa.table({"id": pa.array(some), "slots": pa.array(t.freq[some].astype(np.int64)), "bits": pa.array(np.full(len(some), t.bits, np.int32)), "checksum": pa.array(np.full(len(some), t.checksum, np.int64))})
    tokens.sparkSession.createDataFrame(slots).coalesce(1).write.parquet(f"{out}/_table")


def read_table(spark: SparkSession, path: str) -> Table:
    """The table beside the blocks: a row an id of the vocabulary."""
    rows = spark.read.schema("id long, slots long, bits int, checksum long").parquet(f"{path}/_table").collect()
    return Table.from_slots({r["id"]: r["slots"] for r in rows}, rows[0]["bits"], rows[0]["checksum"]) if rows else Table({})


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


SEGMENT = "part long, first long, k long, n long, states binary, words binary, doc_ids array<long>, sizes array<long>, checksum long"
DECODED = "part long, first long, k long, ids binary, doc_ids array<long>, sizes array<long>, checksum long"


def decoded_segments(blocks: DataFrame, t: Table) -> DataFrame:
    """Rows of ``DECODED`` of the blocks (part, first, payload): one for each
    checkpoint, dealt to tasks one by one. The first of a block has its doc_ids,
    sizes and checksum of ids."""
    types = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.list_(pa.int64())] * 2 + [pa.int64()]
    names = [x.split()[0] for x in SEGMENT.split(", ")]

    def split(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for part, first, payload in zip(*[b.column(i).to_pylist() for i in range(3)]):
                x = Block(payload, t)
                for k in range(len(x.places)):
                    head = [None] * 3 if k else [x.doc_ids, x.sizes.tolist(), x.data_checksum]
                    row = [part, first, k, x.size_of(k), x.states[k].tobytes(), x.words_of(k).tobytes(), *head]
                    yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, types)], names)

    def decode(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                n, states, words = [b.column(c)[i].as_py() for c in (3, 4, 5)]
                ids = decode_words(np.frombuffer(words, "<u4"), np.frombuffer(states, "<u8"), n, t)
                kept = b.slice(i, 1)
                columns = [*[kept.column(c) for c in (0, 1, 2)], pa.array([ids.tobytes()], pa.binary()), *[kept.column(c) for c in (6, 7, 8)]]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in DECODED.split(", ")])

    spark = blocks.sparkSession
    rows = blocks.select("part", "first", "payload").mapInArrow(split, SEGMENT)
    return rows.repartition(shuffle_parts(spark), "part", "first", "k").mapInArrow(decode, DECODED)


def read_ids(spark: SparkSession, path: str, t: Table | None = None) -> DataFrame:
    """(doc_id, start, ids): ids as little-endian unsigned 32-bit integers, start counts
    all ids before. Without ``t`` the table is read from the folder."""
    t = t or read_table(spark, path)
    blocks = spark.read.parquet(path)
    before, total, most = {}, 0, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("most")).collect()):  # a row a part
        before[r["part"]], total, most = total, total + r["n"], max(most, r["most"])
    result, names = "doc_id long, start long, ids binary", ["doc_id", "start", "ids"]

    def documents(part: int, first: int, doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(sizes)
        starts = (before[part] + first + ends - sizes).tolist()
        data = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], names)

    def decode(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for part, first, payload in zip(*[b.column(i).to_pylist() for i in range(3)]):
                x = Block(payload, t)
                yield documents(part, first, x.doc_ids, x.sizes, x.decode())

    def join(batches: Iterator[pa.RecordBatch]):
        at, head, pieces, missing = None, None, [], 0
        for b in batches:
            for i in range(b.num_rows):
                part, first, k, ids, *own = [c[i].as_py() for c in b.columns]
                if k == 0:
                    at, head, pieces, missing = (part, first), own, [], sum(own[1])
                if at != (part, first) or k != len(pieces):
                    raise ValueError("a block's segments are incomplete")
                pieces.append(ids)
                missing -= len(ids) // 4
                if not missing:
                    data = b"".join(pieces)
                    if zlib.crc32(data) != head[2]:
                        raise ValueError("a block's ids are wrong")
                    yield documents(part, first, head[0], np.array(head[1], np.int64), np.frombuffer(data, "<u4"))
                    pieces = []

    short = blocks.where(F.col("n_tokens") <= ALONE).select("part", "first", "payload").mapInArrow(decode, result)
    if most <= ALONE:
        return short
    segments = decoded_segments(blocks.where(F.col("n_tokens") > ALONE), t)
    segments = segments.repartition(shuffle_parts(spark), "part", "first").sortWithinPartitions("part", "first", "k")
    return short.unionByName(segments.mapInArrow(join, result))


def op6_token_files(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = tokenized(docs, tokenizer)
    stored = scratch_path(spark, "tokens")
    tokens.write.option("compression", "zstd").parquet(stored)
    tokens = spark.read.schema(tokens.schema).parquet(stored)
    t = Table(count_ids(tokens))
    path = scratch_path(spark, "token_files")
    write_ids(tokens, path, t)
    rows = read_ids(spark, path)
    return rows.select("doc_id", "start", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
