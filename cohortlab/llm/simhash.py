"""SimHash fingerprints, and all pairs of them within a Hamming radius.

A text's terms are its shingles of five words (lower case), weighted by how
often they occur. Each term's hash votes with its weight for or against every
one of BITS signed bits; the fingerprint is the signs. Two fingerprints differ
in a share of bits that estimates the angle between the weighted term vectors,
so the likeness given is the cosine of that angle, 0 at least.

Radius search: a fingerprint is cut into ``radius + 1`` blocks. Two within the
radius agree in at least one block, so tables permuted to begin with each
block in turn, and looked up by it, find them all. Equal fingerprints are one
entry with a count. Queries are a stated set. The entries of a block value that
more than HOT share are dealt to several tasks, each with the value's queries;
a task holds its entries of a value, the queries pass by and are compared with
all of them at once, so only pairs within the radius come out. No registered
query uses the search: ``op4_simhash`` compares each row with its edit and the
next row only.

``with_next`` puts a table in order of doc_id: rows are dealt by range and
sorted, a task handles each row with the one after it, and the last row of
each part is handled with the first row of the next in a second step that has
two rows a part.

Cases. A null text is empty. Texts without words have the fingerprint of no
votes, all zeros; fewer than five words are one term. Order: doc_id, nulls
last, then text; rows equal in both follow each other. A single row is its own
next. No rows: no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_parts, small_side, table, written
from .shingles import mixed, shingle_hashes

BITS = 256
WORDS = 5
HOT = 2048  # entries of a block value that a task holds, about
_LANES = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of BITS / 8 bytes a text."""
    h, at = shingle_hashes([t.encode() for t in texts], WORDS)
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if a == b:
            continue
        votes = np.zeros(BITS, np.int64)
        for c in range(a, b, 8192):
            part = mixed(h[c : min(b, c + 8192), None] ^ _LANES[None, :])
            votes += np.unpackbits(part.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * votes > b - a)
    return out


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(np.cos(np.pi * differing(a, b) / BITS).round(9), 0.0)


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(ids: list, texts: list[str], after: list[str]) -> pa.RecordBatch:
    """Rows of ``RESULT``."""
    changed = [edited(t, n) for t, n in zip(texts, after)]
    if texts[1:] == after[:-1]:  # each is the next of the one before
        own = fingerprints([*texts, *after[-1:]])
        own, nxt = own[:-1], own[1:]
    else:
        own, nxt = fingerprints(texts), fingerprints(after)
    other = fingerprints(changed)
    hexed = lambda x: [r.tobytes().hex() for r in x]
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()), pa.array(hexed(own), pa.string()),
        pa.array(hexed(other), pa.string()), pa.array(likeness(own, other)), pa.array(likeness(own, nxt)),
    ], [x.split()[0] for x in RESULT.split(", ")])


def with_next(docs: DataFrame, handle: Callable[[list, list[str], list[str]], pa.RecordBatch], schema: str) -> DataFrame:
    """``handle`` gets doc_ids, texts and the next rows' texts; the rest of ``docs`` (doc_id, text) isn't read."""
    spark = docs.sparkSession
    names = [x.split()[0] for x in schema.split(", ")]
    ends = ["part", "end", "end_id", "end_text"]

    def edge(part: int, end: str, doc_id, text: str, like: pa.Schema) -> pa.RecordBatch:
        columns = [pa.nulls(1, f.type) for f in like]
        return pa.RecordBatch.from_arrays([*columns, pa.array([part], pa.int64()), pa.array([end]), pa.array([doc_id], pa.int64()), pa.array([text])], [*names, *ends])

    def walk(batches: Iterator[pa.RecordBatch]):
        part, last, like = TaskContext.get().partitionId(), None, handle([], [], []).schema
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            if not ids:
                continue
            if last is None:
                yield edge(part, "first", ids[0], texts[0], like)
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = ids[-1], texts[-1]
            if len(ids) > 1:
                done = handle(ids[:-1], texts[:-1], texts[1:])
                blank = [pa.nulls(done.num_rows, t) for t in (pa.int64(), pa.string(), pa.int64(), pa.string())]
                yield pa.RecordBatch.from_arrays([*done.columns, *blank], [*names, *ends])
        if last is not None:
            yield edge(part, "last", *last, like)

    bounded_batches(spark)
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shuffle_parts(spark), order[0]).sortWithinPartitions(*order)
    done = written(rows.mapInArrow(walk, f"{schema}, part long, end string, end_id long, end_text string"), "with_next")
    edges = done.where("end is not null").select(*ends)
    parts = sorted(r["part"] for r in edges.where("end = 'first'").select("part").collect())  # one number a part
    after = dict(zip(parts, [*parts[1:], *parts[:1]]))
    lasts = edges.where("end = 'last'").select("part", "end_id", F.col("end_text").alias("text"))
    firsts = edges.where("end = 'first'").select(F.col("part").alias("of"), F.col("end_text").alias("next_text"))
    if after:
        follows = F.element_at(F.create_map(*[F.lit(x) for pair in after.items() for x in pair]), F.col("part"))
        lasts = lasts.withColumn("follows", follows)
    else:
        lasts = lasts.withColumn("follows", F.col("part"))
    meet = lasts.join(firsts, F.col("follows") == F.col("of")).select("end_id", "text", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                yield handle(*[b.column(c).slice(i, 1).to_pylist() for c in range(3)])

    return done.where("end is null").select(*names).unionByName(meet.mapInArrow(finish, schema))


def within_radius(entries: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """All (query, fingerprint, distance, n) within ``radius``, each once.

    ``entries``, ``queries``: a column ``fingerprint`` (hex); n counts equal entries.
    """
    blocks, digits = radius + 1, BITS // 4
    edges = [round(i * digits / blocks) for i in range(blocks + 1)]
    if blocks > digits:
        raise ValueError(f"the radius must be below {digits}")
    key = lambda c: F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.substring(c, edges[i] + 1, edges[i + 1] - edges[i]).alias("value")) for i in range(blocks)]))
    spark = entries.sparkSession
    distinct = entries.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n"))
    asked = queries.where("fingerprint is not null").select(F.col("fingerprint").alias("query")).distinct()
    table_of = distinct.select("fingerprint", "n", key(F.col("fingerprint")).alias("k")).select("k.*", "fingerprint", "n")
    looked = asked.select("query", key(F.col("query")).alias("k")).select("k.*", "query")

    def near(batches: Iterator[pa.RecordBatch]):
        raw = lambda hexes: np.frombuffer(bytes.fromhex("".join(hexes)), np.uint8).reshape(len(hexes), -1).view(np.uint64)
        at, held, counts, words = None, [], [], None
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            rows = {"query": [], "fingerprint": [], "distance": [], "n": []}
            for block, value, salt, kind, fingerprint, n in zip(*columns):
                if (block, value, salt) != at:
                    at, held, counts, words = (block, value, salt), [], [], None
                if kind == 0:  # the entries of a value come before its queries
                    held.append(fingerprint)
                    counts.append(n)
                elif held:
                    words = raw(held) if words is None else words
                    d = np.bitwise_count(words ^ raw([fingerprint])).sum(axis=1)
                    for i in np.flatnonzero(d <= radius).tolist():
                        # a pair comes from the first block in which it agrees
                        if block == next(k for k in range(blocks) if fingerprint[edges[k] : edges[k + 1]] == held[i][edges[k] : edges[k + 1]]):
                            for name, x in zip(rows, (fingerprint, held[i], int(d[i]), counts[i])):
                                rows[name].append(x)
            if rows["n"]:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows.values(), (pa.string(), pa.string(), pa.int32(), pa.int64()))], list(rows))

    bounded_batches(spark, 4096)
    sides = dealt(written(table_of, "radius_entries"), looked)
    rows = sides.repartition(shuffle_parts(spark), "block", "value", "salt").sortWithinPartitions("block", "value", "salt", "kind")
    return rows.mapInArrow(near, "query string, fingerprint string, distance int, n long")


def dealt(entries: DataFrame, looked: DataFrame) -> DataFrame:
    """(block, value, salt, kind, fingerprint, n): ``entries`` as kind 0, each in one salt of
    its block value, and ``looked`` (block, value, query) as kind 1, in all of them."""
    sizes = entries.groupBy("block", "value").agg(F.count("*").alias("size")).where(F.col("size") > HOT)
    hot = written(sizes.select("block", "value", F.ceil(F.col("size") / HOT).cast("long").alias("salts")), "radius_hot")
    hot, salts = small_side(hot), F.coalesce("salts", F.lit(1).cast("long"))
    held = entries.join(hot, ["block", "value"], "left").withColumn("salt", F.pmod(F.xxhash64("fingerprint"), salts))
    asked = looked.join(hot, ["block", "value"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    return held.select("block", "value", "salt", F.lit(0).alias("kind"), "fingerprint", "n").unionByName(
        asked.select("block", "value", "salt", F.lit(1).alias("kind"), F.col("query").alias("fingerprint"), F.lit(None).cast("long").alias("n")))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text"), compared, RESULT)
