"""MinHash near-duplicates with odd sketches.

Two documents are linked if their sets of word shingles have a Jaccard
similarity of at least ``num / den``; components of links are the groups.

1. Each text gives its shingle set's size, a 128-bit hash of the set, BANDS *
   ROWS MinHash samples, the bands' keys, and an odd sketch: the samples folded
   into a parity bitmap. Samples that differ flip at most two bits of the XOR
   of two sketches, so its population count estimates how many differ.
2. Equal sets are one node (the smallest doc_id), however many copies there are.
3. Nodes are dealt by range over (band key, node), so a bucket of any size
   spreads over tasks. Nodes alone in all their buckets are done. A node is
   proposed to the first node of its bucket, or else to the one before it, if
   the sketches don't rule the pair out: a row a node and band at most.
4. Proposals are confirmed on the full sets; components are contracted.
5. Buckets that still hold several components are compared in full, with the
   sets, inside tasks: members are cut into chunks and a task gets two of them,
   so no task holds a large bucket. Pairs are ruled out by size and by odd
   sketches of the whole sets, whose XOR never counts more than the sets differ
   in; what remains is compared exactly. Only links that join components come
   out, fewer than members, so rows don't grow with a group's square.
   Components are contracted again.

A link with similarity s is missed only if no band agrees: (1 - s^ROWS)^BANDS,
2e-8 at 0.85 and 3e-6 at 0.8. Step 3 may rule out a link with probability
below 1e-9; step 5 doesn't use it.

Cases. Null or empty texts, and texts without words: no set, a group each, kept.
Fewer than k words: the whole sequence is the one shingle. Rows with the same
doc_id are one node; a null doc_id takes no part (null component, null kept).
Other columns aren't read. No rows: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_parts, small_side, table, written
from .components import components
from .shingles import mixed, shingle_hashes

BANDS, ROWS = 24, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512  # of the odd sketch of the samples
SET_BITS = 2048  # of the odd sketch of a whole set
CHUNK = 2048  # members of a bucket that a task compares with as many others
LIGHT_ROWS = 8192  # rows of ids and sketches in a batch
FEW_IDS = 2_000_000  # ids that may be broadcast: 16 MB

_rng = np.random.default_rng(77)
_MASK = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_FACTOR = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode() for t in texts]


def _sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    h, at = shingle_hashes(_encoded(texts), k)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, one row a non-empty set."""
    out = np.empty((len(sets), SAMPLES), np.uint64)
    first = 0
    while first < len(sets):  # as many sets at a time as stay in the cache
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= 16384):
            size += len(sets[last])
            last += 1
        flat = np.concatenate(sets[first:last])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[first:last]])[:-1]])
        for i in range(SAMPLES):
            x = (flat ^ _MASK[i]) * _FACTOR[i]
            out[first:last, i] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), starts)
        first = last
    return out


def parity(rows: np.ndarray, places: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bitmaps of ``n`` rows as bytes: a bit is set if an odd number of places hit it."""
    hits = np.bincount(rows * bits + places, minlength=n * bits).reshape(n, bits)
    return np.packbits((hits & 1).astype(np.uint8), axis=1)


def odd_sketches(s: np.ndarray) -> np.ndarray:
    n = len(s)
    places = mixed(s ^ (np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(SKETCH_BITS)
    return parity(np.repeat(np.arange(n), SAMPLES), places.astype(np.int64).ravel(), n, SKETCH_BITS)


def band_keys(s: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(s), 0)
    for j in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + s[:, j::ROWS])
    return key.view(np.int64)


def similarity(differing_bits: float) -> float:
    """The estimate of an odd sketch pair."""
    rest = 1 - 2 * differing_bits / SKETCH_BITS
    return 1 + SKETCH_BITS / 4 * math.log(rest) / SAMPLES if rest > 0 else 0.0


@lru_cache(maxsize=8)
def most_bits(num: int, den: int) -> int:
    """Bits in which the sketches of linked sets differ at most, but for a chance below 1e-9."""
    p, tail, d = 1 - num / den, 1.0, 0
    while tail > 1e-9 and d < SAMPLES:
        tail -= math.comb(SAMPLES, d) * p**d * (1 - p) ** (SAMPLES - d)
        d += 1
    return 2 * d


def signatures(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            sets = _sets(b.column(1).to_pylist(), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            s = samples([sets[i] for i in full])
            sketch, keys = odd_sketches(s), band_keys(s)
            of = {i: j for j, i in enumerate(full)}
            a = [int(mixed(x).sum(dtype=np.uint64).astype(np.int64)) if len(x) else 0 for x in sets]
            c = [int(np.bitwise_xor.reduce(mixed(x ^ np.uint64(0xA5A5A5A5))).astype(np.int64)) if len(x) else 0 for x in sets]
            yield pa.RecordBatch.from_arrays([
                b.column(0).cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64()),
                pa.array([sketch[of[i]].tobytes() if i in of else None for i in range(len(sets))], pa.binary()),
                pa.array([keys[of[i]].tolist() if i in of else None for i in range(len(sets))], pa.list_(pa.int64())),
            ], names)

    names = ["doc_id", "n_shingles", "set_a", "set_b", "sketch", "keys"]
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, set_a long, set_b long, sketch binary, keys array<long>")


def _bucket_rows(nodes: DataFrame, limit: int) -> DataFrame:
    """(key, node, mate): members of buckets that may hold others, with their proposal."""

    def scan(batches: Iterator[pa.RecordBatch]):
        # rows carried over: the first row of the last bucket, the row before the last, the last one (not yet given out)
        key, node, sketch, done = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, SKETCH_BITS // 64), np.uint64), 0
        opening = True
        for last in _then_none(batches):
            if last is not None:
                if not last.num_rows:
                    continue
                key = np.concatenate([key, last.column(0).to_numpy()])
                node = np.concatenate([node, last.column(1).to_numpy()])
                sketch = np.concatenate([sketch, np.frombuffer(b"".join(last.column(2).to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)])
            m = len(key)
            if not m:
                return
            same = np.concatenate([[False], key[1:] == key[:-1]])  # as the row before
            start = np.maximum.accumulate(np.where(same, 0, np.arange(m)))
            upto = m if last is None else m - 1
            give = np.arange(done, upto)
            bits = lambda i, j: np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1)
            first, before = start[give], np.maximum(give - 1, 0)
            inside = same[give]
            near_first = inside & (bits(give, first) <= limit)
            near_before = inside & (bits(give, before) <= limit)
            mate = np.where(near_first, node[first], np.where(near_before, node[before], -1))
            more = np.concatenate([same[1:], [False]])[give]
            keep = inside | more
            if opening and len(give):
                keep[0], opening = True, False  # its bucket may go on in the task before
            if last is None and len(give):
                keep[-1] = True
            rows = give[keep]
            if len(rows):
                found = (near_first | near_before)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(node[rows]), pa.array(mate[keep], mask=~found)], ["key", "node", "mate"])
            carried = sorted({int(start[m - 1]), max(m - 2, 0), m - 1})
            done = len(carried) - 1
            key, node, sketch = key[carried], node[carried], sketch[carried]

    spark = nodes.sparkSession
    bounded_batches(spark, LIGHT_ROWS)
    rows = nodes.select(F.explode("keys").alias("key"), "node", "sketch")
    rows = rows.repartitionByRange(shuffle_parts(spark), "key", "node").sortWithinPartitions("key", "node")
    return rows.mapInArrow(scan, "key long, node long, mate long")


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """``a``, ``b``: sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or den * len(small) < num * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return den * both >= num * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The linked ones of ``pairs`` (u, v); ``texts``: (node, text)."""

    def check(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x, y = _sets(b.column(2).to_pylist(), k), _sets(b.column(3).to_pylist(), k)
            good = [i for i in range(b.num_rows) if linked(x[i], y[i], num, den)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good, pa.int32())), b.column(1).take(pa.array(good, pa.int32()))], ["u", "v"])

    bounded_batches(pairs.sparkSession)
    one = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
    two = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
    both = pairs.join(one, "u").join(two, "v").select("u", "v", "text_u", "text_v")
    return both.mapInArrow(check, "u long, v long")


def joining_links(
    node: np.ndarray, component: np.ndarray, sets: list[np.ndarray], side: np.ndarray, num: int, den: int
) -> list[tuple[int, int]]:
    """Links that join components of a bucket, none of them superfluous. ``side``:
    chunk of each member; members of one chunk aren't compared if there are two."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    node, component, side, size = node[order], component[order], side[order], size[order]
    sets = [sets[i] for i in order.tolist()]
    flat = mixed(np.concatenate(sets)) >> np.uint64(64 - SET_BITS.bit_length() + 1)
    sketch = parity(np.repeat(np.arange(len(sets)), size), flat.astype(np.int64), len(sets), SET_BITS).view(np.uint64)
    _, group = np.unique(component, return_inverse=True)
    two = side.min() != side.max()
    out = []
    for i in range(len(sets) - 1):
        end = np.searchsorted(size, size[i] * den / num + 1e-9, side="right")  # larger sets can't be linked
        j = np.arange(i + 1, end)
        j = j[(group[j] != group[i]) & ((side[j] != side[i]) | (not two))]
        if not len(j):
            continue
        apart = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1)
        fits = apart * (den + num) <= (size[j] + size[i]) * (den - num)  # what linked sets of these sizes differ in at most
        j = j[fits][np.argsort(apart[fits], kind="stable")]
        for x in j.tolist():
            if group[x] != group[i] and linked(sets[i], sets[x], num, den):
                out.append((int(node[i]), int(node[x])))
                group[group == group[x]] = group[i]
    return out


def _rest(buckets: DataFrame, labels: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links between components that share a bucket."""
    spark = buckets.sparkSession
    rows = buckets.select("key", "node").join(labels, "node", "left")
    rows = written(rows.select("key", "node", F.coalesce("component", "node").alias("component")), "bucket_rows")
    mixed_keys = (
        rows.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("a"), F.max("component").alias("b"))
        .where("a <> b").select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    )
    rows = rows.join(mixed_keys, "key")
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.withColumn("mine", mine).select("*", other.alias("other")).select(
        "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "node", "component", "mine"
    )
    rows = written(rows, "mixed_buckets")

    def as_set(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            sets = [s.tobytes() for s in _sets(b.column(1).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["of", "set"])

    bounded_batches(spark)
    wanted = small_side(written(rows.select("node").distinct(), "bucket_nodes"), FEW_IDS)
    sets = written(texts.join(wanted, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(as_set, "of long, set binary"), "bucket_sets")

    def compare(batches: Iterator[pa.RecordBatch]):
        at, held = None, []
        def links():
            if len(held) < 2:
                return
            n, c, m, s = zip(*held)
            found = joining_links(np.array(n), np.array(c), [np.frombuffer(x, np.uint64) for x in s], np.array(m), num, den)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(7)]
            for key, low, high, *member in zip(*columns):
                if (key, low, high) != at:
                    yield from links()
                    at, held = (key, low, high), []
                held.append(member)
        yield from links()

    bounded_batches(spark, 1024)
    joined = rows.join(sets, F.col("node") == F.col("of")).select("key", "low", "high", "node", "component", "mine", "set")
    joined = joined.repartition(shuffle_parts(spark), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return joined.mapInArrow(compare, "u long, v long")


def near_groups(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row a row of ``docs``."""
    signed = written(signatures(docs, k, doc_id, text), "signatures")
    sets = ["n_shingles", "set_a", "set_b"]
    nodes = written(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy(*sets)
        .agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")),
        "nodes",
    )
    buckets = written(_bucket_rows(nodes, most_bits(num, den)), "buckets")
    pairs = written(buckets.where("mate is not null").select(F.col("node").alias("u"), F.col("mate").alias("v")).distinct(), "pairs")
    ids = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).union(buckets.select("node")).distinct()
    wanted = small_side(written(ids, "wanted"), FEW_IDS)
    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    texts = texts.join(wanted, "node", "left_semi")
    links = written(_confirmed(pairs, texts, k, num, den), "near_links")
    labels = components(links)
    more = written(_rest(buckets, labels, texts, k, num, den), "more_links")
    labels = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    # rows of one set, and rows of one doc_id, meet in their node; the smallest doc_id reachable names the group
    own = nodes.select(*sets, "node").join(labels, "node", "left").select(
        *[F.col(c).alias(f"of_{c}") for c in sets], F.coalesce("component", "node").alias("component")
    )
    match = [F.col(c) == F.col(f"of_{c}") for c in sets]
    rows = signed.select("doc_id", *sets).join(own, match[0] & match[1] & match[2], "left")
    return rows.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without the documents whose group has a smaller doc_id; of rows with
    the same doc_id one stays. Rows with a null doc_id stay."""
    groups = near_groups(docs.select("doc_id", "text"), k, num, den)
    gone = written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(small_side(gone, FEW_IDS), "doc_id", "left_anti")
    repeated = groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = small_side(written(repeated, "repeated"), FEW_IDS)
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 85, 100)
    return groups.select("*", (F.col("doc_id") == F.col("component_id")).alias("kept"))
