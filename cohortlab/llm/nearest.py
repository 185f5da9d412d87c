"""Approximate nearest neighbours by shifted space-filling curves.

Each of CURVES curves projects the vectors to DIMS random orthonormal
directions, shifts them, and orders them by the Hilbert key of their cell on a
grid of 2^CELL_BITS a side. The vectors of all curves are dealt by range over
(curve, key) and sorted by Spark; a vector's place in a curve follows from its
place in its part and the sizes of the parts before. A query's candidates are
those at most ``window`` places away in some curve; windows of neighbouring
keys meet in blocks of PLACES places: a block's vectors are held, its queries
pass by QUERY_ROWS at a time and each keeps its nearest ids. Many queries of a
block are dealt to several tasks, each with the block's vectors. The curves'
lists are merged and ranked again by the distances of the original vectors.

The window is a share of all rows (``share``), so the recall is the same at any
size, and so is the share of all rows that a query is compared with: up to
CURVES * 2 * SHARE = 144 % counted with repeats, more than brute force; only
a smaller ``share`` saves distances. The rows that the blocks take in grow with the vectors and the queries, not with
their pairs. Equal vectors are one entry (named by a 64-bit hash), as queries
and as candidates: of each the smallest ids are kept, one more than asked for,
which is all that a query can return of them.

The grid's bounds come from a sample of at most FIT_ROWS vectors; every vector
is indexed, those outside the bounds at the border.

Cases. Vectors that are null, empty, zero, of another length than most, or hold
a null or non-finite number take no part, as queries or candidates, nor do rows
with a null id. With fewer candidates than asked for, all are returned. Ties go
to the smaller id. Rows that repeat an id and its vector count once; an id with
several vectors is a candidate, and a query, with the nearest pair of them. No rows: no rows. Other
columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, ordered, shuffle_parts, table, written

CURVES = 16
DIMS = 6
CELL_BITS = 10
SHARE = 0.045  # of all rows, to either side
LEAST_WINDOW = 64
PLACES = 2048  # of a curve in a block
MOST_QUERIES = 4096  # of a block in a task, about
QUERY_ROWS = 256  # compared with a block at once
FIT_ROWS = 20_000
SEED = 11
LIGHT_ROWS = 2048


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys (as 64-bit numbers) of cells (n, dims) with coordinates below 2^bits.

    The curve visits a cube's 2^dims parts in Gray-code order and turns inside
    each; from the coarsest bit on, a set bit mirrors the finer ones of the
    first axis and a clear one swaps them with it. bits * dims is at most 63.
    """
    x = [c.copy() for c in cells.astype(np.uint64).T]
    one, dims = np.uint64(1), len(x)
    for b in range(bits - 1, 0, -1):
        bit, fine = np.uint64(b), (one << np.uint64(b)) - one
        for i in range(dims):
            is_set = (x[i] >> bit) & one == one
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[i]) & fine)
            x[0] = np.where(is_set, x[0] ^ fine, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, dims):  # Gray code across the axes
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        is_set = (x[-1] >> np.uint64(b)) & one == one
        turn = np.where(is_set, turn ^ ((one << np.uint64(b)) - one), turn)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | (((x[i] ^ turn) >> np.uint64(b)) & one)
    return key


class Curves:
    """Projections, shifts and grid bounds; fitted on a sample."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        size = sample.shape[1]
        self.bits, self.dims = bits, min(dims, size)
        self.axes = np.stack([np.linalg.qr(rng.normal(size=(size, self.dims)))[0] for _ in range(curves)])
        seen = np.einsum("nd,cdk->cnk", sample.astype(np.float64), self.axes)
        self.low, high = np.quantile(seen, [0.001, 0.999], axis=1)
        self.span = np.maximum(high - self.low, 1e-12)
        self.shift = rng.uniform(0, 0.5, size=(curves, self.dims))  # of the grid, which is twice as wide

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(curves, n) keys."""
        out = []
        for axes, low, span, shift in zip(self.axes, self.low, self.span, self.shift):
            place = np.clip((vectors @ axes - low) / span, 0, 1) / 2 + shift
            cells = np.minimum((place * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1)
            out.append(hilbert(cells, self.bits).astype(np.int64))
        return np.stack(out)


def _as_bytes(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, raw): usable vectors as bytes, in double precision if they are given so."""
    double = dict(vectors.dtypes)[vector] == "array<double>"
    kind = "double" if double else "float"

    def pack(batches: Iterator[pa.RecordBatch]):
        to = np.float64 if double else np.float32
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is None or not v or any(x is None for x in v):
                    continue
                a = np.array(v, to)
                if np.isfinite(a).all() and a.any():
                    ids.append(i)
                    out.append((a + 0).tobytes())  # -0 is 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "raw"])

    bounded_batches(vectors.sparkSession, LIGHT_ROWS)
    rows = vectors.select(F.col(vec_id).cast("long"), F.col(vector).cast(f"array<{kind}>")).mapInArrow(pack, "id long, raw binary")
    rows = written(rows.withColumn("double", F.lit(double)), "vectors")
    sizes = rows.groupBy(F.octet_length("raw").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows if sizes is None else rows.where(F.octet_length("raw") == sizes["size"])


def _least(query: np.ndarray, d: np.ndarray, x: np.ndarray, ids: list[list[int]], most: int) -> list[tuple[int, float]]:
    """(id, score) of the ``most`` nearest ids (the query's own may be among them).

    ``d``: squared distances to the rows of ``x``, infinite outside the window.
    Several rows may hold the same id, so rows are taken until there are enough ids.
    """
    inside, take = int(np.isfinite(d).sum()), most
    while inside:
        take = min(take, inside)
        rows = np.flatnonzero((d <= np.partition(d, take - 1)[take - 1] + 1e-9) & np.isfinite(d))
        best: dict[int, float] = {}
        for r, score in zip(rows.tolist(), np.sqrt(((query - x[rows]) ** 2).sum(1)).tolist()):
            for i in ids[r]:
                best[i] = min(score, best.get(i, score))
        if len(best) >= most or take == inside:
            return sorted(best.items(), key=lambda r: (r[1], r[0]))[:most]
        take *= 2
    return []


def query_slices(asked: int, total: int, window: int) -> int:
    """So many tasks share a block's queries that one gets about MOST_QUERIES."""
    return max(1, math.ceil(asked * min(1.0, (PLACES + 2 * window) / total) / MOST_QUERIES))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE, curves: int = CURVES,
    vec_id: str = "vec_id", vector: str = "embedding", seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the ids in ``queries`` (a column ``query_id``)."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = _as_bytes(vectors, vec_id, vector)
    rows = rows.withColumn("entry", F.xxhash64("raw")).distinct()
    first = Window.partitionBy("entry").orderBy("id")
    kept = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)  # limited before the shuffle
    asked = rows.join(queries.select(F.col("query_id").alias("id")).distinct(), "id").select(F.col("id").alias("query_id"), "entry")
    asked = written(asked, "queries")
    entries = kept.groupBy("entry").agg(F.first("raw").alias("raw"), F.array_sort(F.collect_list("id")).alias("ids"))
    flags = asked.select("entry", F.lit(True).alias("asked")).distinct()
    entries = written(entries.join(flags, "entry", "left"), "entries")
    total = entries.count()
    if not total:
        return spark.createDataFrame([], result)
    double = rows.select("double").first()[0]
    to = np.float64 if double else np.float32
    sample = [np.frombuffer(r["raw"], to) for r in entries.orderBy("entry").select("raw").limit(FIT_ROWS if total > FIT_ROWS else total).toLocalIterator()]
    fitted = Curves(np.stack(sample), curves, DIMS, CELL_BITS, seed)
    window = max(LEAST_WINDOW, round(share * total))

    def index(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                keys = fitted.keys(np.frombuffer(b"".join(b.column(1).to_pylist()), to).reshape(b.num_rows, -1).astype(np.float64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.arange(len(keys)), b.num_rows).astype(np.int32)), pa.array(keys.ravel()),
                    pa.array(np.tile(b.column(0).to_numpy(), len(keys))),
                ], ["curve", "key", "entry"])

    bounded_batches(spark, LIGHT_ROWS)
    keyed = entries.select("entry", "raw").mapInArrow(index, "curve int, key long, entry long")
    parts = shuffle_parts(spark)
    placed, before = ordered(keyed, [F.col("curve"), F.col("key"), F.col("entry")], "curve_places", parts)
    ahead = F.element_at(F.create_map(*[F.lit(x) for p in before.items() for x in p]), F.col("part"))
    placed = placed.select("curve", "entry", (ahead + F.col("row") - F.col("curve") * F.lit(total)).alias("place"))

    # every entry once a curve and slice; a query once for each block that its window touches, in one slice
    blocks = (F.lit(total) - 1) / PLACES
    slices = query_slices(flags.count(), total, window)
    located = entries.join(placed, "entry")
    candidate = located.select(
        "curve", F.floor(F.col("place") / PLACES).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"),
        F.lit(0).alias("kind"), "place", "raw", "ids", "entry",
    )
    near = F.sequence(
        F.floor(F.greatest(F.col("place") - window, F.lit(0)) / PLACES),
        F.floor(F.least((F.col("place") + window) / PLACES, blocks)),
    )
    query = located.where("asked").select(
        "curve", F.explode(near).alias("block"), F.pmod("entry", F.lit(slices).cast("long")).alias("slice"),
        F.lit(1).alias("kind"), "place", "raw", F.lit(None).cast("array<long>").alias("ids"), "entry",
    )

    def compare(batches: Iterator[pa.RecordBatch]):
        vectors_of = lambda raws: np.frombuffer(b"".join(raws), to).reshape(len(raws), -1).astype(np.float64)
        at, places, raws, ids, x = None, [], [], [], None
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            edges = [0, *[i for i in range(1, b.num_rows) if tuple(c[i] for c in columns[:4]) != tuple(c[i - 1] for c in columns[:4])], b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                here = tuple(c[lo] for c in columns[:3])
                if here != at:
                    at, places, raws, ids, x = here, [], [], [], None
                if columns[3][lo] == 0:  # a block's own vectors come first, at most PLACES
                    places += columns[4][lo:hi]
                    raws += columns[5][lo:hi]
                    ids += columns[6][lo:hi]
                    continue
                if x is None:
                    x, own = vectors_of(raws), np.array(places)
                for start in range(lo, hi, QUERY_ROWS):
                    end = min(hi, start + QUERY_ROWS)
                    asked_vectors = vectors_of(columns[5][start:end])
                    d = (asked_vectors**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * asked_vectors @ x.T
                    d[np.abs(np.array(columns[4][start:end])[:, None] - own[None, :]) > window] = np.inf
                    out = [(e, v, s) for e, q, row in zip(columns[7][start:end], asked_vectors, d) for v, s in _least(q, row, x, ids, k + 1)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["entry", "vec_id", "score"])

    blocked = candidate.unionByName(query)
    blocked = blocked.repartition(parts, "curve", "block", "slice").sortWithinPartitions("curve", "block", "slice", "kind")
    found = blocked.mapInArrow(compare, "entry long, vec_id long, score double")
    found = found.groupBy("entry", "vec_id").agg(F.min("score").alias("score"))  # an id counts once, with its nearest vector
    few = Window.partitionBy("entry").orderBy("score", "vec_id")
    found = found.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        asked.join(found, "entry").where("vec_id <> query_id")
        .groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op1_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id")))
