"""Toxicity by maximum-scoring segments of token log-odds.

Words are runs of letters, lower-cased; a word's tokens are the word itself and
its first 4, 5 and 6 bytes, so stems count whatever the ending. A token's
log-odds between toxic and clean documents are estimated with an informative
Dirichlet prior: every class starts with PRIOR * (clean words) pseudo-tokens,
spread as the tokens of all documents are. With q and p the smoothed shares of
a token in the two classes, the score of a marked token is log(q / p); marked
are those whose log-odds are at least LEAST_ODDS and LEAST_Z standard errors. A
word has the highest score of its marked tokens; words without any share
log((1 - sum q) / (1 - sum p)), which is below 0.

All maximal scoring segments of a text (those that can't be extended or
shortened to a higher score, in disjoint runs) are found in one pass over its
marked words with a stack. Scores are log-likelihood ratios, so in a clean
text of n words the number of segments of score S or more is about
K * n * exp(-S) by extreme-value theory; K is fitted to clean documents.
A segment is a significant passage if that number is below ``LEAST_EVALUE``;
a document's surprise is -log of the chance of its significant segments, and
two numbers turn it into a probability (logistic regression on the fit rows).

Labels come only from documents whose crc32(doc_id as text) mod 5 isn't 0, and
of these a sample of FIT_ROWS distinct texts, the ones with the least hashes of
doc_id, bounds what is fitted and broadcast. Prior counts cover all documents.

Cases. Null, empty and token-free texts: no segments, the lowest score. A
doc_id with several labels counts as toxic if any says so; null labels don't
count. Without toxic or without clean rows there are no marked tokens, and all
scores are the toxic share (0 without labels). Repeated rows give repeated
results; a null doc_id is scored like any other and isn't held out.
No rows: no rows. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table, written
from .shingles import mixed, word_hashes

FIT_ROWS = 50_000
PRIOR = 0.1
LEAST_ODDS = 2.0
LEAST_Z = 2.5
STEMS = (0, 4, 5, 6)  # bytes of a word that are a token; 0: all
LEAST_TEXTS = 3  # toxic texts that a marked token is in
LEAST_EVALUE = 0.05


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    tokens: np.ndarray  # hashes of the marked tokens, sorted
    scores: np.ndarray
    drift: float  # score of a word without any
    k: float
    weight: tuple[float, float]  # logistic regression on the surprise

    def probability(self, surprise: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weight[0] + self.weight[1] * surprise, -30, 30)))


def segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence whose entries
    are ``scores`` at ``places`` (ascending) and ``drift`` (below 0) elsewhere."""
    stack: list[list] = []  # first, last, sum before, sum up to the end, the nearest earlier entry with a smaller sum before
    total, at = 0.0, -1
    for place, score in zip(places, scores):
        before = total + (place - at - 1) * drift
        total, at = before + score, place
        new = [place, place, before, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new[0], new[2] = stack[j][0], stack[j][2]  # join with all from j on
            del stack[j:]
    return [(s[0], s[1], s[3] - s[2]) for s in stack]


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a row of hashes for each of ``STEMS``, where each text's words begin)."""
    texts = [(t or "").encode() for t in column.to_pylist()]
    rows = [word_hashes(texts, letters=True, first=n) for n in STEMS]
    return np.stack([mixed(h + np.uint64(n)) for (h, _), n in zip(rows, STEMS)]), rows[0][1]


def _marked(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of known tokens, and which they are."""
    if not len(known) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    hit = np.flatnonzero(known[at] == hashes)
    return hit, at[hit]


def text_segments(hashes: np.ndarray, at: np.ndarray, m: Model) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(number of words, segments) of each text."""
    best = np.full(hashes.shape[1], -np.inf)
    for h in hashes:
        hit, which = _marked(h, m.tokens)
        best[hit] = np.maximum(best[hit], m.scores[which])
    hit = np.flatnonzero(best > -np.inf)
    cut = np.searchsorted(hit, at)
    places, scores = hit.tolist(), best[hit].tolist()
    for i in range(len(at) - 1):
        a, b = int(cut[i]), int(cut[i + 1])
        begin = int(at[i])
        yield int(at[i + 1]) - begin, segments([p - begin for p in places[a:b]], scores[a:b], m.drift) if b > a else []


def surprise(n: int, found: list[tuple[int, int, float]], k: float) -> float:
    """-log of the chance of segments like the significant ones in a clean text, summed."""
    total = 0.0
    for _, _, s in found:
        expected = math.log(k * max(n, 1)) - s
        if expected < math.log(LEAST_EVALUE):
            total -= expected  # log(1 - exp(-E)) is log(E) for small E
    return total


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope, with a weak pull of both towards 0."""
    w, design = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _counts(docs: DataFrame, known: np.ndarray | None, by_text: bool = False) -> dict[int, list[int]]:
    """Tokens of ``docs`` (text): for each hash its number and the texts it is in;
    at -1 the number of words. ``known``: the hashes to count; None counts all."""

    def count(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows, at = _tokens(b.column(0))
            own, all_of = np.tile(np.repeat(np.arange(b.num_rows), np.diff(at)), len(STEMS)), rows.shape[1]
            h = rows.ravel()
            if known is not None:
                hit, _ = _marked(h, known)
                h, own = h[hit], own[hit]
            order = np.lexsort((own, h))
            h, own = h[order], own[order]
            values, first, n = np.unique(h, return_index=True, return_counts=True)
            new = np.concatenate([[1], ((h[1:] != h[:-1]) | (own[1:] != own[:-1])).astype(np.int64)]) if len(h) else np.zeros(0, np.int64)
            texts = np.add.reduceat(new, first) if len(h) else new
            yield pa.RecordBatch.from_arrays(
                [pa.array([True] + [False] * len(values)), pa.array(np.append(0, values.view(np.int64))), pa.array(np.append(all_of, n)), pa.array(np.append(0, texts))],
                ["total", "token", "n", "texts"],
            )

    bounded_batches(docs.sparkSession, 128)
    rows = docs.select("text").mapInArrow(count, "total boolean, token long, n long, texts long")
    rows = rows.groupBy("total", "token").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    if by_text:
        rows = rows.where(F.col("total") | (F.col("texts") >= LEAST_TEXTS))
    return {(-1 if r["total"] else r["token"] % (1 << 64)): [r["n"], r["texts"]] for r in rows.collect()}


def fit_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of the fit sample."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = F.broadcast(written(sample, "fit_sample"))  # ``rows`` rows at most
    found = docs.select("doc_id", "text").join(sample, "doc_id")
    ids = found.groupBy(F.xxhash64("text").alias("of")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "toxic")
    one = F.broadcast(written(ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "fit_texts"))
    return written(docs.select("doc_id", F.col("text")).join(one, "doc_id").select("text", "toxic"), "fit_rows")


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    sample = fit_rows(docs, labels, rows)
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    in_toxic = _counts(toxic, None, by_text=True)
    known = np.array(sorted(h for h in in_toxic if h != -1), np.uint64)
    in_clean, in_all = _counts(clean, known), _counts(docs, known)
    zero = [0, 0]
    n_t, n_c, n_a = (c.get(-1, zero)[0] for c in (in_toxic, in_clean, in_all))
    prior = PRIOR * n_c
    y_t, y_c, y_a = (np.array([c.get(int(h), zero)[0] for h in known], np.float64) for c in (in_toxic, in_clean, in_all))
    alpha = prior * y_a / max(n_a, 1) + 1e-9
    q, p = (y_t + alpha) / (n_t + prior + 1e-9), (y_c + alpha) / (n_c + prior + 1e-9)
    odds = np.log(q) - np.log(p)
    z = odds / np.sqrt(1 / (y_t + alpha) + 1 / (y_c + alpha))
    keep = (odds >= LEAST_ODDS) & (z >= LEAST_Z) if n_c else np.zeros(len(known), bool)
    # each word has len(STEMS) tokens, so the sums are shares of words at most this often
    drift = math.log1p(-min(q[keep].sum() / len(STEMS), 0.5)) - math.log1p(-min(p[keep].sum() / len(STEMS), 0.5)) if keep.any() else -1e-3
    m = Model(known[keep], odds[keep], min(drift, -1e-6), 1.0, (0.0, 0.0))
    bounded_batches(docs.sparkSession)
    n_rows = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not keep.any() or len(n_rows) < 2:
        share = (n_rows.get(1, 0) / sum(n_rows.values())) if n_rows else 0.0
        m.weight = (math.log(share / (1 - share)) if 0 < share < 1 else (-30.0 if share == 0 else 30.0), 0.0)
        return m

    def measure(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            found = list(text_segments(*_tokens(b.column(0)), m))
            yield pa.RecordBatch.from_arrays([
                b.column(1).cast(pa.int32()), pa.array([n for n, _ in found], pa.int64()),
                pa.array([[s for _, _, s in x] for _, x in found], pa.list_(pa.float64())),
            ], ["toxic", "n", "scores"])

    # at most ``rows`` rows
    seen = [(r["toxic"], r["n"], r["scores"]) for r in sample.select("text", "toxic").mapInArrow(measure, "toxic int, n long, scores array<double>").collect()]
    clean_scores = [s for t, _, x in seen if t == 0 for s in x]
    # segments that clean documents have, against those expected at K = 1; half a segment is added
    expected = sum(n for t, n, _ in seen if t == 0) * math.exp(-float(m.scores.min()))
    m.k = (len(clean_scores) + 0.5) / max(expected, 1e-9)
    x = np.array([surprise(n, [(0, 0, s) for s in scores], m.k) for _, n, scores in seen])
    m.weight = _logistic(np.minimum(x, 100.0), np.array([t for t, _, _ in seen], np.float64))
    return m


def passages(docs: DataFrame, m: Model) -> DataFrame:
    """``docs`` (all their columns) as ``doc``, with ``score`` and the significant
    ``passages``: first and last token, log-odds, expected number by chance."""
    of = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("evalue", pa.float64())]))
    names = docs.columns
    place = names.index("text")
    longest = "_" * (max(map(len, names)) + 1)  # no column is named so
    own = [f"{longest}score", f"{longest}passages"]

    def score(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            found = list(text_segments(*_tokens(b.column(place)), m))
            x = np.minimum(np.array([surprise(n, s, m.k) for n, s in found], np.float64), 100.0)
            good = [
                [{"first": a, "last": z, "score": s, "evalue": m.k * max(n, 1) * math.exp(-s)} for a, z, s in x if m.k * max(n, 1) * math.exp(-s) < LEAST_EVALUE]
                for n, x in found
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.probability(x)), pa.array(good, of)], [*names, *own])

    bounded_batches(docs.sparkSession)
    passage = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("evalue", T.DoubleType())])
    kind = T.StructType([*docs.schema.fields, T.StructField(own[0], T.DoubleType()), T.StructField(own[1], T.ArrayType(passage))])
    doc = F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")
    return docs.mapInArrow(score, kind).select(doc, F.col(own[0]).alias("score"), F.col(own[1]).alias("passages"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return passages(docs, m).select(
        "doc.doc_id", held_out("doc.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )
