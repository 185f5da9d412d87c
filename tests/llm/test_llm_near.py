"""Near-duplicates, components and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import near_dedup, shingles, simhash
from cohortlab.llm.components import components
from llm_data import documents, frame, ordered, rows_of, stored, words


def word_list(text):
    table = {c: c + 32 for c in range(65, 91)}
    return [w.translate(table) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingle_set(text, k):
    w = word_list(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if None in (rows[i][0], rows[j][0]):
                continue
            if same and a and b or a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d) if d is not None else None
    return [(None if d is None else least[find(i)], d, len(sets[i])) for i, (d, _) in enumerate(rows)]


def near_copies(seed=2):
    """Copies of one text with few changes, so that many are linked only through others."""
    rng = random.Random(seed)
    base = words(rng, 150).split(" ")
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = f"w{rng.random()}"
        rows.append((1000 - 3 * i, " ".join(t)))
    return rows


def test_shingle_hashes_equal_where_shingles_do():
    rows = [r[1] or "" for r in documents()]
    for k in (1, 3, 5):
        for piece in (shingles.PIECE, 64):
            before, shingles.PIECE = shingles.PIECE, piece
            try:
                h, at = shingles.shingle_hashes([t.encode() for t in rows], k)
            finally:
                shingles.PIECE = before
            seen = {}
            for i, t in enumerate(rows):
                own = h[at[i] : at[i + 1]].tolist()
                assert len(set(own)) == len(shingle_set(t, k)), (k, i)
                w = word_list(t)
                full = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else [])
                assert len(full) == len(own)
                for a, b in zip(full, own):
                    assert seen.setdefault(a, b) == b


@pytest.mark.parametrize("k, num", [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, k, num):
    rows = [(r[0], r[1]) for r in documents()] + near_copies()
    got = near_dedup.near_groups(frame(spark, rows, "doc_id long, text string"), k, num, 100)
    assert rows_of(got) == ordered(brute(rows, k, num, 100))


def test_large_buckets_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    monkeypatch.setattr(near_dedup, "most_bits", lambda num, den: -1)  # nothing is proposed: the last step does it all
    rows = near_copies(5)
    got = near_dedup.near_groups(frame(spark, rows, "doc_id long, text string"), 3, 85, 100)
    assert rows_of(got) == ordered(brute(rows, 3, 85, 100))


def test_one_of_each_and_empty(spark, tmp_path):
    docs = frame(spark, documents())
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = brute([(r[0], r[1]) for r in documents()], 5, 80, 100)
    want = sorted({d for c, d, _ in groups if d is not None and c == d})
    got = [r.doc_id for r in kept.collect()]
    assert sorted(d for d in got if d is not None) == want and got.count(None) == 2
    empty = stored(spark, tmp_path, documents=docs.where("false"))
    assert near_dedup.op7_near_dedup(spark, empty).count() == 0 and simhash.op4_simhash(spark, empty).count() == 0


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(3)
    for share in (0.95, 0.85, 0.7):
        errors = []
        for _ in range(40):
            n = 2000
            both = int(2 * n * share / (1 + share))
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
            true = both / (2 * n - both)
            s = near_dedup.odd_sketches(near_dedup.samples([a, b]))
            errors.append(near_dedup.similarity(int(np.bitwise_count(s[0] ^ s[1]).sum())) - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(200)] + [(5000, 4999), (7, 7), (4999, 5000)]
    got = {r.node: r.component for r in components(frame(spark, links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)} | {5000: 4999}
    assert components(frame(spark, [], "u long, v long")).count() == 0


def test_fingerprints_of_texts_and_their_edits(spark, tmp_path):
    docs = frame(spark, documents())
    got = simhash.op4_simhash(spark, stored(spark, tmp_path, documents=docs))
    rows = sorted(((r[0], r[1] or "") for r in documents()), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    want = []
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        changed = t[: len(t) - half] + n[:half]
        own, other, nxt = (simhash.fingerprints([x])[0] for x in (t, changed, n))
        near = [max(0.0, round(float(np.cos(np.pi * np.unpackbits(own ^ x).sum() / 256)), 9)) for x in (other, nxt)]
        want.append((d, hashlib.sha256(changed.encode()).hexdigest(), other.tobytes().hex(), own.tobytes().hex(), len(t), *near))
    columns = ["doc_id", "edited_sha256", "edited_fingerprint", "fingerprint", "n_chars", "near_edited", "near_next"]
    assert ordered([tuple(r) for r in got.select(columns).collect()]) == ordered(want)
    assert len({w[3] for w in want}) < len(want)  # equal texts, equal fingerprints


def test_single_row_is_its_own_next(spark, tmp_path):
    one = stored(spark, tmp_path, documents=frame(spark, [(5, "a b c d e f g h", "x")], "doc_id long, text string, fingerprint string"))
    row = simhash.op4_simhash(spark, one).first()
    assert row.near_next == 1.0 and row.n_chars == 15


@pytest.mark.parametrize("radius", [0, 3, 7])
def test_radius_search_finds_all(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 256, (20, 32), dtype=np.uint8)
    rows = []
    for b in base:
        for _ in range(12):
            bits = np.unpackbits(b)
            bits[rng.choice(256, rng.integers(0, 11), replace=False)] ^= 1
            rows.append(np.packbits(bits).tobytes().hex())
    rows += rows[:5] + [None]
    entries = frame(spark, [(r,) for r in rows], "fingerprint string")
    asked = [r for i, r in enumerate(rows) if i % 7 == 0]
    got = simhash.within_radius(entries, frame(spark, [(r,) for r in asked], "fingerprint string"), radius)
    want = []
    full = [r for r in rows if r]
    for q in {a for a in asked if a}:
        for e in set(full):
            d = (int(q, 16) ^ int(e, 16)).bit_count()
            if d <= radius:
                want.append((d, e, full.count(e), q))
    assert rows_of(got) == ordered(want)


def test_radius_search_deals_out_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 20)
    rng = np.random.default_rng(9)
    rows = sorted({"ab" * 8 + rng.integers(0, 256, 24, dtype=np.uint8).tobytes().hex() for _ in range(300)})  # one block value
    rows += [r[:-1] + ("0" if r[-1] != "0" else "1") for r in rows[:40]]
    entries = frame(spark, [(r,) for r in rows], "fingerprint string")
    asked = rows[:60]
    got = simhash.within_radius(entries, frame(spark, [(r,) for r in asked], "fingerprint string"), 3)
    pairs = [((int(q, 16) ^ int(e, 16)).bit_count(), e, 1, q) for q in asked for e in rows]
    assert rows_of(got) == ordered([p for p in pairs if p[0] <= 3])
    table_of = entries.select(F.lit(0).alias("block"), F.lit("ab").alias("value"), "fingerprint", F.lit(1).cast("long").alias("n"))
    sides = simhash.dealt(table_of, frame(spark, [(0, "ab", "q")], "block int, value string, query string")).collect()
    salts = [r.salt for r in sides if r.kind == 0]
    assert len(salts) == len(rows) and max(map(salts.count, salts)) < 50  # 17 salts of 20
    assert sorted(r.salt for r in sides if r.kind == 1) == list(range(17))
