"""Nearest neighbours, toxicity, WARC archives and the pipeline."""

from __future__ import annotations

import gzip
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import byte_bpe, line_dedup, mixing, near_dedup, nearest, toxicity, warc
from cohortlab.llm.common import table, written
from llm_data import DOCUMENTS, answers, documents, frame, ordered, rows_of, stored

VECTORS = "vec_id long, embedding array<float>, label int, entry string"


def vectors() -> list[tuple]:
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)).astype(np.float32).tolist()
    rows = [(i, v, 1, "e") for i, v in enumerate(x)]
    rows += [(1000 + i, x[0], None, None) for i in range(60)] + [(0, x[0], 1, "e")]  # many copies of a query, and itself again
    rows += [(2000, None, 1, ""), (2100, [], 1, ""), (2200, [0.0] * 8, 1, ""), (2300, [1.0, float("nan")] + [1.0] * 6, 1, ""),
             (2400, [1.0] * 7, 1, ""), (2500, [None] + [1.0] * 7, 1, ""), (2600, [float("inf")] + [1.0] * 7, 1, ""), (None, x[3], 1, "")]
    return rows


def brute_nearest(rows, k=10):
    good = sorted({(i, tuple(v)) for i, v, *_ in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)})
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], np.float32).astype(float)
    out = []
    for q in sorted({i for i in ids.tolist() if i % 100 == 0}):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = sorted((float(a), int(b)) for a, b in zip(d, ids) if b != q)[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return out


def test_nearest_is_exact_when_the_window_covers_all(spark, tmp_path):
    rows = vectors()
    df = frame(spark, rows, VECTORS)
    queries = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    got = sorted(tuple(r) for r in nearest.nearest(df, queries, share=1.0, curves=2).collect())
    want = brute_nearest(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)
    few = df.where("vec_id in (0, 5, 7)")
    assert nearest.nearest(few, queries).where("query_id = 0").count() == 2
    none = stored(spark, tmp_path, embeddings=df.where("false"))
    assert nearest.op1_nearest(spark, none).count() == 0


def test_nearest_recall_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.query_id, r.vec_id) for r in nearest.op1_nearest(spark, sf).collect()}
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    want = set()
    for q in ids[ids % 100 == 0]:
        d = ((x - x[ids == q]) ** 2).sum(1)
        want |= {(int(q), int(i)) for i in ids[np.lexsort((ids, d))] if i != q} & {(int(q), int(i)) for i in ids[np.lexsort((ids, d))][:11]}
    assert len(got & want) >= 0.9 * len(want)


def test_an_id_with_several_vectors_takes_one_place(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v, 1, "e") for i, v in enumerate(rng.normal(size=(300, 8)).astype(np.float32).tolist())]
    near = (np.array(rows[0][1]) + rng.normal(scale=1e-3, size=(40, 8))).astype(np.float32).tolist()
    rows += [(500, v, 1, "e") for v in near[:25]] + [(0, v, 1, "e") for v in near[25:]]  # another id's, and the query's own
    df = frame(spark, rows, VECTORS)
    got = sorted(tuple(r) for r in nearest.nearest(df, df.select(F.lit(0).cast("long").alias("query_id")), share=1.0, curves=2).collect())
    own = np.array([v for i, v, *_ in rows if i == 0], np.float32).astype(float)
    least: dict[int, float] = {}
    for i, v, *_ in rows:
        if i:
            score = float(np.sqrt(((own - np.array(v, np.float32).astype(float)) ** 2).sum(1)).min())
            least[i] = min(score, least.get(i, score))
    want = sorted((s, i) for i, s in least.items())[:10]
    assert [g[:3] for g in got] == [(0, r + 1, i) for r, (_, i) in enumerate(want)]
    assert np.allclose([g[3] for g in got], [s for s, _ in want], rtol=0, atol=1e-12)


def test_queries_of_a_block_in_slices(spark, monkeypatch):
    rows = vectors()
    df = frame(spark, rows, VECTORS)
    queries = df.select(F.col("vec_id").alias("query_id"))
    ask = lambda: rows_of(nearest.nearest(df, queries, share=1.0, curves=2))
    whole = ask()
    monkeypatch.setattr(nearest, "MOST_QUERIES", 50)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 7)
    assert nearest.query_slices(400, 400, 400) == 8 and ask() == whole
    want = {(q, r, i) for q, r, i, _ in brute_nearest(rows)}
    assert want <= {(q, r, i) for q, r, _, i in whole}  # columns by name: query_id, rank, score, vec_id


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_keys_step_to_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = nearest.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def brute_segments(x):
    """Best segment, then the same left and right of it (shorter ones first among equals)."""
    best = max(((sum(x[i : j + 1]), i - j, -i, (i, j)) for i in range(len(x)) for j in range(i, len(x))), default=None)
    if best is None or best[0] <= 0:
        return []
    i, j = best[3]
    left, right = brute_segments(x[:i]), brute_segments(x[j + 1 :])
    return [*left, (i, j), *[(a + j + 1, b + j + 1) for a, b in right]]


def test_segments_equal_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(0, 25)
        places = sorted(rng.sample(range(n), rng.randint(0, n)))
        scores = [rng.uniform(0.1, 3) for _ in places]
        x = [-0.7001] * n
        for p, s in zip(places, scores):
            x[p] = s
        got = toxicity.segments(places, scores, -0.7001)
        assert [g[:2] for g in got] == brute_segments(x)
        for a, b, s in got:
            assert math.isclose(s, sum(x[a : b + 1]), abs_tol=1e-9)


def test_toxicity_learns_and_ignores_held_out_labels(spark, tmp_path):
    rng = random.Random(8)
    plain, bad, stems = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300)], ["grub", "snarl", "fleck"], ["zorbl"]
    rows, labels = [], []
    for i in range(600):
        t = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(bad) if i % 12 else stems[0] + "".join(rng.choice("aeiou") for _ in range(3)))
        rows.append((i, " ".join(t), None, None, None, 0, "", "", 0))
        labels.append((i, 1, int(toxic)))
    labels += [(3, 1, None), (None, 1, 1), (99_999, 1, 1)]
    docs = frame(spark, rows + documents(9)[:5])
    docs = docs.where("doc_id is not null")
    lab = frame(spark, labels, "doc_id long, quality int, toxic int")
    out = toxicity.op8_toxicity(spark, stored(spark, tmp_path / "a", documents=docs, labels=lab)).collect()
    truth = {i: t for i, _, t in labels if t is not None}
    held = [r for r in out if r.held_out and r.doc_id in truth and r.doc_id % 10]
    assert len(held) > 80
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    flipped = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.op8_toxicity(spark, stored(spark, tmp_path / "b", documents=docs, labels=flipped))
    assert rows_of(again) == ordered([tuple(r[c] for c in sorted(again.columns)) for r in out])
    none = toxicity.op8_toxicity(spark, stored(spark, tmp_path / "c", documents=docs, labels=lab.where("false")))
    assert {r.predicted for r in none.collect()} == {0}
    assert toxicity.op8_toxicity(spark, stored(spark, tmp_path / "d", documents=docs.where("false"), labels=lab)).count() == 0


PAGES = "page_id long, url string, html string, piece string, file string"


def pages() -> list[tuple]:
    rng = random.Random(2)
    noise = "".join(chr(rng.randint(0x100, 0x2FFF)) for _ in range(40_000))
    rows = [(i, f"http://x/{i}", f"<p>{i % 40}</p>" + "é" * (i % 7), "", "") for i in range(200)]
    rows += [(500, "http://a b\r\nc", None, "", ""), (501, None, "", "", ""), (502, "u", noise, "", ""), (503, "u", noise, "", "")]
    return rows + [(None, "u", noise, None, None), (None, None, "alone", "", ""), rows[3], (199, "u", f"<p>39</p>{'é' * 3}", "", "")]


def test_warc_on_awkward_pages_and_tiny_ranges(spark, tmp_path):
    df = frame(spark, pages(), PAGES)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = rows_of(warc.op10_warc_roundtrip(spark, stored(spark, tmp_path / "a", pages=df)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == answers(warc.OP10_SQL, pages=df)
    assert warc.op10_warc_roundtrip(spark, stored(spark, tmp_path / "b", pages=df.where("false"))).count() == 0


def test_archives_are_gzip_files_and_damage_is_reported(spark, tmp_path):
    warc.write_archives(frame(spark, pages()[:20], PAGES), str(tmp_path / "w"))
    files = sorted((tmp_path / "w").glob("part-*"))
    raw = [gzip.decompress(f.read_bytes()) for f in files]
    assert sum(x.count(b"WARC-Type: response") + x.count(b"WARC-Type: revisit") for x in raw) == 20
    whole = files[0].read_bytes()
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/x").write_bytes(b"junk" + whole[: len(whole) // 2])
    kinds = [r.warc_type for r in warc.read_archives(spark, str(tmp_path / "broken")).collect()]
    assert "damaged" in kinds and "warcinfo" in kinds


def test_a_magic_inside_a_member_does_not_begin_one(spark, tmp_path):
    """Members stored uncompressed whose payload holds the magic, in ranges that begin there."""
    inner = b"x" * 300 + warc.MAGIC + b"y" * 50 + warc.MAGIC + b"z" * 300
    out = b""
    for i in range(40):
        http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner
        head = b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: %d\r\nContent-Length: %d\r\n\r\n" % (i, len(http))
        z = zlib.compressobj(0, zlib.DEFLATED, 31)
        out += z.compress(head + http + b"\r\n\r\n") + z.flush()
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.warc.gz.txt").write_bytes(out)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in ("311", "640", "5000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = warc.read_archives(spark, str(tmp_path / "a")).collect()
            assert sorted(r.page_id for r in rows) == list(range(40)), size
            assert {(r.warc_type, r.payload_bytes, r.payload_digest) for r in rows} == {("response", len(inner), warc.digest32(inner))}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pipeline_stage_by_stage(spark):
    """Each stage against the plain form of what it decides, on its own input."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    steps = dict(p.STAGES)
    assert [k for k, _ in p.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "byte_bpe"]
    a = written(steps["toxicity"](spark, docs, sf), "t1")
    scored = {r.doc_id: r.predicted for r in toxicity.op8_toxicity(spark, sf).collect()}
    assert rows_of(a) == rows_of(docs.where(F.col("doc_id").isin([d for d, x in scored.items() if not x])))
    b = written(steps["line_dedup"](spark, a, sf), "t2")
    want = answers(line_dedup.OP2_SQL, documents=a)
    assert sorted((r.doc_id, r.text) for r in b.collect()) == sorted((r[0], r[3]) for r in want)
    assert b.columns == docs.columns and b.where("n_chars <> char_length(text)").count() == a.where("n_chars <> char_length(text)").count()
    c = written(steps["near_dedup"](spark, b, sf), "t3")
    from test_llm_near import brute

    kept = {d for x, d, _ in brute([(r.doc_id, r.text) for r in b.collect()], 5, 80, 100) if x == d}
    assert sorted(r.doc_id for r in c.collect()) == sorted(kept)
    d = written(steps["mixing"](spark, c, sf), "t4")
    taken = {r[0]: r[4] // r[1] if r[1] else 0 for r in [(x[0], x[1], x[2], x[4], x[3]) for x in answers(mixing.OP3_SQL, documents=c)]}
    copies = {r.doc_id: r["count"] for r in d.groupBy("doc_id").count().collect()}
    assert copies == {k: n for k, n in taken.items() if n}
    e = steps["byte_bpe"](spark, d, sf)
    assert e.count() == d.count() and e.where("not whole").count() == 0
    run = p.run(spark, sf)
    assert rows_of(run.select("doc_id", "n_tokens")) == rows_of(e.select("doc_id", "n_tokens"))


def test_pipeline_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline as p

    docs = frame(spark, documents())
    lab = frame(spark, [(r[0], 1, i % 2) for i, r in enumerate(documents())], "doc_id long, quality int, toxic int")
    for name, df in (("a", docs), ("b", docs.where("false"))):
        sf = stored(spark, tmp_path / name, documents=df, labels=lab)
        for i, (_, stage) in enumerate(p.STAGES):
            new = written(stage(spark, df, sf), "awkward")
            assert i == 4 or new.columns == docs.columns
            df = new
        assert df.where("not whole").count() == 0
    assert DOCUMENTS and byte_bpe and near_dedup
