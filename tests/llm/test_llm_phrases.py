"""Phrase collocations: against SQL and plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortlab.llm import phrases as P
from llm_data import DOCUMENTS, answers, documents, frame, rows_of, stored


def texts() -> list[tuple]:
    rng = random.Random(2)
    few = "aa bb cc dd ee Ff gg".split()
    rows = []
    for i in range(300):
        body = "".join(rng.choice(few[: 3 + i % 5]) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " \x1c "]) for _ in range(rng.randint(0, 60)))
        rows.append((i, body, rng.choice(["en", "de", None, "und"]), "s", 1, 1, "", "", 1))
    rows += [(900, "new york city hall " * 150 + "é ünï, " * 20, "en", None, None, None, None, None, None)] * 3
    rows += [(901, "the " * 4000, "en", "s", 1, 1, "", "", 1), (902, None, None, None, None, None, None, None, None), (903, "", "fr", "", 0, 0, "", "", 0)]
    return rows + documents()


def plain(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    f: dict[str, Counter] = {}
    n: Counter = Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for size in range(1, 6):
                f.setdefault(lang, Counter()).update(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        inside: set = set()
        for p, a in cand.items():
            inside |= {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= count[p[i:j]]}
        scored = []
        for p, a in cand.items():
            if p not in inside:
                cuts = [(1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
                s, k = min(cuts)
                scored.append((-s, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def test_query_equals_sql(spark, tmp_path):
    df = frame(spark, texts(), DOCUMENTS)
    got = P.op13_phrases(spark, stored(spark, tmp_path, documents=df))
    want = answers(P.OP13_SQL, documents=df)
    assert rows_of(got) == want and len(want) > 15
    none = P.op13_phrases(spark, stored(spark, tmp_path / "none", documents=df.where("false")))
    assert none.count() == 0 and none.columns == got.columns


@pytest.mark.parametrize("least, top, size, budget", [(2, 10_000, 1 << 16, 50), (5, 7, 8, 10**6)])
def test_any_threshold_bitmap_and_budget(spark, least, top, size, budget):
    """A bitmap of 64 bits lets nearly all through; a budget of 50 places splits prefixes."""
    rows = texts()
    got = P.collocations(frame(spark, rows, DOCUMENTS), least=least, top=top, bitmap_bytes=size, group_leaves=budget)
    assert sorted(map(tuple, got.collect())) == plain(rows, least, top)


def test_groups_keep_the_budget(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), 1 << 63, 500)
    n = np.where(np.arange(500) < 3, 9000, rng.integers(1, 40, 500))
    groups = P.Groups(spark.createDataFrame(list(zip(keys.tolist(), n.tolist())), "key long, n long"), 400)
    at = groups.of[(keys[3:].view(np.uint64) >> np.uint64(48)).astype(int)]
    assert np.bincount(at, n[3:]).max() <= 400 + 40 * 3 and at.max() < groups.shared
    assert len(groups.large) == 3 and set(groups.parts) == {-(-9000 // 400)} or groups.parts.min() > 20
    suffixes = rng.integers(1, 1 << 40, (20_000, 5)).astype(np.uint64)
    suffixes[:, :2] = 7, 8
    groups.large = P._pair_key(np.array([P._of_language("en")]), np.uint64(7), np.uint64(8))
    share = np.bincount(groups("en", suffixes) - groups.first[0])
    assert len(share) == groups.parts[0] and share.max() < 2 * share.mean()  # one prefix over all its groups


def test_subtrees_of_shared_prefixes_add_up():
    rng = random.Random(9)
    leaves = sorted({tuple([1, *[rng.randint(1, 3) for _ in range(size - 1)], *[0] * (5 - size)]) for size in (2, 3, 4, 5) for _ in range(60)})
    whole: Counter = Counter()
    for x in leaves:
        for size in range(2, 6):
            if x[size - 1]:
                whole[x[:size] + (0,) * (5 - size)] += 3
    nodes = lambda part, least, shared: zip(*(y.tolist() for y in P.subtree(np.array(part, np.uint64), np.full(len(part), 3), least, shared)))
    for least in (1, 9, 40):
        want = {k: v for k, v in whole.items() if v >= least}
        assert {tuple(w): n for w, n in nodes(leaves, least, False)} == want
        got: Counter = Counter()
        for part in (leaves[::2], leaves[1::2]):
            for w, n in nodes(part, least, True):
                got[tuple(w)] += n
        assert {k: v for k, v in got.items() if v >= least} == {k: v for k, v in want.items() if not k[4] or v >= least}
