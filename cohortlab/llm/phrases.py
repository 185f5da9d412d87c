"""Phrase collocations by vertical partitioning of a truncated suffix tree.

A phrase is 2 to LONGEST words that follow each other in a piece of text. Its
counts are those of the nodes of a suffix tree cut off at LONGEST words, built
in parts that fit in memory:

1. Words are counted per language. Those seen LEAST times or more can be in a phrase.
2. Prefixes of two words, both frequent, are counted.
3. Prefixes are put into groups: neighbours (by a hash) are taken together up to the
   memory budget of GROUP_LEAVES places; a prefix with more places than that gets several
   groups of its own, dealt by the words that follow.
4. Every place where a frequent prefix begins gives one suffix: its words up to
   the first pair of neighbours that isn't frequent, LONGEST at most. Equal
   suffixes are added up in the task and sent, packed, to the prefix's group.
5. A group's subtree is read off its sorted suffixes, the leaves: a node's count is
   the sum of the totals of the leaves below it. Only the groups that share a prefix
   have parts of a node; Spark adds these.

Words are 64-bit hashes on the way. No two words of a language share one: all
words are compared, and another seed is taken if they do. Frequent words and
prefixes reach the tasks as bitmaps of BITMAP_BYTES, whatever their number; what
they let through by chance is found too rare in the end. Exact counts of words,
parts and phrases then give the scores in joins; a phrase inside a longer one
that is as frequent is dropped (a phrase never is rarer than one that holds
it, so the phrases one word longer decide).

Cases. Null and empty texts have no words; a null lang is ``und``. Texts may be
of any length: a task holds one batch. Repeated rows count each; null ids don't matter.
No rows, or no frequent phrase: no rows. Columns other than text and lang aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_parts, table, written
from .shingles import mixed

LONGEST = 5
LEAST = 100
TOP = 2000
SCALE = 1000
BITMAP_BYTES = 1 << 23
GROUP_LEAVES = 1_000_000  # of 48 bytes
RANGES = 1 << 16  # of prefixes by hash, the least that a group takes
TASK_ROWS = 1_000_000  # counts that a task adds up before they go out
BATCH = 256  # texts
_CUTS = np.zeros(256, np.uint8)  # 1: ends a word, 2: ends a piece as well
_CUTS[[0x20, 0x09]] = 1
_CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
NODE = "lang string, " + ", ".join(f"{w} long" for w in WORDS) + ", n long"


def words(column: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(lower-cased words of all texts, which text each is of, its piece's number)."""
    texts = pc.ascii_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base = int(ends[0]) if len(ends) else 0
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[base : int(ends[-1]) if len(ends) else 0]
    ends = ends - base
    kind = _CUTS[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = ends[1:-1][ends[1:-1] < len(data)]  # a text ends the word before it
    first[edges] |= inside[edges]
    starts = np.flatnonzero(first)
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(inside)])
    offsets = np.append(upto[starts], upto[-1])
    out = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[inside].tobytes()))
    text = np.searchsorted(ends, starts, side="right") - 1
    cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(kind == 2)])
    return out, text, cuts[starts] + text  # a later text has a higher number, whatever its cuts


def coded(column: pa.Array, seed: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, their hashes, and for all words: which, text, piece)."""
    every, text, piece = words(column)
    d = every.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in d.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    return d.dictionary, hashes, d.indices.to_numpy(zero_copy_only=False), text, piece


def languages(column: pa.Array) -> tuple[list[str], np.ndarray]:
    d = pc.fill_null(column, "und").dictionary_encode()
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``keys`` and the sums of ``n`` over each."""
    if len(keys) == 0:
        return keys, n
    order = np.lexsort(keys.T[::-1])
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    return keys[first], np.add.reduceat(n, first)


class Counter:
    """Counts of rows of numbers per language, added up until there are many."""

    def __init__(self) -> None:
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.rows = 0

    def add(self, lang: str, keys: np.ndarray, n: np.ndarray | None = None) -> None:
        if len(keys):
            keys, n = summed(keys, np.ones(len(keys), np.int64) if n is None else n)
            self.parts.setdefault(lang, []).append((keys, n))
            self.rows += len(keys)

    def full(self) -> bool:
        if self.rows > TASK_ROWS:
            self.rows = 0
            for lang, parts in self.parts.items():
                self.parts[lang] = [summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))]
                self.rows += len(self.parts[lang][0][0])
        return self.rows > TASK_ROWS // 2

    def take(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for lang, parts in self.parts.items():
            yield lang, *summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
        self.parts, self.rows = {}, 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, w, n): n occurrences; w the word's hash."""

    def count(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            names, lang = languages(b.column(1))
            distinct, hashes, which, text, _ = coded(b.column(0), seed)
            for i, name in enumerate(names):
                n = np.bincount(which[lang[text] == i], minlength=len(distinct))
                some = np.flatnonzero(n)
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(some)), distinct.take(pa.array(some)).cast(pa.string()), _signed(hashes[some]), pa.array(n[some])], ["lang", "word", "w", "n"]
                    )

    bounded_batches(docs.sparkSession, BATCH)
    rows = docs.select("text", "lang").mapInArrow(count, "lang string, word string, w long, n long")
    return rows.groupBy("lang", "word").agg(F.first("w").alias("w"), F.sum("n").alias("n"))


def bitmap(keys: DataFrame, size: int) -> np.ndarray:
    """The numbers in the column ``key`` as bits, at their value modulo the size (a
    power of two): only the bitmap's set words reach the driver, ``size`` bytes at most."""
    place = F.pmod("key", F.lit(size * 8))
    set_ = keys.groupBy(F.floor(place / 64).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(key, {size * 8}) % 64 AS INT))")).alias("bits"))
    out = np.zeros(size // 8, np.uint64)
    for b in set_.toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy().view(np.uint64)
    return out


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys % np.uint64(len(bits) * 64)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _of_language(name: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(name))


def _pair_key(lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first + lang) * np.uint64(0x9E3779B97F4A7C15) + second)


def _sent(spark, bits: np.ndarray):
    """A bitmap for all tasks: of its fixed size, whatever it holds."""
    return spark.sparkContext.broadcast(bits)


def _salts(names: list[str]) -> np.ndarray:
    return np.array([_of_language(x) for x in names], np.uint64)


def prefixes(docs: DataFrame, frequent, seed: int) -> DataFrame:
    """(key, n): occurrences of two neighbouring words, both frequent, by a hash of language and
    words. Two pairs that share a hash only let more suffixes through."""

    def count(batches: Iterator[pa.RecordBatch]):
        c = Counter()

        def out():
            for _, keys, n in c.take():
                yield pa.RecordBatch.from_arrays([_signed(keys[:, 0]), pa.array(n)], ["key", "n"])

        for b in batches:
            names, lang = languages(b.column(1))
            _, hashes, which, text, piece = coded(b.column(0), seed)
            of, w = _salts(names)[lang[text]] if len(text) else np.zeros(0, np.uint64), hashes[which]
            good = has(frequent.value, mixed(w + of))
            at = np.flatnonzero(good[:-1] & good[1:] & (piece[:-1] == piece[1:]))
            c.add("", _pair_key(of[at], w[at], w[at + 1])[:, None])
            if c.full():
                yield from out()
        yield from out()

    bounded_batches(docs.sparkSession, BATCH)
    return docs.select("text", "lang").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Groups:
    """Which group a suffix goes to; RANGES + places / GROUP_LEAVES numbers."""

    def __init__(self, pairs: DataFrame, budget: int) -> None:
        spark = pairs.sparkSession
        top = F.shiftrightunsigned("key", 48).cast("int")
        sums = np.zeros(RANGES, np.int64)
        for r in pairs.where(F.col("n") <= budget).groupBy(top.alias("at")).agg(F.sum("n").alias("n")).collect():
            sums[r["at"]] = r["n"]
        budget = max(1, min(budget, -(-int(sums.sum()) // shuffle_parts(spark))))
        self.of = ((np.cumsum(sums) - sums) // budget).astype(np.int64)
        self.shared = int(self.of[-1]) + 1  # groups from here on share a prefix with others
        large = sorted((r["key"] % (1 << 64), r["n"]) for r in pairs.where(F.col("n") > budget).collect())
        parts = np.array([-(-n // budget) for _, n in large], np.int64)
        self.large, self.parts = np.array([k for k, _ in large], np.uint64), parts
        self.first = self.shared + np.cumsum(parts) - parts
        self.total = self.shared + int(parts.sum())

    def __call__(self, lang: str, suffixes: np.ndarray) -> np.ndarray:
        salt = np.full(len(suffixes), _of_language(lang), np.uint64)
        key = _pair_key(salt, suffixes[:, 0], suffixes[:, 1])
        out = self.of[(key >> np.uint64(48)).astype(np.int64)]
        if len(self.large):
            at = np.minimum(np.searchsorted(self.large, key), len(self.large) - 1)
            mine = np.flatnonzero(self.large[at] == key)
            rest = suffixes[mine, 2]
            for i in range(3, LONGEST):
                rest = mixed(rest) + suffixes[mine, i]
            out[mine] = self.first[at[mine]] + (mixed(rest) % self.parts[at[mine]].astype(np.uint64)).astype(np.int64)
        return out


def leaves(docs: DataFrame, pairs, groups, seed: int) -> DataFrame:
    """(group, lang, leaves): suffixes (0 after their last word) and totals, column by column."""

    def count(batches: Iterator[pa.RecordBatch]):
        c, of_group = Counter(), groups.value

        def out():
            for lang, keys, n in c.take():
                group = of_group(lang, keys)
                order = np.argsort(group, kind="stable")
                group, rows = group[order], np.concatenate([keys, n[:, None].astype(np.uint64)], 1)[order]
                cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                packed = [np.ascontiguousarray(x.T).tobytes() for x in np.split(rows, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(group[cuts]), pa.array([lang] * len(cuts)), pa.array(packed, pa.binary())], ["group", "lang", "leaves"])

        for b in batches:
            names, lang = languages(b.column(1))
            _, hashes, which, text, piece = coded(b.column(0), seed)
            w, of = hashes[which], lang[text]
            if len(w) < 2:
                continue
            salt = _salts(names)[of]
            # may the word and the next one be in a phrase?
            joined = np.append((piece[:-1] == piece[1:]) & has(pairs.value, _pair_key(salt[:-1], w[:-1], w[1:])), False)
            ahead = joined.astype(np.uint8)  # words after this one
            for _ in range(LONGEST - 2):
                ahead = np.where(joined, np.append(ahead[1:], 0) + 1, 0).clip(max=LONGEST - 1).astype(np.uint8)
            at = np.flatnonzero(ahead)
            suffix = np.zeros((len(at), LONGEST), np.uint64)
            for j in range(LONGEST):
                on = ahead[at] >= j
                suffix[on, j] = w[at[on] + j]
            for i, name in enumerate(names):
                c.add(name, suffix[of[at] == i])
            if c.full():
                yield from out()
        yield from out()

    bounded_batches(docs.sparkSession, BATCH)
    return docs.select("text", "lang").mapInArrow(count, "group long, lang string, leaves binary")


def subtree(suffixes: np.ndarray, totals: np.ndarray, least: int, partial: bool) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts) of the nodes of two words and more with ``least`` places. With
    ``partial``, other groups have leaves of nodes above the deepest, which then come out whatever their count."""
    suffixes, totals = summed(suffixes, totals)
    nodes, counts = [], []
    for depth in range(2, LONGEST + 1):
        first = np.flatnonzero(np.concatenate([[True], (suffixes[1:, :depth] != suffixes[:-1, :depth]).any(1)]))
        n = np.add.reduceat(totals, first)
        kept = (suffixes[first, depth - 1] != 0) & ((n >= least) | (partial and depth < LONGEST))
        own = suffixes[first[kept]].copy()
        own[:, depth:] = 0
        nodes.append(own)
        counts.append(n[kept])
    return np.concatenate(nodes), np.concatenate(counts)


def phrases(packed: DataFrame, groups, total: int, least: int) -> DataFrame:
    """(lang, w1 .., a): phrases of two words and more, 0 after the last."""

    def build(batches: Iterator[pa.RecordBatch]):
        at, held = None, []

        def out():
            rows = np.concatenate([np.frombuffer(x, np.uint64).reshape(LONGEST + 1, -1) for x in held], 1)
            words_, n = subtree(rows[:LONGEST].T, rows[LONGEST].astype(np.int64), least, at[0] >= groups.value.shared)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([at[1]] * len(n), pa.string()), *[_signed(words_[:, i]) for i in range(LONGEST)], pa.array(n)], ["lang", *WORDS, "n"])

        for b in batches:
            for group, lang, data in zip(*(c.to_pylist() for c in b.columns)):
                if (group, lang) != at:
                    if held:
                        yield out()
                    at = (group, lang)
                held.append(data)
        if held:
            yield out()

    spark = packed.sparkSession
    placed = packed.repartition(max(shuffle_parts(spark), total // 4), "group")  # a few groups a task
    bounded_batches(spark, 16)
    nodes = placed.sortWithinPartitions("group", "lang").mapInArrow(build, NODE)
    return nodes.groupBy("lang", *WORDS).agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def scored(found: DataFrame, counts: DataFrame, least: int, scale: int) -> DataFrame:
    """``found`` with l, r, n and score, without those inside a longer one as frequent."""
    spark = found.sparkSession
    length = sum(F.when(F.col(w) != 0, 1).otherwise(0) for w in WORDS)
    found = found.withColumn("size", length)
    word = counts.where(F.col("n") >= least).select("lang", F.col("w").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in WORDS[1:]], F.col("n").alias("f"))
    known = word.unionByName(found.select("lang", *WORDS, F.col("a").alias("f")))
    cell = lambda i: F.col(WORDS[i])

    def part(begin, end) -> list:
        """Words ``begin`` up to ``end`` (numbers or columns) of the phrase, 0 after them."""
        all_ = F.array(*WORDS)
        return [F.when(F.lit(i) + begin < end, F.try_element_at(all_, (F.lit(i + 1) + begin).cast("int"))).otherwise(F.lit(0)).cast("long") for i in range(LONGEST)]

    # a phrase one word longer that is as frequent
    longer = found.where("size > 2")
    inside = [longer.select("lang", *[c.alias(w) for c, w in zip(part(F.lit(b), F.col("size") - 1 + b), WORDS)], F.col("a").alias("b")) for b in (0, 1)]
    above = inside[0].unionByName(inside[1]).groupBy("lang", *WORDS).agg(F.max("b").alias("b"))
    kept = found.join(above, ["lang", *WORDS], "left").where("b is null or b < a").drop("b")
    kept = written(kept, "phrases")
    cut = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    of = known.select(F.col("lang").alias("_lang"), *[F.col(w).alias(f"_{w}") for w in WORDS], "f")

    def looked_up(rows: DataFrame, columns: list, name: str) -> DataFrame:
        rows = rows.select("*", *[c.alias(f"_p{i}") for i, c in enumerate(columns)])
        on = (F.col("lang") == F.col("_lang"))
        for i, w in enumerate(WORDS):
            on = on & (F.col(f"_p{i}") == F.col(f"_{w}"))
        joined = rows.join(of, on)
        return joined.withColumn(name, F.col("f")).drop("f", "_lang", *[f"_{w}" for w in WORDS], *[f"_p{i}" for i in range(LONGEST)])

    cut = looked_up(cut, part(F.lit(0), F.col("k")), "l")
    cut = looked_up(cut, part(F.col("k"), F.col("size")), "r")
    total = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    cut = cut.join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    top = wide("a") * F.lit(scale).cast("decimal(38,0)") * wide("n")
    cut = cut.withColumn("top", top.cast("decimal(38,0)")).withColumn("under", (wide("l") * wide("r")).cast("decimal(38,0)"))
    cut = cut.withColumn("score", F.expr("CAST(top DIV under AS BIGINT)"))
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cut.groupBy("lang", *WORDS, "a", "n").agg(least_cut).select("lang", *WORDS, "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, scale: int = SCALE, text: str = "text", lang: str = "lang", bitmap_bytes: int = BITMAP_BYTES, group_leaves: int = GROUP_LEAVES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    spark = docs.sparkSession
    docs = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    seed = 0
    while True:
        counts = written(word_counts(docs, seed), "word_counts")
        if not counts.groupBy("lang", "w").count().where("count > 1 or w = 0").limit(1).count():
            break
        seed += 1  # two words of a language share a hash
    often = counts.where(F.col("n") >= least).select("lang", "w")
    frequent = _sent(spark, _word_bits(often, bitmap_bytes))
    pairs = written(prefixes(docs, frequent, seed).where(F.col("n") >= least), "prefixes")
    groups = Groups(pairs, group_leaves)
    sent = spark.sparkContext.broadcast(groups)
    packed = leaves(docs, _sent(spark, bitmap(pairs, bitmap_bytes)), sent, seed)
    found = written(phrases(packed, sent, groups.total, least), "nodes")
    rows = written(scored(found, counts, least, scale), "scores")
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    rows = rows.withColumn("place", F.rank().over(first)).where(F.col("place") <= top)  # with all that tie with the last
    each = rows.select("*", F.posexplode(F.array(*WORDS)).alias("at", "w")).where("w <> 0")
    named = each.join(counts.where(F.col("n") >= least).select("lang", "w", "word"), ["lang", "w"])
    facts = ["a", "l", "r", "n", "score"]
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    named = named.groupBy("lang", *WORDS, *facts).agg(phrase.alias("phrase"))
    final = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return named.withColumn("rank", F.row_number().over(final).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", *facts)


def _word_bits(often: DataFrame, size: int) -> np.ndarray:
    def key(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            names, lang = languages(b.column(0))
            salt = np.array([_of_language(x) for x in names], np.uint64)
            yield pa.RecordBatch.from_arrays([_signed(mixed(b.column(1).to_numpy().view(np.uint64) + salt[lang]))], ["key"])

    return bitmap(often.mapInArrow(key, "key long"), size)


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def _sql() -> str:
    """Every phrase of every piece, counted; joins for parts and longer phrases."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    cut = "".join(f"\\x{{{c:02x}}}" for c in (0x0A, 0x0B, 0x0C, 0x0D))
    return f"""WITH pieces AS MATERIALIZED (
        SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{upper}', '{lower}'), '[.,;:!?{cut}]')) AS piece FROM documents)),
    f AS MATERIALIZED (
        SELECT lang, size, phrase, count(*) AS f FROM (
            SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM (
                SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM pieces, range(1, {LONGEST + 1}) AS t(size)))
        GROUP BY ALL HAVING count(*) >= {LEAST}),
    kept AS (SELECT * FROM f c WHERE size > 1 AND NOT EXISTS (
        SELECT 1 FROM f g WHERE g.lang = c.lang AND g.size > c.size AND 100 * g.f >= 100 * c.f AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' '))),
    cuts AS (SELECT *, unnest(range(1, size)) AS k FROM kept),
    parts AS (SELECT cuts.*, x.f AS l, y.f AS r, t.n, CAST((CAST({SCALE} AS HUGEINT) * cuts.f * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM cuts
        JOIN (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang) t USING (lang)
        JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(string_split(cuts.phrase, ' ')[1:k], ' ')
        JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(string_split(cuts.phrase, ' ')[k + 1:], ' ')
        QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase, f AS a, l, r, n, score
    FROM parts QUALIFY rank <= {TOP}"""


OP13_SQL = _sql()
