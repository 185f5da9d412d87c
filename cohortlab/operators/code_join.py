"""Claims x a code list too large to broadcast.

1. A Bloom filter of the list's codes is built once, as a scalar subquery of
   fixed size, and tested where the claims are read: claims with other codes are
   dropped before any shuffle. It lets a few through by chance; the join drops them.
2. The claims that pass are stored (they are read twice), and counted by code.
3. Hot codes have at least one HOT_SHARE-th of them, so there are at most
   HOT_SHARE. Their part of the list is broadcast (its size is checked first) and
   their claims are joined where they lie, in as many tasks as hold them.
4. All other claims are joined to the rest of the list by a shuffle on the code,
   where no code can have more than a HOT_SHARE-th of the rows.

A hot code listed in more (criterion, group) rows than may be broadcast stays in
the shuffled join, with its claims dealt over SALTS keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import RunScratch, materialize

HOT_SHARE = 1000
HOT_ROWS = 200_000  # list rows of hot codes that may be broadcast
SALTS = 64
BITS_A_CODE = 10
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def filter_bits(codes: int) -> int:
    """A power of two of about BITS_A_CODE bits a code, within bounds."""
    bits = LEAST_BITS
    while bits < min(codes * BITS_A_CODE, MOST_BITS):
        bits *= 2
    return bits


def _places(code: Column, bits: int) -> list[Column]:
    """Two bit places of a code, from one hash."""
    h = F.xxhash64(code)
    return [F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits))]


def bloom_words(codes: DataFrame, bits: int) -> DataFrame:
    """One row: the filter as an array of ``bits`` / 63 words (63 bits each), 0 where nothing is set."""
    place = F.explode(F.array(*_places(F.col("code"), bits)))
    words = (
        codes.select(place.alias("place"))
        .groupBy((F.col("place") / 63).cast("int").alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(CAST(1 AS BIGINT), CAST(place % 63 AS INT))")).alias("word"))
    )
    # the filter's size is fixed by ``bits``, whatever the list holds
    set_ = F.map_from_entries(F.collect_list(F.struct("at", "word")))
    all_ = F.sequence(F.lit(0), F.lit(bits // 63))
    return words.agg(set_.alias("set")).select(F.transform(all_, lambda i: F.coalesce(F.try_element_at("set", i), F.lit(0).cast("long"))).alias("words"))


def may_be_listed(code: Column, words: Column, bits: int) -> Column:
    """Is the code in the filter? True for every listed code."""
    test = None
    for place in _places(code, bits):
        word = F.get(words, (place / 63).cast("int"))
        one = word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 63).cast("int"))) != 0
        test = one if test is None else test & one
    return test


def hot_codes(counts: DataFrame, share: int) -> list[str]:
    """Codes with at least one ``share``-th of all rows of ``counts`` (code, n): at most ``share``."""
    total = counts.agg(F.sum("n").alias("total")).first()["total"]
    if not total:
        return []
    return sorted(r["code"] for r in counts.where(F.col("n") * share >= total).select("code").collect())


def join_codes(claims: DataFrame, codes: DataFrame, n_codes: int, scratch: RunScratch | None = None, share: int | None = None) -> DataFrame:
    """``claims`` joined to ``codes`` on ``code``; ``n_codes``: rows of the list, about."""
    share = share or HOT_SHARE
    codes = materialize(codes, "code_list", scratch=scratch)
    bits = filter_bits(n_codes)
    words = materialize(bloom_words(codes.where(F.col("code").isNotNull()), bits), "code_filter", scratch=scratch)
    passing = claims.where(F.col("code").isNotNull() & may_be_listed(F.col("code"), words.scalar(), bits))
    passing = materialize(passing, "listed_claims", scratch=scratch)
    hot = hot_codes(passing.groupBy("code").agg(F.count("*").alias("n")), share)
    if not hot:
        return passing.join(codes, "code")
    is_hot = F.col("code").isin(hot)
    rows = codes.where(is_hot).count()
    rest = passing.where(~is_hot).join(codes.where(~is_hot), "code")
    if rows <= HOT_ROWS:
        return passing.where(is_hot).join(F.broadcast(codes.where(is_hot)), "code").select(rest.columns).unionByName(rest)
    salt = F.pmod(F.xxhash64("patient_id", "service_date", "claim_id"), F.lit(SALTS)).cast("int")
    copies = codes.where(is_hot).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = passing.where(is_hot).withColumn("salt", salt).join(copies.hint("shuffle_hash"), ["code", "salt"]).drop("salt")
    return dealt.select(rest.columns).unionByName(rest)
