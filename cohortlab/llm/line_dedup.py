"""Line dedup by site-relative frequency. DataFrame code only.

Documents are grouped by host. A line's share is the number of the host's
pages that contain it, divided by the host's pages. A share is known the less exactly
the fewer pages there are, so its lower bound counts (Wilson's, at Z standard errors;
the first two pages with a line, which a copied page explains, count as none): a line whose
lower bound exceeds ``ratio`` is boilerplate of that host and is dropped wherever it
stands on the host's pages. The rule is the same for every host, whatever its size: 3 pages of
3, 4 of 12, 5 % of 500 or 3 % of 5,000 are enough, 3 of 9 are not. A line counts once a page and is
compared without the spaces around it. The text itself isn't shuffled: only (host, 64-bit line hash)
pairs are, summed before they are, so neither a large host nor a common line
gathers in a task. A host has fewer than (lines a page) / ratio boilerplate
lines, whatever its size; these short lists meet the texts by a broadcast if
they are few in all and by a salted join otherwise.

Hashes: a line is dropped wrongly only if its hash equals that of a boilerplate
line of its own host, so 64 bits suffice.

Cases. A null text stays null and an empty one empty; both are pages without
lines. Blank lines are never dropped. A null host is a host of its own. Repeated
rows are pages of their own. A document may end up empty; it stays. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, table, written

RATIO = 0.02
Z = 3.0
SALTS = 16
MOST_BROADCAST = 1_000_000  # boilerplate hashes in all (8 bytes each)


def _lines(text: str | Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _above(n: str, pages: str, ratio: float, z: float) -> str:
    """SQL: the lower bound of the share of ``n`` - 2 in ``pages`` - 2 exceeds ``ratio``, as a
    quadratic inequality, so that Spark and other engines round alike (no root is taken)."""
    x, m = f"CAST({n} - 2 AS DOUBLE)", f"CAST({pages} - 2 AS DOUBLE)"
    r, zz = f"CAST({ratio!r} AS DOUBLE)", f"CAST({z * z!r} AS DOUBLE)"
    return f"({n} > 2 AND {x} > {r} * {m} AND ({x} - {r} * {m}) * ({x} - {r} * {m}) > {zz} * {r} * (1 - {r}) * {m})"


def boilerplate(pages: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, z: float = Z) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines; hosts without any are left out."""
    pages = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    keys = F.array_distinct(F.transform(F.filter(_lines("text"), lambda x: F.trim(x) != ""), _key))
    counts = pages.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    totals = small_side(written(totals.withColumnRenamed("host", "of"), "hosts"))
    return (
        counts.where(F.col("n") > 2)
        .join(totals, F.col("host").eqNullSafe(F.col("of")))
        .where(F.expr(_above("n", "pages", ratio, z)))
        .groupBy("host")
        .agg(F.collect_list("line").alias("lines"))
    )


def drop_lines(pages: DataFrame, found: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``pages`` as ``page``, with ``kept_text``, ``n_lines`` and ``n_dropped``."""
    found = written(found.select(F.col("host").alias("of"), "lines"), "boilerplate")
    few = (found.agg(F.sum(F.size("lines") + 1)).first()[0] or 0) <= MOST_BROADCAST
    rows = pages.select(F.struct(*pages.columns).alias("page"))
    where = F.col(f"page.{host}").eqNullSafe(F.col("of"))
    if few:
        rows = rows.join(F.broadcast(found), where, "left")
    else:
        salt = F.pmod(F.xxhash64(F.col(f"page.{text}")), F.lit(SALTS))
        salted = found.withColumn("part", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
        rows = rows.withColumn("salt", salt).join(salted, where & (F.col("salt") == F.col("part")), "left")
    lines = _lines(F.col(f"page.{text}"))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("lines"), _key(x)))
    full = lambda a: F.size(F.filter(a, lambda x: F.trim(x) != ""))
    some = F.col("lines").isNotNull() & F.col(f"page.{text}").isNotNull()
    return (
        rows.withColumn("left", F.when(some, kept))
        .withColumn("n_lines", F.coalesce(F.when(F.col(f"page.{text}").isNull(), 0).otherwise(full(lines)), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.when(some, F.size(lines) - F.size("left")).otherwise(0).cast("long"))
        .withColumn("kept_text", F.when(some, F.array_join("left", "\n")).otherwise(F.col(f"page.{text}")))
        .select("page", "kept_text", "n_lines", "n_dropped")
    )


def line_dedup(pages: DataFrame, text: str = "text", host: str = "source", **options) -> DataFrame:
    return drop_lines(pages, boilerplate(pages, text, host, **options), text, host)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup(docs).select("page.doc_id", "n_lines", "n_dropped", F.col("kept_text").alias("text"))


OP2_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rowid, doc_id, source, text FROM documents),
lines AS (
  SELECT rowid, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS place
  FROM d),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
common AS (
  SELECT l.source, trim(l.line) AS line
  FROM (SELECT DISTINCT rowid, source, trim(line) AS line FROM lines WHERE trim(line) <> '') l
  JOIN pages p ON l.source IS NOT DISTINCT FROM p.source
  GROUP BY l.source, l.line, p.pages
  HAVING {_above("count(*)", "p.pages", RATIO, Z)}),
marked AS (
  SELECT l.rowid, l.line, l.place, c.line IS NOT NULL AS out
  FROM lines l LEFT JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND trim(l.line) = c.line),
texts AS (
  SELECT rowid, CAST(count(*) FILTER (trim(line) <> '') AS BIGINT) AS n_lines, CAST(count(*) FILTER (out) AS BIGINT) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT out), '') AS text
  FROM marked GROUP BY rowid)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text
FROM d LEFT JOIN texts t ON d.rowid = t.rowid
"""
