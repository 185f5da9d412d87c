"""Mixing sources to target weights by order sampling. DataFrame code only.

Each source s has a target number of words t_s. A document is expected
r = t_s / size_s times: the whole part is allocated for certain, the rest f is a
sample without replacement. Documents are put into classes by size (a class's sizes differ by
less than a factor of two). In a class that is to give n words a document of size x gets the
inclusion odds of p = n x / (sum of x^2 over the class), those with p of 1 or more
are certain, and a document's rank is its random odds divided by its inclusion odds,

    Q = (u / (1 - u)) / (p / (1 - p)),   u = draw(seed, doc_id).

From the largest class to the smallest, documents are taken in the order of ranks while they fit
into f times the class's words and what the classes before left over. So a long document that
doesn't fit leaves its words to shorter ones. A second turn through the classes goes on
where each stopped, with what is still left; the next ones give documents another copy, as far
as ``most`` allows. A source ends below its target, by less than the next document of any class.

Ranks are cut at slices of their scale, ``slices`` a class; all documents of a slice are taken
or none (few slices hold more than one, and those are small parts of their class).
What is folded over the classes is one row a source with at most ``slices`` sums a class; no
task sees a source's rows whole.

Cases. Null or empty text: size 0, taken 0. A null source is a source of its
own, last in order. Rows with the same doc_id draw the same number; rows of
equal rank and size class all are taken or none. A null doc_id draws as an empty one.
Columns of ``docs`` that clash with names used here are not read. No rows: no
rows. A source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, small_side, table, unit_draw, unit_draw_sql, word_count, written

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 20240
SLICES = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sizes``: (source, source_size), one row a source. Adds ``target``.

    All words are shared by weight; a source gets ``most`` times its size at
    most and what it can't take is reshared by weight. The level L of the
    final round, with target = min(most * size, L * weight), follows from one
    running sum over the sources in the order in which they fill up
    (most * size / weight): the first k are full if the level that the others
    would have is above the k-th one's ratio.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    fill = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everyone = Window.partitionBy()
    steps = (
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("most", F.col("source_size") * most)
        .withColumn("ratio", F.col("most").cast("double") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everyone) - (F.sum("most").over(upto) - F.col("most")))
        .withColumn("heads", F.sum("weight").over(everyone) - (F.sum("weight").over(upto) - F.col("weight")))
        .withColumn("full", F.col("most") * F.col("heads") <= F.col("left") * F.col("weight"))
    )
    # the first source that isn't full: what is left there, and the weights that share it
    level = F.min(F.when(~F.col("full"), F.struct("ratio", F.col("source").isNull(), "source", "left", "heads")))
    shared = F.try_divide((F.col("level.left") * F.col("weight")).cast("double"), F.col("level.heads"))
    return (
        steps.withColumn("level", level.over(everyone))
        .withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(shared))
        .select("source", "source_size", "target")
    )


def _drawn(docs: DataFrame, seed: int, preference: str | None, *kept: Column) -> DataFrame:
    """(of, size, u, class, factor) and ``kept``: a class is a size's number of binary digits; null without words."""
    factor = F.coalesce(F.col(preference), F.lit(1.0)).cast("double") if preference else F.lit(1.0)
    rows = docs.select(*kept, F.col("source").alias("of"), word_count().alias("size"), unit_draw(seed, "doc_id").alias("u"), factor.alias("factor"))
    return rows.withColumn("class", F.when(F.col("size") > 0, F.length(F.bin("size"))))


# of a document: its slice, from its own size and draw and its class's words and sum of squares
P = "(f * size * words / squares)"
SLICE = "CASE WHEN {p} >= 1 THEN 0 ELSE CAST(floor({q} / (1 + {q}) * {n}) AS BIGINT) END"
Q = f"(u / (1 - u) * ((1 - {P}) / {P}) / factor)"


def _slice(slices: int) -> Column:
    return F.expr(SLICE.format(p=P, q=Q, n=f"{slices}D"))


# the largest sum of a class's first slices that is within a bound
_FITS = "coalesce(array_max(transform(filter({cells}, x -> x.upto <= {bound}), x -> x.upto)), 0L)"


def _turn(bound: str) -> str:
    """A fold over ``classes``: what each takes up to (its first slices' words), and what is left."""
    fits = _FITS.format(cells="c.cells", bound=bound)
    return f"""aggregate(classes, named_struct('left', left, 'taken', CAST(array() AS ARRAY<BIGINT>)),
        (s, c) -> named_struct('left', {bound} - {fits}, 'taken', concat(s.taken, array({fits}))))"""


def mixing_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = SEED,
    slices: int = SLICES,
    preference: str | None = None,
) -> DataFrame:
    """One row a source: source_size, target, whole copies, f, and ``cuts``: for each class
    its words and squares, and for each copy that the sample can give the last slice that gets it.

    ``preference``: column of a factor on a document's inclusion odds.
    """
    light = written(_drawn(docs, seed, preference).withColumnRenamed("of", "source"), "mix_sizes")
    plan = (
        targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
        .withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
        .withColumn("f", F.coalesce(F.try_divide(F.col("target") - F.col("whole") * F.col("source_size"), "source_size"), F.lit(0.0)))
    )
    plan = written(plan, "mix_targets")
    square = F.col("size").cast("double") * F.col("size")
    classes = light.where("size > 0").groupBy(F.col("source").alias("of"), F.col("class").alias("own")).agg(
        F.sum("size").alias("words"), F.sum(square).alias("squares"))
    classes = classes.join(small_side(plan.where("f > 0").select("source", "f")), F.col("of").eqNullSafe(F.col("source"))).drop("source")
    classes = written(classes, "mix_classes")
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("own"))
    cells = light.join(small_side(classes), same).withColumn("slice", _slice(slices)).groupBy("source", "class", "slice").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source", "class").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("upto", F.sum("n").over(upto)).groupBy("source", "class").agg(F.collect_list(F.struct("slice", "upto")).alias("cells"))
    cells = cells.join(classes, same).groupBy("source", "f").agg(
        F.sort_array(F.collect_list(F.struct("class", "words", "squares", "cells")), asc=False).alias("classes"))
    cells = cells.join(plan.select(F.col("source").alias("of"), "whole"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    with_taken = "transform(classes, (c, i) -> named_struct('class', c.class, 'words', c.words, 'squares', c.squares, 'cells', c.cells, 'taken', turn.taken[i]))"
    # each turn is written (a row a source): a fold that a later expression took up would be folded anew for each of its uses
    done = cells.withColumn("left", F.lit(0.0))
    for bound in ("(s.left + f * c.words)", "(s.left + c.taken)"):
        done = written(done.withColumn("turn", F.expr(_turn(bound))), "mix_turn")
        done = written(done.withColumn("left", F.col("turn.left")).withColumn("classes", F.expr(with_taken)).drop("turn"), "mix_turn")
    turns = range(2, most + 1)  # the copy that a turn gives
    for i in turns:
        done = written(done.withColumn(f"turn{i}", F.when(F.col("whole") + i <= most, F.expr(_turn("s.left")))), "mix_turn")
        done = done.withColumn("left", F.coalesce(F.col(f"turn{i}.left"), "left"))
    last = "coalesce(array_max(transform(filter(c.cells, x -> x.upto <= {t}), x -> x.slice)), -1L)"
    again = ", ".join(last.format(t=f"coalesce(turn{i}.taken[i], 0L)") for i in turns)
    cuts = done.select(
        F.col("source").alias("with_cuts"),
        F.expr(f"""map_from_entries(transform(classes, (c, i) -> struct(c.class, named_struct(
            'words', c.words, 'squares', c.squares, 'last', array({", ".join([last.format(t="c.taken"), again])})))))""").alias("cuts"),
    )
    return written(
        plan.join(cuts, F.col("source").eqNullSafe(F.col("with_cuts")), "left").select("source", "source_size", "target", "whole", "f", "cuts"),
        "mix_plan",
    )


def with_copies(
    docs: DataFrame, plan: DataFrame, seed: int = SEED, slices: int = SLICES, preference: str | None = None
) -> DataFrame:
    """``docs`` (all their columns) as ``doc``, with ``size``, ``source_size``, ``target`` and ``copies``.

    The decision on a document depends on its own row and its source's plan,
    so texts aren't shuffled.
    """
    rows = _drawn(docs, seed, preference, F.struct(*docs.columns).alias("doc"))
    rows = rows.join(small_side(plan), F.col("of").eqNullSafe(F.col("source")))
    rows = rows.withColumn("cut", F.col("cuts")[F.col("class")])
    rows = rows.select("*", F.col("cut.words").alias("words"), F.col("cut.squares").alias("squares")).withColumn("slice", _slice(slices))
    taken = F.size(F.filter("cut.last", lambda x: F.col("slice") <= x))
    sampled = F.when(F.col("cut").isNotNull(), taken).otherwise(0).cast("long")
    return rows.withColumn("copies", F.col("whole") + sampled).select("doc", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: each document as often as the mix takes it."""
    kept = with_copies(docs, mixing_plan(docs, **options), **{k: v for k, v in options.items() if k in ("seed", "slices", "preference")})
    return kept.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    rows = with_copies(docs.select("doc_id", "text", "source"), mixing_plan(docs))
    return rows.select(
        "doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


OP3_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         {unit_draw_sql(SEED, "doc_id")} AS u
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)] AS weight
  FROM docs GROUP BY source),
-- the level at which the shares add up, tried with every source as the first that isn't full
levels AS (
  SELECT a.source AS first, any_value(a.source_size) AS first_size, any_value(a.weight) AS first_weight,
         sum(CASE WHEN b.source_size * a.weight < a.source_size * b.weight THEN (1 - {MOST_COPIES}) * b.source_size ELSE b.source_size END) AS rest,
         sum(CASE WHEN b.source_size * a.weight < a.source_size * b.weight THEN 0 ELSE b.weight END) AS heads
  FROM sizes a, sizes b GROUP BY a.source),
level AS (
  SELECT rest, heads FROM levels WHERE {MOST_COPIES} * first_size * heads > rest * first_weight
  ORDER BY {MOST_COPIES} * first_size / first_weight LIMIT 1),
aims AS (
  SELECT source, source_size, CASE WHEN coalesce({MOST_COPIES} * source_size * heads <= rest * weight, TRUE)
         THEN CAST({MOST_COPIES} * source_size AS DOUBLE) ELSE CAST(rest * weight AS DOUBLE) / CAST(heads AS DOUBLE) END AS target
  FROM sizes LEFT JOIN level ON TRUE),
parts AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE (target - whole * source_size) / source_size END AS f
  FROM (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM aims)),
classes AS MATERIALIZED (
  SELECT d.source, length(bin(size)) AS class, CAST(sum(size) AS BIGINT) AS words, sum(CAST(size AS DOUBLE) * size) AS squares, any_value(f) AS f, any_value(whole) AS whole
  FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source WHERE size > 0 AND f > 0 GROUP BY d.source, length(bin(size))),
sliced AS MATERIALIZED (
  SELECT d.source, c.class, doc_id, size, {SLICE.format(p=P, q=Q.replace("factor", "1.0::DOUBLE"), n=f"{SLICES}::DOUBLE")} AS slice
  FROM docs d JOIN classes c ON d.source IS NOT DISTINCT FROM c.source AND length(bin(size)) = c.class WHERE size > 0),
cells AS MATERIALIZED (
  SELECT source, class, list(upto ORDER BY slice) AS uptos, list(slice ORDER BY slice) AS slices
  FROM (SELECT source, class, slice, CAST(sum(sum(size)) OVER (PARTITION BY source, class ORDER BY slice) AS BIGINT) AS upto FROM sliced GROUP BY source, class, slice)
  GROUP BY source, class),
-- the classes of a source from the largest, once a turn
grid AS MATERIALIZED (
  SELECT c.source, c.class, c.f * c.words AS share, uptos, slices, c.whole,
         row_number() OVER (PARTITION BY c.source ORDER BY c.class DESC) AS k, count(*) OVER (PARTITION BY c.source) AS n
  FROM classes c JOIN cells x ON c.source IS NOT DISTINCT FROM x.source AND c.class = x.class),
steps AS (
  WITH RECURSIVE r AS (
    SELECT source, 0 AS step, 0.0::DOUBLE AS remaining, CAST([] AS BIGINT[]) AS taken FROM (SELECT DISTINCT source FROM grid)
    UNION ALL
    SELECT source, step + 1, bound - got, list_append(taken, got) FROM (
      SELECT source, step, bound, taken, coalesce(list_max(list_filter(uptos, lambda x: x <= bound)), 0) AS got FROM (
        SELECT r.source, r.step, r.taken, g.uptos,
               CASE WHEN r.step < g.n THEN r.remaining + g.share WHEN r.step < 2 * g.n THEN r.remaining + r.taken[r.step + 1 - g.n] ELSE r.remaining END AS bound
        FROM r JOIN grid g ON r.source IS NOT DISTINCT FROM g.source AND g.k = r.step % g.n + 1
        WHERE r.step < (1 + greatest(1, {MOST_COPIES} - g.whole)) * g.n)))
  SELECT source, arg_max(taken, step) AS taken FROM r GROUP BY source),
cuts AS (
  SELECT g.source, g.class, list_transform(range(1, {MOST_COPIES} + 1), lambda t:
         coalesce(list_max([z[2] FOR z IN list_zip(uptos, slices) IF z[1] <= coalesce(taken[t * n + k], 0)]), -1)) AS last
  FROM grid g JOIN steps s ON g.source IS NOT DISTINCT FROM s.source)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.whole + coalesce(len(list_filter(c.last, lambda t: x.slice <= t)), 0)) AS BIGINT) AS taken
FROM (SELECT row_number() OVER () AS row, * FROM docs) d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN (SELECT DISTINCT source, class, doc_id, size, slice FROM sliced) x
  ON d.source IS NOT DISTINCT FROM x.source AND d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.size = x.size
LEFT JOIN cuts c ON x.source IS NOT DISTINCT FROM c.source AND x.class = c.class
"""
