"""Secret scan: key patterns, and Shannon entropy in sliding windows. DataFrame code only.

Base kinds (``BASE``) are patterns with a least length. The method adds spans
for random-looking strings: candidates are the maximal runs of a character
class (``CLASSES``); a window of the class's width slides over a candidate and
its entropy follows from counts that change by the character that enters and
the one that leaves. With n_c characters of kind c in a window of w,

    w * H = w * log2(w) - sum(n_c * log2(n_c)),

so a step adds and subtracts two terms of a table (``n * log2(n)`` in units of
2^-20 bits, whole numbers, so the sum doesn't drift). The two counts of a step are those of
one character among the window's others, so a run costs its length times the window's
width, and no more. Windows that reach the class's bits are hot; overlapping hot
windows are one span. A span is left out
if its text is on the allow-list (``ALLOWED``) or it lies within a base span.

Offsets count code points, the end is exclusive. Matches are found from left
to right with the text before each match (``\\G`` ties a match to the end of
the one before), and offsets are running sums of lengths, in one pass over a
text however long it is.

Cases. A null text is read as empty and has no spans; repeated rows give
repeated results; other columns aren't read. No rows: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_of



def either_case(pattern: str) -> str:
    """ASCII letters in either case, without a flag that would let other letters match."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


KEYS = f"(?:{either_case('password|passwd|secret|token|api_?key')})"

# Kind -> (pattern, group whose length counts, least length).
BASE = {
    "assign": (KEYS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 3, 8),
    "access": (r"AKIA[A-Z0-9]+", 2, 16),
    "hex": (r"[0-9a-f]+", 2, 32),
}
# A text with a match that is long enough matches these.
HINTS = {
    "assign": KEYS + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
}
# kind -> (characters, window, bits a character that a hot window has at least)
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 24, 3.0),
    "entropy_upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16, 3.4),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 3.9),
}
KINDS = (*BASE, *CLASSES)
# Texts of spans that are no secrets: numbers, one repeated block, counting, placeholders, UUIDs.
ALLOWED = (
    r"^[0-9+/_=-]+$|^[A-Za-z]+$|(?i:example|sample|placeholder|dummy|changeme|redacted|0123456789|abcdefgh)"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
)
UNIT = 2**20
SPAN = "array<struct<start:int,kind:int,end:int>>"


def terms(width: int) -> list[int]:
    """n * log2(n) for n = 0 .. width, in 2^-20 bits."""
    return [0, 0, *[round(n * math.log2(n) * UNIT) for n in range(2, width + 1)]]


def run_pattern(characters: str, least: int) -> str:
    return f"[{characters.replace('-', '')}{'-' if '-' in characters else ''}]{{{least},}}"


def _quoted(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else 'r"' + s + '"' if '"' not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(pattern: str, size_group: int) -> str:
    """SQL: (start, end, size, hit) of each match in ``text``, left to right."""
    p = _quoted(rf"(?s)\G(.*?)({pattern})")
    return f"""aggregate(
        arrays_zip(regexp_extract_all(text, {p}, 1), regexp_extract_all(text, {p}, 2), regexp_extract_all(text, {p}, {size_group})),
        struct(0 AS at, CAST(array() AS array<struct<start:int,end:int,size:int,hit:string>>) AS spans),
        (a, x) -> struct(
            a.at + char_length(x['0']) + char_length(x['1']) AS at,
            concat(a.spans, array(struct(
                a.at + char_length(x['0']) AS start, a.at + char_length(x['0']) + char_length(x['1']) AS end,
                char_length(x['2']) AS size, x['1'] AS hit))) AS spans),
        a -> a.spans)"""


def _when(hint: str, spans: str, empty: str) -> str:
    return f"CASE WHEN text RLIKE {_quoted(hint)} THEN {spans} ELSE CAST(array() AS {empty}) END"


def _base(kind: str) -> Column:
    pattern, group, least = BASE[kind]
    found = f"""transform(filter({_found(pattern, group)}, s -> s.size >= {least}),
        s -> struct(s.start AS start, {KINDS.index(kind)} AS kind, s.end AS end))"""
    return F.expr(_when(HINTS[kind], found, SPAN))


# a span that no further window can join is put with the others, once
CLOSED = "IF(a.end >= 0, concat(a.closed, array(struct(a.start AS start, a.end AS end))), a.closed) AS closed"


def _hot(kind: str) -> Column:
    """Spans of hot windows, before the allow-list, with their text."""
    characters, width, bits = CLASSES[kind]
    table_of = f"array({', '.join(f'{t}L' for t in terms(width))})"
    least = round((width * math.log2(width) - bits * width) * UNIT)
    one = "transform(array({}), {} -> {})[0]"  # names a value within an expression
    # the character at i enters a window of which width - 1 are left; the one that left had as many
    # equals among the width - 1 after it
    near = f"size(filter(slice(codes, greatest(1, i - {width - 1}), least({width - 1}, i - 1)), x -> x = codes[i - 1]))"
    after = f"size(filter(slice(codes, i - {width - 1}, {width - 1}), x -> x = codes[i - {width + 1}]))"
    enter = one.format(near, "n", f"{table_of}[n + 1] - {table_of}[n]")
    leave = one.format(after, "n", f"{table_of}[n] - {table_of}[n + 1]")
    steps = f"transform(sequence(1, char_length(r.hit)), i -> {enter} + IF(i > {width}, {leave}, 0L))"
    window = f"r.start + i - {width}"
    step = one.format(
        "a.total + steps[i - 1]", "total",
        f"""CASE WHEN NOT (i >= {width} AND total <= {least}L) THEN struct(total AS total, a.start AS start, a.end AS end, a.closed AS closed)
            WHEN a.end >= {window} THEN struct(total AS total, a.start AS start, r.start + i AS end, a.closed AS closed)
            ELSE struct(total AS total, {window} AS start, r.start + i AS end, {CLOSED}) END""",
    )
    start = "struct(0L AS total, -1 AS start, -1 AS end, CAST(array() AS array<struct<start:int,end:int>>) AS closed)"
    hot = f"aggregate(sequence(1, char_length(r.hit)), {start}, (a, i) -> {step}, a -> struct({CLOSED}).closed)"
    hot = one.format("split(r.hit, '')", "codes", one.format(steps, "steps", hot))
    runs = _found(run_pattern(characters, width), 2)
    spans = f"flatten(transform({runs}, r -> transform({hot}, h -> struct(h.start AS start, {KINDS.index(kind)} AS kind, h.end AS end))))"
    return F.expr(_when(run_pattern(characters, width), spans, SPAN))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as ``doc``, with ``base`` and ``added``: arrays of (start, kind, end), kind an index into ``KINDS``."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), text_of(text).alias("text"))
    rows = rows.withColumn("base", F.concat(*[_base(k) for k in BASE]))
    inside = lambda s, spans: F.exists(spans, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    content = lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    # the base spans are named outside of the filter, so they are found once a text and not once a span
    hot = F.concat(*[_hot(k) for k in CLASSES])
    added = F.get(F.transform(F.array("base"), lambda b: F.filter(hot, lambda s: ~inside(s, b) & ~F.rlike(content(s), F.lit(ALLOWED)))), F.lit(0))
    return rows.withColumn("added", added).select("doc", "base", "added")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc.doc_id", *[count(k) for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
    )


def _sql() -> str:
    """The same rows in DuckDB; entropies are computed anew for each window, from the counts of its characters."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    def matches(pattern: str) -> str:
        p = quoted(f"(?s)(.*?)({pattern})")
        return f"""SELECT rowid, text, hit, size, upto - length(hit) AS start, upto AS fin FROM (
            SELECT rowid, text, hit, length(value) AS size, sum(length(gap) + length(hit)) OVER (PARTITION BY rowid ORDER BY place) AS upto
            FROM (SELECT rowid, text, unnest(regexp_extract_all(text, {p}, 1)) AS gap, unnest(regexp_extract_all(text, {p}, 2)) AS hit,
                         unnest(regexp_extract_all(text, {p}, GROUP)) AS value,
                         unnest(range(len(regexp_extract_all(text, {p}, 1)))) AS place FROM d))"""
    base = " UNION ALL ".join(
        f"SELECT rowid, start, {KINDS.index(k)} AS kind, fin, hit FROM ({matches(p).replace('GROUP', str(g))}) WHERE size >= {n}"
        for k, (p, g, n) in BASE.items()
    )
    windows = " UNION ALL ".join(
        f"""SELECT rowid, text, {KINDS.index(k)} AS kind, start AS run, start + i AS start, start + i + {w} AS fin,
            substr(hit, CAST(i + 1 AS BIGINT), {w}) AS win, {terms(w)} AS terms, {round((w * math.log2(w) - b * w) * UNIT)} AS least
            FROM (SELECT *, unnest(range(length(hit) - {w} + 1)) AS i FROM ({matches(run_pattern(c, w)).replace('GROUP', '2')}))"""
        for k, (c, w, b) in CLASSES.items()
    )
    name = f"({list(KINDS)})[kind + 1]"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rowid, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({base}),
windows AS ({windows}),
letters AS (SELECT rowid, kind, start, c, count(*) AS n FROM (SELECT rowid, kind, start, unnest(string_split(win, '')) AS c FROM windows) GROUP BY ALL),
hot AS (
  SELECT w.rowid, w.text, w.kind, w.run, w.start, w.fin
  FROM windows w JOIN letters l ON w.rowid = l.rowid AND w.kind = l.kind AND w.start = l.start
  GROUP BY ALL HAVING sum(w.terms[CAST(l.n AS INTEGER) + 1]) <= any_value(w.least)),
chains AS (
  SELECT *, sum(CASE WHEN before >= start THEN 0 ELSE 1 END) OVER (PARTITION BY rowid, kind, run ORDER BY start) AS chain
  FROM (SELECT *, lag(fin) OVER (PARTITION BY rowid, kind, run ORDER BY start) AS before FROM hot)),
spans AS (SELECT rowid, kind, min(start) AS start, max(fin) AS fin, any_value(text) AS text FROM chains GROUP BY rowid, kind, run, chain),
added AS (
  SELECT rowid, start, kind, fin FROM spans s
  WHERE NOT regexp_matches(substr(text, CAST(start + 1 AS BIGINT), CAST(fin - start AS BIGINT)), {quoted(ALLOWED)})
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rowid = s.rowid AND b.start <= s.start AND b.fin >= s.fin)),
base_of AS (
  SELECT rowid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg({name} || ':' || start::BIGINT || ':' || fin::BIGINT, ',' ORDER BY start, kind, fin) AS joined FROM base GROUP BY rowid),
all_of AS (
  SELECT rowid, string_agg({name} || ':' || start::BIGINT || ':' || fin::BIGINT, ',' ORDER BY start, kind, fin) AS joined
  FROM (SELECT rowid, start, kind, fin FROM base UNION ALL SELECT * FROM added) GROUP BY rowid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b.joined, '')) AS base_sha256, coalesce(a.joined, '') AS spans
FROM d LEFT JOIN base_of b ON d.rowid = b.rowid LEFT JOIN all_of a ON d.rowid = a.rowid
"""


OP5_SQL = _sql()
