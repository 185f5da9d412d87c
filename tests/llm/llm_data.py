"""Small tables with the awkward rows, and helpers."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa

DOCUMENTS = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, page string, line string, copies long, "
    # names that operators use for themselves
    "score double, passages string, doc string, kept_text string, part int, row long, slice int, class int, of string, ids binary, word string, n long"
)
CLASHING = (None, "p", None, "k", 0, None, 1, 2, "o", b"", "w", 3)
WORDS = "the of and thon rean inor ething ouble tion ering hast shed nt ti wh edon ationing reth".split()


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", "a", "er"]) for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows, extra columns."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \t\n ", "one", "Two words", "three  short\twords", "  lead and trail  "]
    base = words(rng, 120)
    texts += [base, base, base.upper(), base.replace(" ", "\n"), base + " extra", "more " + base]
    for cut in range(1, 9):
        texts.append(base[: -9 * cut] + " " + words(rng, cut))
    texts.append(words(rng, 30_000))
    footer = "Read more at our site"
    for i in range(60):
        body = "\n".join(words(rng, rng.randint(1, 25)) for _ in range(rng.randint(1, 5)))
        texts.append(f"{body}\n{footer}" if i % 2 else f"  {footer} \n\n{body}")
    texts += ["é́ ﬁ 中文 😀 'S it's x\x1cy", "a" * 3000, "ab" * 2000 + "\x00z"]
    rows = []
    for i, t in enumerate(texts):
        source = None if i % 11 == 3 else f"s{min(i % 9, 3)}"
        rows.append((i * 10, t, None if i % 5 else "en", source, None if t is None else len(t), i, "p", "l", None))
    rows += [rows[7], rows[7], rows[0]]  # repeated rows
    rows.append((None, base, "en", "s1", 1, 1, None, None, 2))
    rows.append((None, None, None, None, None, None, None, None, None))
    rng.shuffle(rows)
    return rows


def frame(spark, rows: list[tuple], schema: str = DOCUMENTS):
    if schema is DOCUMENTS:
        rows = [(*r, *CLASHING) for r in rows]
    return spark.createDataFrame(rows, schema).repartition(3)


def stored(spark, path, **tables) -> str:
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def answers(sql: str, **tables) -> list[tuple]:
    """Rows of DuckDB SQL over Spark tables, columns by name."""
    con = duckdb.connect()
    for name, df in tables.items():
        types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
        data = [r.asDict() for r in df.collect()]
        arrow = pa.table({c: pa.array([r[c] for r in data], kinds[t]) for c, t in types.items() if t in kinds})  # noqa: F841
        con.register(name, arrow)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return ordered([tuple(r[i] for i in order) for r in cur.fetchall()])


def rows_of(df) -> list[tuple]:
    return ordered([tuple(r) for r in df.select(sorted(df.columns)).collect()])


def ordered(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


