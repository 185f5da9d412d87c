"""Training-data pipeline: from documents to token ids.

``STAGES`` are applied in order; each reads what the one before wrote. All but
the last return the columns of documents:

1. toxicity: documents that the classifier rejects go.
2. line_dedup: boilerplate lines of a source go; a document that loses all its
   lines stays, empty.
3. near_dedup: of each group of near-duplicates (five-word shingles, similarity
   0.8 or more) the document with the smallest doc_id stays.
4. mixing: documents are repeated or left out so that the sources' words come
   near their target weights.
5. byte_bpe: texts become token ids, which are decoded again for a check.

Cases follow the operators' docstrings; extra columns pass through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import byte_bpe, line_dedup, mixing, near_dedup, toxicity
from cohortlab.llm.common import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.passages(docs, model).where(F.col("score") < 0.5).select("doc.*")


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(docs)
    new = {
        "text": F.col("kept_text"),
        "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("page.n_chars")),
    }
    return rows.select(*[new.get(c, F.col(f"page.`{c}`")).alias(c) for c in docs.columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs, 5, 80, 100)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256, whole): ids are
    little-endian unsigned 32-bit integers; whole: they decode to the text."""
    rows = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "text")
    return byte_bpe.encode(rows, check=True).select(
        "doc_id", "lang", "source", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.sha2("decoded", 256) == F.col("sha256")).alias("whole"),
    )


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("near_dedup", without_copies),
    ("mixing", mixed),
    ("byte_bpe", tokenized),
]

# SQL can't state the classifier, the near-duplicate groups or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline_{name}")
    return docs
