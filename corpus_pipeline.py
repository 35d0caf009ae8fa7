"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with the columns of `documents`; the last returns packed pieces.  Between stages
the documents are a written table, so a lost executor costs tasks, not stages.

1. toxicity: documents that the ordinal model finds toxic go.
2. SimHash near-dedup: of each component of SimHash links and of documents whose
   five-word shingles are alike by 0.8 or more one, the smallest id, stays.
3. benchmark decontamination: removal spans are cut out of the texts; documents
   that consist of nothing else go.
4. secret scans: base and owner-specific spans are replaced by a mark.
5. packing: the rest as pieces of sequences along the Hilbert curve.

Defined results: null and empty texts are clean, equal to each other (one of
them stays), hold no passage and no secret, and are packed as an end id alone.
A null id counts as the largest: its document stays only where its group has no
other; repeated rows are copies of one another.  Labels without documents, of
one kind only, or missing reject nothing; an empty benchmark removes nothing; an
empty documents table gives no rows.  Further columns of documents are kept up
to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.llm import fmindex, nearcopies, packing, secrets, toxicity
from treelens.llm.common import drop_materialized, materialize, written
from treelens.llm.queries import tokenizer_files


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fmindex.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, **tokenizer_files())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: the toxicity model, fingerprints and token ids are not expressible in SQL;
#: tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written()
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        drop_materialized(before, but_last=1)  # what the stage wrote for itself, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
