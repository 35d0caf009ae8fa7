"""The registered queries of the training-data operators: each applies its
operator with production parameters to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytecnn, fmindex, media, packing, secrets, sharding, simhash, substring, toxicity
from .common import documents_of
from .secrets_sql import ORACLE as OP9_SQL
from .warc_query import ORACLE as OP2_SQL
from .warc_query import op2_warc_revisit_resolution
from .window_sql import LEAKS, SUBSTRINGS

SHARDS = [f"shard-{i:04d}" for i in range(256)]


def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and verdict of every document."""
    docs = documents_of(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model)


def op3_gear_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a WAV in the chunk store, read back and verified."""
    return media.ChunkStore(documents_of(spark, sf_dir)).read()


def op4_rabin_karp_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without windows of smaller documents."""
    found = substring.remove_repeats(documents_of(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer_files() -> dict[str, str]:
    """The vocabulary that op5 names, read from the installed package."""
    import public_tokenizers as p

    return {"path": p.path("byte_bpe_50k.json"), "ranks_path": p.path("byte_bpe_50k.tiktoken"), "pattern": p.PATTERN}


def op5_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed along the Hilbert curve."""
    pieces = packing.pack(documents_of(spark, sf_dir), **tokenizer_files())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    found = fmindex.find_leaks(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op7_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned without the held-out rows."""
    docs = documents_of(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(bytecnn.fold() != 2)
    net = bytecnn.fit(docs, labels)
    held_out = F.coalesce(bytecnn.fold() == 2, F.lit(False))
    scored = bytecnn.score(docs, net)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_simhash_anchor_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents_of(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op9_ownership_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and owner-specific tokens of every document."""
    found = secrets.scan_secrets(documents_of(spark, sf_dir))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secrets.span_list(secrets.base_spans(F.col("spans"))), 256).alias("base_sha256"),
        secrets.span_list(F.col("spans")).alias("spans"),
        "n_owned",
    )


def op10_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, by its doc_id."""
    docs = documents_of(spark, sf_dir)
    return sharding.assign_shards(docs.select("doc_id"), SHARDS, "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_ordinal_toxicity, op2_warc_revisit_resolution, op3_gear_chunked_media, op4_rabin_karp_substrings, op5_hilbert_packing,
        op6_fm_index_decontamination, op7_byte_cnn_quality, op8_simhash_anchor_covering, op9_ownership_secret_scan, op10_permutation_sharding,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_warc_revisit_resolution": OP2_SQL, "op4_rabin_karp_substrings": SUBSTRINGS, "op6_fm_index_decontamination": LEAKS, "op9_ownership_secret_scan": OP9_SQL,
}
