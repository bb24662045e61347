"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, infill, jaccard, langid, licenses, manifest, mixing, oracles, pieces, quality, repeats, secrets, sharding, topk
from .common import table

#: The vocabulary file; a parameter of the operator.
MODEL = os.environ.get("TIDEMARK_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text; documents held out by checksum of their id teach nothing."""
    held_out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out)
    model = langid.fit(docs.where(~F.col("held_out")).select(F.col("doc_id").alias("id"), "text", "lang"))
    return langid.identify(docs, model, keep=("held_out",)).withColumnRenamed("id", "doc_id")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded: counts and digests of ids and of the decoded text."""
    return pieces.encode_digests(table(spark, sf_dir, "documents"), MODEL).withColumnRenamed("id", "doc_id")


def op3_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness."""
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op5_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles are alike to 90 percent."""
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by the co-trained views, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")
    views = quality.fit(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y")))
    scored = quality.score(docs, views).withColumnRenamed("id", "doc_id")
    return scored.withColumn("kept", F.col("score") >= quality.THRESHOLD)


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 by jump consistent hashing, with slots and the shard among 17."""
    shards = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=16)
    return shards.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text without 200-byte strings that occur elsewhere."""
    return repeats.dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text, with what ownership over the corpus adds."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_bare", "n_live")


def op10_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for each vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf, its proof, and the root of its version after tampering with every other document's line ends."""
    number = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    other = F.when(number, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered={"text": other})
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text in its form: where it is cut, and digests of the output and of the text rebuilt from it."""
    rows = infill.fill_in_middle(table(spark, sf_dir, "documents")).withColumn("restored", infill.restored(F.col("output"), F.col("form")))
    return rows.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and blocks that meet a license template, in every whole text."""
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_pieces, op3_lz_fingerprints, op4_mix_sources, op5_jaccard_components, op6_quality, op7_jump_shards, op8_repeats, op9_secret_scan, op10_block_top_k, op11_merkle_manifest, op12_fill_in_middle, op13_license_scan)}
#: The others hash, learn or search in ways that SQL can't say; tests hold them against brute force.
ORACLE_SQL: dict = {"op4_mix_sources": oracles.OP4, "op5_jaccard_components": oracles.OP5, "op7_jump_shards": oracles.OP7, "op10_block_top_k": oracles.OP10, "op11_merkle_manifest": oracles.OP11, "op12_fill_in_middle": oracles.OP12, "op13_license_scan": oracles.OP13}
