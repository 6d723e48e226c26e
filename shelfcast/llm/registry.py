"""Registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, read_table
from .oracle import ORACLE  # noqa: F401 (read by the driver contract)

PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; every node has it at the same path."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_decode_digest
    return encode_decode_digest(read_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_verdicts
    return quality_verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_spans
    return pii_spans(read_table(spark, sf_dir, "documents"))


BYTE_BPE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Id appended to every document by the token-file and packing queries.
END_ID = 2


def op4_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rans import read_token_digests, write_token_files
    files = Shared(spark, "token-files").path
    write_token_files(read_table(spark, sf_dir, "documents"), files, *map(tokenizer_path, BYTE_BPE), END_ID, added=True)
    return read_token_digests(spark, files)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kd_sharding import shard_by_bytes
    return shard_by_bytes(read_table(spark, sf_dir, "documents"), 8)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    return pack_documents(read_table(spark, sf_dir, "documents"), *map(tokenizer_path, BYTE_BPE), END_ID, added=True)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compression_quality import score_quality
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_in_middle_digest
    return fill_in_middle_digest(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine_noisy_labels
    return mine_noisy_labels(read_table(spark, sf_dir, "embeddings"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_digest
    return mix_digest(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_rules": op2_quality_rules,
    "op3_pii": op3_pii,
    "op4_rans_files": op4_rans_files,
    "op5_toxicity": op5_toxicity,
    "op6_kd_sharding": op6_kd_sharding,
    "op7_packing": op7_packing,
    "op8_topk": op8_topk,
    "op9_compression_quality": op9_compression_quality,
    "op10_near_dup": op10_near_dup,
    "op11_fill_middle": op11_fill_middle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_mix": op13_source_mix,
    "pipeline": pipeline,
}
