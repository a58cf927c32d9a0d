"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .langid import identify_language
from .merkle import fingerprint_neighbours
from .minhash import near_duplicates
from .mixing import mix_sources
from .packing import pack_documents
from .quality import quality_rules
from .suffix import remove_repeats
from .urltree import filter_urls
from .warc import read_archives, write_archives

from .xent import cross_entropy_difference


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def tokenizer_path() -> str:
    """The vocabulary file that the packing queries use; it is read on the executors, never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("shrunk_rate", 9).alias("shrunk_rate"), "host_rejected",
    )


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(_read(spark, sf_dir, "documents"))


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = write_archives(_read(spark, sf_dir, "pages"))
    return read_archives(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal by 400 bytes; beside it, what is in repeated passages of more than 50 words, most of which are shorter than that."""
    rows, _ = remove_repeats(_read(spark, sf_dir, "documents"), length=400, passage_bytes=200, passage_words=50)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op8_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "weight")


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _read(spark, sf_dir, "labels").filter("quality = 1")
    return cross_entropy_difference(_read(spark, sf_dir, "documents"), good, tokenizer_path())


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", "branch", F.round("purity", 9).alias("purity"))


QUERIES = {
    "op1_minmax_dedup": op1_minmax_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_merkle_fingerprints": op3_merkle_fingerprints,
    "op4_warc_zstd": op4_warc_zstd,
    "op5_kernel_langid": op5_kernel_langid,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_pareto_mixing": op8_pareto_mixing,
    "op9_cross_entropy_difference": op9_cross_entropy_difference,
    "op10_url_templates": op10_url_templates,
}

ORACLES: dict[str, str] = {
    "op1_minmax_dedup": sql.OP1,
    "op2_quality_rules": sql.OP2,
    "op4_warc_zstd": sql.OP4,
    "op6_suffix_dedup": sql.OP6,
    "op8_pareto_mixing": sql.OP8,
    "op10_url_templates": sql.OP10,
}
