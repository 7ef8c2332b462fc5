"""The ``opN_*`` queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sqlkiln.sources.tables import table

from . import html, langid, linededup, manifest, merkle, minhash, mixing, packing, quality, runs, simhash, sql, tokenfile, warc
from .registry import ORACLE, QUERIES, register

__all__ = ["ORACLE", "QUERIES"]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies; it is used in place, never copied."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op1_minhash_near_dedup")
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 5-word shingle similarity of at least 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), pct=85)


@register("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024)


@register("op7_token_bit_packing")
def op7_token_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as bit-packed shards and read back."""
    return tokenfile.read_shards(tokenfile.write_shards(table(spark, sf_dir, "documents"), tokenizer_path()))


@register("op5_merkle_fingerprints")
def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle roots of all documents and of their edited texts, with likeness."""
    return merkle.fingerprints(table(spark, sf_dir, "documents")).drop("edited_paragraphs")


@register("op10_seekable_warc")
def op10_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records of seekable bundles, read back."""
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"))).drop("path")


@register("op6_distribution_quality")
def op6_distribution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures, divergence from the language's references and the verdict for all documents."""
    return quality.quality(table(spark, sf_dir, "documents"))


@register("op8_byte_cnn_language")
def op8_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a byte convolutional network."""
    return langid.identify(table(spark, sf_dir, "documents"))


# Domains of the sample corpus: a source's number modulo four.
DOMAIN = "concat('domain', try_cast(regexp_extract(source, '([0-9]+)', 1) as int) % 4)"
WEIGHTS = {("domain0",): 4, ("domain1",): 3, ("domain2",): 2, ("domain3",): 1,
           (None, "en"): 4, (None, "de"): 2, (None, "fr"): 2, (None, "es"): 2,
           ("domain0", "en", "src0"): 2, ("domain1", "de"): 5}


@register("op4_hierarchical_mixing", sql.OP4)
def op4_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of 60 % of the corpus' tokens by domain, language and source."""
    return mixing.mix(table(spark, sf_dir, "documents"), DOMAIN, WEIGHTS, budget_permille=600, max_epochs=2, seed=17)


@register("op9_line_dedup", sql.OP9)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the lines that stay when near-duplicates of earlier lines go."""
    return linededup.line_report(table(spark, sf_dir, "documents"), pct=80)


@register("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


@register("op11_simhash_golay")
def op11_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in three bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of them made periodic, and the collapsed texts."""
    docs = table(spark, sf_dir, "documents")
    return runs.report(docs, plant=True)


@register("op13_merkle_manifest", sql.OP13)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and inclusion proofs of all documents, a fifth of them tampered with."""
    return manifest.prove_documents(table(spark, sf_dir, "documents"))
