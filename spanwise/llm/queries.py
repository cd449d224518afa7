"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanwise.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; another installation names its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lbl_nce(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanwise.llm.language_model import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op2_hierarchical_eb(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanwise.llm.quality_classifier import quality, with_sites

    docs, pages = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), table(spark, sf_dir, "pages")
    return quality(docs, table(spark, sf_dir, "labels"), place=lambda scored: with_sites(scored, pages))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanwise.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op4_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanwise.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)


def op5_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanwise.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_max_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanwise.llm.html_extraction import doc_of_url, fit, html_extraction

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    weights = fit(pages.select("page_id", "html", doc_of_url(pages["url"]).alias("doc_id")), table(spark, sf_dir, "documents"))
    return html_extraction(pages, weights)


def op7_two_tier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanwise.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanwise.llm.bagminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op9_bmw_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanwise.llm.decontamination import contaminated, items_of

    return contaminated(table(spark, sf_dir, "documents"), items_of(table(spark, sf_dir, "benchmark")))


def op10_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanwise.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op11_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What substring dedup leaves of each document; cases as in suffix_dedup."""
    from spanwise.llm.suffix_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op12_bit_sliced_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item; cases as in impact_index."""
    from spanwise.llm.impact_index import ranked_search

    return ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_apriori_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations; cases as in collocations."""
    from spanwise.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lbl_nce, op2_hierarchical_eb, op3_compression_bands, op4_segment_edit_join, op5_nnpu_toxicity, op6_max_subsequence, op7_two_tier_tokens, op8_bagminhash, op9_bmw_bm25, op10_sainte_lague, op11_two_stage_suffixes, op12_bit_sliced_impacts, op13_apriori_phrases)
}
