"""One query per operator, and the SQL that says the same where SQL can."""

from __future__ import annotations

from colloquy.llm import decontam, line_dedup, ranked_search
from colloquy.llm.alignment import alignment
from colloquy.llm.bpe import bpe_round_trip, digests
from colloquy.llm.common import documents
from colloquy.llm.lm import lm_scores
from colloquy.llm.ngram_join import jaccard_components
from colloquy.llm.pii import find_pii, report
from colloquy.llm.quality import quality_report
from colloquy.llm.quality_rules import oracle as rules_oracle
from colloquy.llm.quality_rules import quality_rules
from colloquy.llm.simhash import simhash_components
from colloquy.llm.suffix_dedup import cut_report, cut_texts
from colloquy.llm.url_filter import url_filter


def op1_spaced_seeds(spark, sf_dir):
    return decontam.contamination_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_line_spread(spark, sf_dir):
    return line_dedup.line_report(documents(spark, sf_dir))


def op3_contextual_pii(spark, sf_dir):
    return report(find_pii(documents(spark, sf_dir)))


def op4_empirical_bayes(spark, sf_dir):
    return quality_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_simhash(spark, sf_dir):
    return simhash_components(documents(spark, sf_dir))


def op6_suffix_array(spark, sf_dir):
    return cut_report(cut_texts(documents(spark, sf_dir)))


def op7_attention_lm(spark, sf_dir):
    return lm_scores(documents(spark, sf_dir))


def op8_bpe_trie(spark, sf_dir):
    return digests(bpe_round_trip(documents(spark, sf_dir)))


def op9_url_filter(spark, sf_dir):
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_robust_outliers(spark, sf_dir):
    return quality_rules(documents(spark, sf_dir))


def op11_threshold_search(spark, sf_dir):
    return ranked_search.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_token_alignment(spark, sf_dir):
    return alignment(documents(spark, sf_dir))


def op13_ngram_jaccard(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir))


QUERIES = {
    "op1_spaced_seeds": op1_spaced_seeds,
    "op2_line_spread": op2_line_spread,
    "op3_contextual_pii": op3_contextual_pii,
    "op4_empirical_bayes": op4_empirical_bayes,
    "op5_simhash": op5_simhash,
    "op6_suffix_array": op6_suffix_array,
    "op7_attention_lm": op7_attention_lm,
    "op8_bpe_trie": op8_bpe_trie,
    "op9_url_filter": op9_url_filter,
    "op10_robust_outliers": op10_robust_outliers,
    "op11_threshold_search": op11_threshold_search,
    "op12_token_alignment": op12_token_alignment,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}

ORACLES: dict[str, str] = {
    "op1_spaced_seeds": decontam.ORACLE,
    "op2_line_spread": line_dedup.ORACLE,
    "op10_robust_outliers": rules_oracle(),
    "op11_threshold_search": ranked_search.ORACLE,
}
