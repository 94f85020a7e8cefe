"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tablewright.llm import (
    bpe,
    collocations,
    decontaminate,
    exact_dedup,
    jaccard_join,
    langid,
    line_dedup,
    lm_trie,
    prefix_trie,
    quality_fm,
    secrets_scan,
    simhash_ball,
    warc_zip,
)

QUERIES = {
    "op1_secret_scans": secrets_scan.op1_secret_scans,
    "op3_warc_zip": warc_zip.op3_warc_zip,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_quality_classifier": quality_fm.op5_quality_classifier,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_lm_scoring": lm_trie.op7_lm_scoring,
    "op8_ngram_jaccard_join": jaccard_join.op8_ngram_jaccard_join,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_language_id": langid.op10_language_id,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op11_simhash": simhash_ball.op11_simhash,
    "op12_collocations": collocations.op12_collocations,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op9_benchmark_decontamination": decontaminate.SQL,
    "op12_collocations": collocations.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
