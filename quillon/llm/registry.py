"""The queries of this subpackage, with their oracle SQL."""

from __future__ import annotations

from . import byte_bpe, decontaminate, exact_dedup, hard_negatives, language_id, line_dedup, ngram_join, secret_scan, sharding, substring_dedup, token_alignment, token_store, warc_convert

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_token_store": token_store.op2_token_store,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_sharding": sharding.op4_sharding,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_language_id": language_id.op6_language_id,
    "op7_warc": warc_convert.op7_warc,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_substring_dedup": substring_dedup.op12_substring_dedup,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op4_sharding": sharding.ORACLE,
    "op5_ngram_join": ngram_join.ORACLE,
    "op7_warc": warc_convert.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op10_secret_scan": secret_scan.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_substring_dedup": substring_dedup.ORACLE,
}
