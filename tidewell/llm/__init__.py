"""Training-data operators. Nothing outside this subpackage imports it."""

from . import byte_cnn, decontaminate, html_extract, lang_id, merkle, mixing, ngram_join, pseudonyms, quality_rules, sharding, substring_dedup, token_counts, vector_codes

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_mixing": mixing.op2_mixing,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_pseudonyms": pseudonyms.op4_pseudonyms,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_quality_classifier": byte_cnn.op8_quality_classifier,
    "op9_sharding": sharding.op9_sharding,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_language_id": lang_id.op12_language_id,
    "op13_merkle": merkle.op13_merkle,
}
ORACLE_SQL = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op3_ngram_join": ngram_join.OP3_SQL,
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
