"""The registered queries of this subpackage, and the SQL that states them where SQL can."""

from __future__ import annotations

from . import dialog_repair, exact_dedup, filter_audit, langid, line_dedup, media, ngram_join, packing, pieces, quality, quality_rules, substring_dedup, url_filter

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_packing": packing.op6_packing,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op10_language_id": langid.op10_language_id,
    "op8_media_columns": media.op8_media_columns,
    "op9_ngram_jaccard_join": ngram_join.op9_ngram_jaccard_join,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_conversation_repair": dialog_repair.op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": url_filter.OP2_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op8_media_columns": media.OP8_SQL,
    "op9_ngram_jaccard_join": ngram_join.OP9_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op13_conversation_repair": dialog_repair.OP13_SQL,
}
