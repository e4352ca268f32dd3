"""The queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from tallyforge.llm import chat, filter_audit, language, line_templates, minhash, mixing, neighbours, packing, prefix_trie, quality, simhash, token_output, url_filter


def queries():
    return {
        "op1_perspective_rotation": chat.op1_perspective_rotation,
        "op2_line_templates": line_templates.op2_line_templates,
        "op6_url_rules": url_filter.op6_url_rules,
        "op3_simple8b": token_output.op3_simple8b,
        "op8_line_quality": quality.op8_line_quality,
        "op5_water_filling": mixing.op5_water_filling,
        "op4_crf_language": language.op4_crf_language,
        "op9_multi_index_hashing": neighbours.op9_multi_index_hashing,
        "op10_super_minhash": minhash.op10_super_minhash,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_simhash_trie": simhash.op13_simhash_trie,
    }


def oracle_sql():
    return {
        "op1_perspective_rotation": chat.ORACLE_SQL,
        "op2_line_templates": line_templates.ORACLE_SQL,
        "op6_url_rules": url_filter.ORACLE_SQL,
        "op5_water_filling": mixing.ORACLE_SQL,
        "op8_line_quality": quality.ORACLE_SQL,
        "op11_filter_audit": filter_audit.ORACLE_SQL,
        "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    }
