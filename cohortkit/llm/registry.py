"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import ann, chat_repair, language_id, line_dedup, mixing, packing, quality_rules, secrets, simhash, spelling, structure_repair, substring_dedup, url_filters

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_chat_repair": chat_repair.op4_chat_repair,
    "op5_ann": ann.op5_ann,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_language_id": language_id.op7_language_id,
    "op8_simhash": simhash.op8_simhash,
    "op9_mixing": mixing.op9_mixing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_spelling": spelling.op11_spelling,
    "op12_structure_repair": structure_repair.op12_structure_repair,
    "op13_secrets": secrets.op13_secrets,
}
ORACLES = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op6_url_filters": url_filters.OP6_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_structure_repair": structure_repair.OP12_SQL,
    "op13_secrets": secrets.OP13_SQL,
}
