"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, class_lm, html_extract, language_id, mixing, near_dedup, quality_rules, sharding, substring_dedup, subword_sampling


def queries() -> dict:
    return {
        "op1_hash_tree_sharding": sharding.op1,
        "op2_brown_class_lm": class_lm.op2,
        "op3_flow_mixing": mixing.op3,
        "op4_template_extraction": html_extract.op4,
        "op5_cross_polytope_search": ann.op5,
        "op6_line_frequency_rules": quality_rules.op6,
        "op7_gumbel_subwords": subword_sampling.op7,
        "op8_mixture_language_id": language_id.op8,
        "op9_near_duplicates": near_dedup.op9,
        "op10_compact_window_passages": substring_dedup.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_flow_mixing": mixing.OP3_SQL, "op6_line_frequency_rules": quality_rules.OP6_SQL, "op9_near_duplicates": near_dedup.OP9_SQL}
