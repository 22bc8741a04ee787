"""Queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from readlake.llm import exact_dedup, html_text, lattice_lm, line_dedup, near_dedup, packing, pii, piece_bpe, quality, tool_links, toxicity, turn_repair, vector_codes


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_tool_links": tool_links.op2_tool_links,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_lattice_lm": lattice_lm.op6_lattice_lm,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_html_text": html_text.op9_html_text,
        "op10_piece_bpe": piece_bpe.op10_piece_bpe,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_line_dedup": line_dedup.op12_line_dedup,
        "op13_turn_repair": turn_repair.op13_turn_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": pii.SQL, "op3_exact_dedup": exact_dedup.SQL, "op5_quality_rules": quality.SQL, "op11_vector_codes": vector_codes.SQL, "op12_line_dedup": line_dedup.SQL}
