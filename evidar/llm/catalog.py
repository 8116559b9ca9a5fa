"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from evidar.llm import chat, decontam, langid, lattice, lines, notices, packing, quality, simhash, spelling, substrings, vectors, whitening

QUERIES = {
    "op1_embedding_near_dedup": vectors.op1_embedding_near_dedup,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_language_id": langid.op4_language_id,
    "op5_tool_calls": chat.op5_tool_calls,
    "op6_lattice_score": lattice.op6_lattice_score,
    "op7_quality": quality.op7_quality,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_benchmark_decontamination": decontam.op9_benchmark_decontamination,
    "op10_repeated_substrings": substrings.op10_repeated_substrings,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_license_notices": notices.op12_license_notices,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLES = {
    "op2_line_dedup": lines.OP2_SQL,
    "op5_tool_calls": chat.OP5_SQL,
    "op9_benchmark_decontamination": decontam.OP9_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
}
