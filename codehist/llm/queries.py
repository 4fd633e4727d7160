"""The queries of this subpackage and their DuckDB texts; an operator that SQL cannot express has none."""

from __future__ import annotations

from codehist.llm import archives, fill_middle, hnsw, language_id, line_dedup, minhash, mixing, piece_bpe, quality_model, quality_rules, spelling, suffix_dedup, token_files

SPARK = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_minhash": minhash.op2_minhash,
    "op3_mixing": mixing.op3_mixing,
    "op4_token_files": token_files.op4_token_files,
    "op5_hnsw": hnsw.op5_hnsw,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_arc_to_warc": archives.op7_arc_to_warc,
    "op8_piece_bpe": piece_bpe.op8_piece_bpe,
    "op9_quality_model": quality_model.op9_quality_model,
    "op10_language_id": language_id.op10_language_id,
    "op11_spelling": spelling.op11_spelling,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}

DUCK = {
    "op2_minhash": minhash.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op7_arc_to_warc": archives.OP7_SQL,
    "op12_fill_middle": fill_middle.OP12_SQL,
    "op13_line_dedup": line_dedup.OP13_SQL,
}
